"""Step checkpoints: each finished level, and each finished part of a level, is a stored frame named in a manifest."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.storage import Files, stored
from ..spec import canonical_json


@dataclass(frozen=True)
class CheckpointData:
    """What a manifest says: the last finished level, the parts of the next one that are finished, and what they were made from.

    ``steps`` holds a mark of each step that the stored frames contain.
    """

    fingerprint: str
    steps: dict[str, str] = field(default_factory=dict)
    level: int = -1
    parts: list[int] = field(default_factory=list)
    part_count: int = 0
    schema: str = ""
    timestamp: float = 0.0

    @property
    def completed_steps(self) -> list[str]:
        return sorted(self.steps)


class CheckpointManager:
    """Checkpoints of runs, by identifier, below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root, self.files = spark, folder.rstrip("/"), Files(spark)

    @staticmethod
    def mark(*parts: Any) -> str:
        """The same for equal parts, in any process."""
        return hashlib.sha256(canonical_json(list(parts)).encode()).hexdigest()[:32]

    def _manifest(self, run: str) -> str:
        return f"{self.root}/{run}/manifest.json"

    def path(self, run: str, level: int) -> str:
        return f"{self.root}/{run}/level-{level}"

    def store(self, run: str, level: int, frame: DataFrame) -> DataFrame:
        """Store a level's frame; it doesn't count before ``save`` names it."""
        return stored(frame, self.path(run, level))

    def store_part(self, run: str, level: int, part: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path(run, level)}/part-{part}")

    def begin_parts(self, run: str, level: int) -> None:
        """Removes what an earlier run of another shape may have left."""
        self.files.delete(self.path(run, level))

    def parts(self, run: str, level: int, count: int, schema: StructType) -> DataFrame:
        """The stored parts of a level as one frame."""
        return self.spark.read.schema(schema).parquet(*(f"{self.path(run, level)}/part-{i}" for i in range(count)))

    def save(self, run: str, data: CheckpointData) -> None:
        """Write the manifest: from now on the run goes on from there."""
        self.files.write_json(self._manifest(run), {**vars(data), "timestamp": time.time()})

    def load(self, run: str, fingerprint: str, steps: dict[str, str]) -> CheckpointData | None:
        """What is finished, if it was made from the same input by the same steps."""
        found = self.files.read_json(self._manifest(run))
        if not found or found.get("fingerprint") != fingerprint:
            return None
        data = CheckpointData(**{k: v for k, v in found.items() if k in CheckpointData.__dataclass_fields__})
        return data if all(steps.get(n) == m for n, m in data.steps.items()) else None

    def frame(self, run: str, data: CheckpointData) -> DataFrame:
        schema = StructType.fromJson(json.loads(data.schema))
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path(run, data.level))

    def cleanup(self, run: str) -> None:
        self.files.delete(f"{self.root}/{run}")

    def list_checkpoints(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(self._manifest(n))]
