"""Runs that call only for rows that are new or changed since the last run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EnrichmentConfig
from ..errors import PipelineError
from ..operators.steps import ColumnStep, PythonStep
from ..sources.checkpoints import CheckpointManager
from .pipeline import ROW, Pipeline, quoted
from .skew import spread_left_join
from .storage import Files, shared_root, stored

CONTENT, KNOWN = "__content", "__known"


@dataclass
class IncrementalResult:
    """The enriched rows, and how many of them came from where; ``forgotten`` contents are no longer in the input."""

    data: DataFrame
    errors: DataFrame
    called: int
    reused: int
    forgotten: int


class IncrementalTable:
    """The answers of a pipeline for a table that changes between runs, below ``path`` in a shared folder.

    A row's content is the hash of the columns that the steps look at (all, if
    a step doesn't say which) and of the steps' settings.  Rows whose content
    has an answer take it; the others run through the pipeline.  Rows that
    failed are not remembered, so they run again.  Answers whose content left
    the input are forgotten.  Equal rows share an answer; each run writes the
    next generation of answers and only then drops the one before.

    With ``key``, the columns that name a row from run to run, content holds the
    key too: a row that changed is called for even if another row once had the
    values that it has now.
    """

    def __init__(self, pipeline: Pipeline, path: str, key: list[str] | None = None):
        self.pipeline, self.path, self.key = pipeline, path.rstrip("/"), list(key or [])

    def _steps(self) -> list[Any]:
        return [self.pipeline.get_step(n) for n in self.pipeline.step_names]

    def _looked_at(self, columns: list[str]) -> list[str]:
        if missing := [c for c in self.key if c not in columns]:
            raise PipelineError(f"not among the input's columns: {', '.join(missing)}")
        wanted = set(self.key)
        for step in self._steps():
            open_ended = isinstance(step, ColumnStep) or step.reads is None or step.run_if is not None or step.skip_if is not None
            wanted |= set(columns if open_ended else step.reads)
        return sorted(wanted)

    def _content(self, columns: list[str], config: EnrichmentConfig) -> Any:
        made = [s.key_parts() if isinstance(s, PythonStep) else {f: str(c) for f, c in s.columns.items()} for s in self._steps()]
        settings = CheckpointManager.mark(self.pipeline.step_names, made, config.temperature, config.max_tokens, config.overwrite_fields)
        row = F.to_json(F.struct(*(F.col(quoted(c)) for c in self._looked_at(columns))), {"ignoreNullFields": "false"})
        return F.sha2(F.concat_ws("\u001e", F.lit(settings), row), 256)

    def _generations(self, files: Files) -> list[int]:
        found = [int(n.removeprefix("gen-")) for n in files.names(self.path) if n.startswith("gen-")]
        return sorted(g for g in found if files.exists(f"{self.path}/gen-{g}/_SUCCESS"))

    def run(self, data: DataFrame, config: EnrichmentConfig | None = None) -> IncrementalResult:
        """Enrich ``data``; the result lies in the shared folder until the driver ends."""
        config, spark = config or EnrichmentConfig(), data.sparkSession
        files, place = Files(spark), f"{shared_root(spark)}/quillrow/incremental-{uuid.uuid4().hex}"
        files.delete_on_exit(place)
        generations = self._generations(files)
        keyed = data.withColumn(ROW, F.monotonically_increasing_id()).withColumn(CONTENT, self._content(data.columns, config))
        before = spark.read.parquet(f"{self.path}/gen-{generations[-1]}") if generations else None
        if before is None:
            joined = stored(keyed.withColumn(KNOWN, F.lit(None).cast("boolean")), f"{place}/met")
        else:
            known = before.select(CONTENT, F.struct(*(quoted(c) for c in before.columns if c != CONTENT)).alias("__answer"), F.lit(True).alias(KNOWN))
            joined = stored(spread_left_join(keyed, known, CONTENT, ROW), f"{place}/met")
        fresh = joined.where(F.col(KNOWN).isNull())
        result = self.pipeline.run(fresh.select(*map(quoted, data.columns), ROW), config)
        fields = [c for c in result.frame.columns if c not in data.columns or c in {f for s in self._steps() for f in s.fields}]
        failed = result.errors.select(F.col("row_id").alias(ROW)).distinct()
        answered = result.frame_with_row.join(fresh.select(ROW, CONTENT), ROW)
        good = answered.join(failed, ROW, "left_anti").select(CONTENT, *map(quoted, fields))
        if before is not None:
            again = joined.where(KNOWN).select(CONTENT, *(F.col(quoted("__answer", f)).alias(f) for f in fields))
            good = again.unionByName(good)
            kept = [F.col(quoted("__answer", c)).alias(c) if c in fields else F.col(quoted(c)) for c in result.frame.columns]
            whole = joined.where(KNOWN).select(*kept).unionByName(result.frame)
        else:
            whole = result.frame
        number = generations[-1] + 1 if generations else 0
        one = good.groupBy(CONTENT).agg(F.first(F.struct(*map(quoted, fields))).alias("a")).select(CONTENT, "a.*")
        one.write.mode("overwrite").parquet(f"{self.path}/gen-{number}")
        counts = joined.agg(F.count_if(F.col(KNOWN).isNull()).alias("called"), F.count_if(KNOWN).alias("reused")).first()
        forgotten = 0
        if before is not None:
            forgotten = before.join(joined.select(CONTENT).distinct(), CONTENT, "left_anti").count()
        whole, errors = stored(whole, f"{place}/data"), stored(result.errors, f"{place}/errors")
        result.close()
        files.delete(f"{place}/met")
        for g in generations:
            files.delete(f"{self.path}/gen-{g}")
        return IncrementalResult(whole, errors, counts.called, counts.reused, forgotten)
