"""Enrichment of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import EnrichmentConfig
from ..plans.pipeline import Pipeline, PipelineResult


def enrich_stream(
    pipeline: Pipeline, stream: DataFrame, sink: Callable[[PipelineResult, int], None], checkpoint: str,
    config: EnrichmentConfig | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Run the pipeline over every micro-batch and hand its result to ``sink(result, batch_id)``.

    Python levels are stored per batch like in a batch run, so a sink may read
    data, errors and cost without repeating calls, but not after it returns:
    what the batch kept in memory and in the shared folder then goes.  A batch that is replayed
    after a failure has the same id; with caching its answers are reused.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = pipeline.run(batch, config)
        try:
            sink(result, number)
        finally:
            result.close()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_to(path: str) -> Callable[[PipelineResult, int], None]:
    """A sink of Parquet folders, one a batch, so that a replayed batch overwrites itself."""

    def sink(result: PipelineResult, number: int) -> None:
        result.frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
