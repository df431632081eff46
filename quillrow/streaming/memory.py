"""Answers that a stream remembers in its own state: one call for each key and stretch of event time."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import EnrichmentConfig
from ..errors import PipelineError
from ..operators.steps import PythonStep, to_step
from ..plans.pipeline import quoted, record_type
from ..plans.worker import StepPlan, _now, _waits, one_row
from ..spec import canonical_json

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Transformations with timers need this provider; Spark's default keeps no column families.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of these types (and decimals) are the same exactly if their text is; of others (NaN, -0.0, collations, nested ones) only Spark's grouping knows.
_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "timestamp_ntz"}
#: An output row and its record where the step isn't asked.
_MADE = Row("row", "made", "late")
_NOTHING = {"values": None, "error": None, "skipped": False, "from_cache": False, "usage": None}


class _Memory(StatefulProcessor):
    """One key in one stretch of time: the answer, until a timer at the stretch's end drops it."""

    def __init__(self, step: PythonStep, inputs: list[str], config: EnrichmentConfig):
        self.step, self.inputs, self.config = step, inputs, config
        self.plan = StepPlan(step, inputs, [], dict(step.specs), None, None, step.name, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "values string")
        self.loop = asyncio.new_event_loop()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ends = key[-1]
        late = ends is not None and ends <= timerValues.getCurrentWatermarkInMs()
        known = self.answer.get()[0] if not late and ends is not None and self.answer.exists() else None
        # without a predicate all rows that find the answer get the same record
        asks_nothing = self.step.run_if is None and self.step.skip_if is None
        same = {"values": None, "error": None, "skipped": False, "from_cache": False, "usage": None} if late else None
        for row in rows:
            given = row["row"]
            if same is not None:
                yield Row(row=given, made=same, late=late)
                continue
            out = self.loop.run_until_complete(one_row(self.plan, {c: given[c] for c in self.inputs}, {}, None, known, self.config))
            if known is None and ends is not None and out["values"] is not None and not out["skipped"]:
                known = canonical_json(out["values"])
                self.answer.update((known,))
                self.handle.registerTimer(ends)
            elif known is not None and asks_nothing and out["error"] is None:
                same = out
            yield Row(row=given, made=out, late=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        self.loop.close()


class _Memories(_Memory):
    """The keys of one bucket in one stretch of time: their answers in one list, an entry for each micro-batch that added some.

    Spark moves a group's state, timer and rows with a dozen messages and an Arrow
    batch of its own, which costs more than the rows of a key when these are few.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getListState("answers", "known string")
        self.loop = asyncio.new_event_loop()
        self.finish = self.loop.run_until_complete if _waits(self.step) else _now

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ends = key[-1]
        if ends is not None and ends <= timerValues.getCurrentWatermarkInMs():
            for row in rows:
                yield _MADE(row["row"], _NOTHING, True)
            return
        known: dict[str, str] = {}
        if ends is not None and self.answer.exists():
            for (part,) in self.answer.get():
                known |= json.loads(part)
        asks_nothing = self.step.run_if is None and self.step.skip_if is None
        old, fresh, same = bool(known), {}, {}
        for row in rows:
            given, mark = row["row"], row["mark"]
            out = same.get(mark)
            if out is None:
                hit = known.get(mark)
                out = self.finish(one_row(self.plan, {c: given[c] for c in self.inputs}, {}, None, hit, self.config))
                if hit is None and ends is not None and out["values"] is not None and not out["skipped"]:
                    known[mark] = fresh[mark] = canonical_json(out["values"])
                elif hit is not None and asks_nothing and out["error"] is None:
                    same[mark] = out
            yield _MADE(given, out, False)
        if fresh:
            self.answer.appendValue((json.dumps(fresh),))
            if not old:
                self.handle.registerTimer(ends)


def _mark(columns: list[Column], kinds: list[T.DataType]) -> Column | None:
    """The key as a text, if the types allow."""
    if any(kind.simpleString() not in _PLAIN and not isinstance(kind, T.DecimalType) for kind in kinds):
        return None
    exact = [F.unix_micros(c) if isinstance(kind, T.TimestampType) else c for c, kind in zip(columns, kinds, strict=True)]
    return F.to_json(F.array(*(c.cast("string") for c in exact)))


def remembered(stream: DataFrame, step: Any, key: list[str], at: str, seconds: int, delay: str, config: EnrichmentConfig | None = None, buckets: int = 512) -> DataFrame:
    """The stream with the step's fields, ``error``, ``from_memory`` and ``late``; one call for each key and stretch of time.

    Time ``at`` is cut into stretches of ``seconds`` from 1970 on.  The first
    row of a key in a stretch asks; the others, in this or later micro-batches
    and in any order, get the same answer, which Spark's state store keeps
    until the watermark (the latest time seen less ``delay``) passes the
    stretch's end.  So the state holds the open stretches only, and after a
    failure a batch goes on from the state of the batch before.

    A row whose stretch is over when its batch begins is late: it is never
    asked about, and comes with null fields and ``late`` true.  Rows
    without time are asked about one by one and remember nothing; null keys are
    one key.  Failed and skipped rows are not remembered, so that the next row asks.
    The step's ``reads`` (the key, if not given) are all it sees; of equal keys any row may be the one that asks.

    Keys are dealt to ``buckets``, and Spark keeps the answers of a bucket in a stretch
    together, so a micro-batch reads all of these if it has a row there: take
    more buckets for more open keys, and the same number for the life of a
    checkpoint.  Keys with a column of floating point, binary, nested or collated type are kept one by one.

    A bucket's rows of one micro-batch and stretch meet in one task but pass it one by one; what a
    batch holds is bounded by its source (files or offsets a trigger).  Each task
    waits for one call at a time.
    """
    step = to_step(step)
    if not isinstance(step, PythonStep):
        raise PipelineError(f"step {step.name!r} calls nothing that could be remembered")
    if isinstance(step.run_if, Column) or isinstance(step.skip_if, Column):
        raise PipelineError(f"step {step.name!r}: predicates of remembered steps are functions of the row")
    if step.depends_on:
        raise PipelineError(f"step {step.name!r}: a remembered step depends on no other")
    if seconds <= 0 or not key or buckets <= 0:
        raise PipelineError("a memory needs a key, stretches of at least a second and a bucket")
    names = stream.columns
    inputs = list(step.reads) if step.reads is not None else list(key)
    if missing := [c for c in [*key, at, *inputs] if c not in names]:
        raise PipelineError(f"not among the stream's columns: {', '.join(missing)}")
    if taken := [f for f in [*step.types, "error", "from_memory", "late"] if f in names]:
        raise PipelineError(f"the stream has columns of these names already: {', '.join(taken)}")
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    length = seconds * 1000
    # the watermark's own column goes before the state, so that Spark drops no late row by it
    timed = stream.select(F.struct(*map(quoted, names)).alias("row"), F.col(quoted(at)).cast("timestamp").alias("at")).withWatermark("at", delay)
    keys = [F.col(quoted("row", c)) for c in key]
    mark = _mark(keys, [stream.schema[c].dataType for c in key])
    told = {f"key_{i}": c for i, c in enumerate(keys)} if mark is None else {"bucket": F.pmod(F.xxhash64(mark), F.lit(buckets))}
    ends = (F.floor(F.unix_millis("at") / length) + 1) * length
    rows = timed.select("row", *(c.alias(n) for n, c in told.items()), *([] if mark is None else [mark.alias("mark")]), ends.alias("ends"))
    kind = T.StructType([rows.schema["row"], T.StructField("made", record_type(step)), T.StructField("late", T.BooleanType())])
    memory = (_Memory if mark is None else _Memories)(step, inputs, config or EnrichmentConfig())
    made = rows.groupBy(*told, "ends").transformWithState(memory, kind, "Append", "EventTime")
    fields = [F.col(quoted("made", "values", f)).alias(f) for f in step.types]
    return made.select(*(F.col(quoted("row", c)).alias(c) for c in names), *fields, F.col("made.error").alias("error"), F.col("made.from_cache").alias("from_memory"), "late")
