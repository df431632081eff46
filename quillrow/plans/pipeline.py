"""The pipeline: plans a step graph over a DataFrame and reports what happened.

Each step adds one struct column to the same frame, so results never have to
be joined.  Column steps stay lazy; a level with Python steps is stored once
before anything reads it, because data, errors and cost all do.
"""

from __future__ import annotations

import asyncio
import copy
import logging
import sys
import time
import uuid
from dataclasses import replace
from functools import cached_property
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import EnrichmentConfig
from ..errors import PipelineError, RowError, StepError
from ..functions.columns import cache_key, merged
from ..hooks import EnrichmentHooks, PipelineEndEvent, PipelineStartEvent, RowCompleteEvent, StepEndEvent, StepStartEvent
from ..operators.steps import ColumnStep, PythonStep, as_column, to_step
from ..records import CostSummary, StepUsage
from ..sources.cache import CacheManager
from ..sources.checkpoints import CheckpointData, CheckpointManager
from ..spec import canonical_json
from .budget import BudgetService
from .graph import last_writers, levels
from .skew import spread_join, spread_left_join
from .storage import Files, shared_root, stored
from .worker import StepPlan, level_function

log = logging.getLogger("quillrow")
ROW = "__row_id"
#: Parts that a level is saved in, at most.
MOST_PARTS = 32
ERROR = "struct<type:string,message:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,model:string>"


def output(step: str) -> str:
    """Name of a step's struct column."""
    return f"__s_{step}"


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def _holds_map(kind: T.DataType) -> bool:
    """Whether values of a type can't be hashed as they are."""
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def record_type(step: PythonStep) -> T.StructType:
    """Type of a step's struct column."""
    values = ",".join(f"{quoted(f)}:{k}" for f, k in step.types.items())
    return T.StructType.fromDDL(f"values struct<{values}>, error {ERROR}, skipped boolean, from_cache boolean, usage {USAGE}")


class Pipeline:
    """Steps with their dependencies, checked and put in levels."""

    def __init__(self, steps: list[Any]):
        made = [to_step(s) for s in steps]
        self._levels = levels([(s.name, s.depends_on) for s in made])
        self._steps = {s.name: s for s in made}

    @property
    def step_names(self) -> list[str]:
        return [n for level in self._levels for n in level]

    @property
    def execution_levels(self) -> list[list[str]]:
        return [list(level) for level in self._levels]

    def get_step(self, name: str) -> Any:
        return self._steps[name]

    def only(self, fields: list[str]) -> Pipeline:
        """The pipeline without steps that none of these fields needs."""
        writers = last_writers(self.step_names, {n: s.fields for n, s in self._steps.items()})
        wanted, todo = set(), [writers[f] for f in fields if f in writers]
        while todo:
            name = todo.pop()
            if name not in wanted:
                wanted.add(name)
                todo += self._steps[name].depends_on
        if not wanted:
            raise PipelineError("no step makes any of the fields asked for")
        return Pipeline([s for n, s in self._steps.items() if n in wanted])

    def run(
        self, data: Any, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None, spark: SparkSession | None = None,
        where: Column | None = None, select_fields: list[str] | None = None, data_identifier: str | None = None, columns: list[str] | None = None,
    ) -> PipelineResult:
        """Enrich a DataFrame, a pandas frame or a list of dicts; the result's data has the same form.

        ``where`` filters input rows before any step sees them; with
        ``select_fields`` only the steps these fields need are run, and with
        ``columns`` only these input columns are in the result: others that no
        step reads are then neither stored nor read from the source.  Lists
        are always overwritten, frames as ``overwrite_fields`` says.
        """
        config = config or EnrichmentConfig()
        if select_fields is not None:
            return self.only(select_fields).run(data, config, hooks, spark, where, None, data_identifier, columns)
        frame, form = _as_frame(data, spark)
        if frame is None:
            return PipelineResult.empty(form)
        if form == "list":
            config = config.but(overwrite_fields=True)
        if where is not None:
            frame = frame.where(where)
        return _Run(self, frame, config, hooks or EnrichmentHooks(), form, data_identifier, columns).execute()

    async def run_async(self, data: Any, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None, **more: Any) -> PipelineResult:
        return await asyncio.to_thread(self.run, data, config, hooks, **more)

    def runner(self, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None) -> Enricher:
        return Enricher(self, config, hooks)

    def clear_cache(self, spark: SparkSession, step: str | None = None, cache_dir: str | None = None) -> int:
        cache = CacheManager(spark, cache_dir)
        return cache.delete_all() if step is None else cache.delete_step(step)


class Enricher:
    """A pipeline with fixed settings; gives back only the data."""

    def __init__(self, pipeline: Pipeline, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None):
        self.pipeline, self.config, self.hooks = pipeline, config or EnrichmentConfig(), hooks
        self.last: PipelineResult | None = None

    def run(self, data: Any, overwrite_fields: bool | None = None, data_identifier: str | None = None) -> Any:
        config = self.config if overwrite_fields is None else self.config.but(overwrite_fields=overwrite_fields)
        self.last = self.pipeline.run(data, config, self.hooks, data_identifier=data_identifier)
        return self.last.data

    async def run_async(self, data: Any, overwrite_fields: bool | None = None, data_identifier: str | None = None) -> Any:
        return await asyncio.to_thread(self.run, data, overwrite_fields, data_identifier)


def _as_frame(data: Any, spark: SparkSession | None) -> tuple[DataFrame | None, str]:
    """The input as a DataFrame; local input gets its position as row id, so that order survives."""
    if isinstance(data, DataFrame):
        return data, "spark"
    spark = spark or SparkSession.active()
    if isinstance(data, list):
        if not data:
            return None, "list"
        names = list(dict.fromkeys(k for row in data for k in row))
        return spark.createDataFrame([{**{n: row.get(n) for n in names}, ROW: i} for i, row in enumerate(data)]).select(*map(quoted, names), ROW), "list"
    if not len(data):
        return None, "pandas"
    return spark.createDataFrame(data.reset_index(drop=True).assign(**{ROW: range(len(data))})), "pandas"


class _Run:
    """One execution of a pipeline."""

    def __init__(self, pipeline: Pipeline, frame: DataFrame, config: EnrichmentConfig, hooks: EnrichmentHooks, form: str, identifier: str | None, columns: list[str] | None = None):
        self.pipeline, self.config, self.hooks, self.form = pipeline, config, hooks, form
        self.spark = frame.sparkSession
        self.inputs = [c for c in frame.columns if c != ROW]
        if columns is not None and (unknown := [c for c in columns if c not in self.inputs]):
            raise PipelineError(f"not among the input's columns: {', '.join(unknown)}")
        self.shown = self.inputs if columns is None else [c for c in self.inputs if c in columns]
        self.frame = frame if ROW in frame.columns else frame.withColumn(ROW, F.monotonically_increasing_id())
        self.input_schema = frame.drop(ROW).schema
        self.identifier = identifier
        self.name = f"run-{uuid.uuid4().hex}"
        self.place = f"{shared_root(self.spark)}/quillrow/{self.name}"
        self.cache = CacheManager(self.spark, config.cache_dir, config.cache_ttl) if config.enable_caching else None
        self.watching = any(vars(hooks).values())
        self.persisted: list[DataFrame] = []
        self.files = Files(self.spark)
        #: Counters of steps that were observed while their level was stored.
        self.counted: dict[str, Any] = {}

    def close(self) -> None:
        """Frees what the run keeps in memory and in the shared folder."""
        for frame in self.persisted:
            frame.unpersist()
        self.persisted = []
        self.files.delete(self.place)

    def _store(self, frame: DataFrame, number: int, steps: list[Any]) -> DataFrame:
        """A level's frame in the run's folder, its counters taken while it is written; earlier levels go."""
        name = f"level-{number}"
        self.files.delete_on_exit(self.place)
        frame = self._observed(frame, steps, lambda f: stored(f, f"{self.place}/{name}"))
        for other in self.files.names(self.place):
            if other != name:
                self.files.delete(f"{self.place}/{other}")
        for earlier in self.persisted:
            earlier.unpersist()
        self.persisted = []
        return frame

    def _observed(self, frame: DataFrame, steps: list[Any], store: Any) -> DataFrame:
        if not steps:
            return store(frame)
        seen = Observation(f"level of {', '.join(s.name for s in steps)}")
        frame = store(frame.observe(seen, F.struct(*(usage_column(s, self.config.enable_caching) for s in steps)).alias("all")))
        found = seen.get.get("all")
        if found:  # an empty input's plan may have lost the node
            self.counted |= {s.name: found[s.name] for s in steps}
        return frame

    def execute(self) -> PipelineResult:
        began = time.time()
        before = log.level
        log.setLevel(self.config.log_level)
        names = self.pipeline.step_names
        count = self.frame.count() if self.watching or self.config.enable_checkpointing else -1
        self.hooks.fire("on_pipeline_start", PipelineStartEvent(names, count, self.config))
        result, failed = None, 0
        try:
            result = self._levels(count)
            return result
        except Exception as problem:
            failed = int(isinstance(problem, StepError))
            self.close()
            raise
        finally:
            log.setLevel(before)
            if self.watching:
                cost = result.cost if result else CostSummary()
                errors = result.error_count if result else failed
                self.hooks.fire("on_pipeline_end", PipelineEndEvent(count, errors, cost, time.time() - began))

    def _marks(self) -> dict[str, str]:
        """What each step's results depend on beside its input."""
        marks = {}
        for n in self.pipeline.step_names:
            step = self.pipeline.get_step(n)
            made = step.key_parts() if isinstance(step, PythonStep) else {f: str(c) for f, c in step.columns.items() if isinstance(c, Column)}
            marks[n] = CheckpointManager.mark(n, list(step.fields), step.depends_on, made, self.config.temperature, self.config.max_tokens)
        return marks

    def _fingerprint(self, count: int) -> str:
        """Of the input's schema and rows, whatever their order."""
        rows = [F.to_json(F.struct(F.col(quoted(f.name)))) if _holds_map(f.dataType) else F.col(quoted(f.name)) for f in self.input_schema.fields]
        sums = [F.sum(F.xxhash64(*rows, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
        return CheckpointManager.mark(self.input_schema.json(), count, *map(str, self.frame.agg(*sums).first()))

    def _levels(self, count: int) -> PipelineResult:
        manager = run = None
        done = CheckpointData("")
        all_levels = self.pipeline.execution_levels
        if self.config.enable_checkpointing:
            manager, marks = CheckpointManager(self.spark, self.config.checkpoint_dir), self._marks()
            fingerprint = self._fingerprint(count)
            run = self.identifier or manager.mark(fingerprint, sorted(marks))
            found = manager.load(run, fingerprint, marks) if self.config.auto_resume else None
            if found and found.level >= 0:
                self.frame = manager.frame(run, found)
            done = found or CheckpointData(fingerprint)
        for number, level in enumerate(all_levels):
            todo = [self.pipeline.get_step(n) for n in level if n not in done.steps]
            if not todo:
                continue
            began = time.time()
            self._progress(number, all_levels)
            self.spark.sparkContext.setJobDescription(f"level {number}: {', '.join(s.name for s in todo)}")
            for step in todo:
                self.hooks.fire("on_step_start", StepStartEvent(step.name, count, number))
            python = [s for s in todo if isinstance(s, PythonStep)]
            last = number == len(all_levels) - 1
            if manager and python and self.config.checkpoint_interval:
                done = self._in_parts(manager, run, number, todo, count, done)
            else:
                self.frame = self._pruned(self._level_frame(self.frame, todo), all_levels[number + 1 :])
                if manager and not last:
                    self.frame = self._observed(self.frame, todo, lambda f: manager.store(run, number, f))
                elif manager or any(s.external or self.cache and s.cache for s in python):
                    # never persisted beside a cache: appending to the cache would make Spark recompute what was read from it
                    self.frame = self._store(self.frame, number, todo)
                elif python:
                    self.frame = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
                    self.persisted.append(self.frame)
                if python and self.cache:
                    self.frame = self._to_cache(self.frame, python, {n: self.counted[n].misses for n in self.counted})
            if self.config.on_error == "raise" and python:
                self._raise_first(python)
            if manager and not last:
                done = CheckpointData(done.fingerprint, done.steps | {n: marks[n] for n in level}, number, schema=self.frame.schema.json())
                manager.save(run, done)
            self._level_events(todo, count, time.time() - began)
        self.spark.sparkContext.setJobDescription(None)
        if manager:
            if self.config.checkpoint_interval and python:  # the last level's frame lies among the checkpoints
                self.frame = self._store(self.frame, number, [])
            manager.cleanup(run)
        self._progress(len(all_levels), all_levels)
        return PipelineResult(self)

    def _pruned(self, frame: DataFrame, later: list[list[str]]) -> DataFrame:
        """Without the input columns that neither the result nor a later step wants; column steps may want any."""
        keep = set(self.shown)
        for step in (self.pipeline.get_step(n) for level in later for n in level):
            anything = isinstance(step, ColumnStep) or step.reads is None or isinstance(step.run_if, Column) or isinstance(step.skip_if, Column)
            keep |= set(self.inputs if anything else step.reads)
        return frame.select(*(quoted(c) for c in frame.columns if c not in self.inputs or c in keep)) if len(keep) < len(self.inputs) else frame

    def _level_frame(self, frame: DataFrame, todo: list[Any]) -> DataFrame:
        frame = self._column_steps(frame, [s for s in todo if isinstance(s, ColumnStep)])
        python = [s for s in todo if isinstance(s, PythonStep)]
        return self._python_steps(frame, python) if python else frame

    def _in_parts(self, manager: CheckpointManager, run: str, number: int, todo: list[Any], count: int, done: CheckpointData) -> CheckpointData:
        """A level row part by row part, each stored and named when finished, so that a lost run repeats one part's calls at most.

        A part has about ``checkpoint_interval`` rows, more if the level would
        take over MOST_PARTS of them.  Rows are dealt by the hash of their id,
        which is stored first.
        """
        python = [s for s in todo if isinstance(s, PythonStep)]
        parts = done.part_count or min(MOST_PARTS, max(1, -(-count // self.config.checkpoint_interval)))
        base = self.frame
        if done.level < 0:
            base = manager.parts(run, -1, 1, base.schema) if done.part_count else None
            if base is None:
                manager.store_part(run, -1, 0, self.frame)
                base = manager.parts(run, -1, 1, self.frame.schema)
        if not done.part_count:
            manager.begin_parts(run, number)
            done = replace(done, part_count=parts)
            manager.save(run, done)
        schema = None
        for part in range(parts):
            made = self._level_frame(base.where(F.pmod(F.xxhash64(ROW), F.lit(parts)) == part), todo)
            schema = made.schema
            if part in done.parts:
                continue
            manager.store_part(run, number, part, made)
            if self.cache:
                one = self.spark.read.schema(schema).parquet(f"{manager.path(run, number)}/part-{part}")
                self._to_cache(one, python)
            done = replace(done, parts=[*done.parts, part])
            manager.save(run, done)
            log.info("level %d: part %d of %d is stored", number, part + 1, parts)
        self.frame = manager.parts(run, number, parts, schema).drop(*(f"__k_{s.name}" for s in python))
        return done

    def _progress(self, number: int, all_levels: list[list[str]]) -> None:
        """Logs how far the run is, and draws a bar where someone looks."""
        total = len(all_levels)
        if number < total:
            log.info("level %d of %d: %s", number + 1, total, ", ".join(all_levels[number]))
        if self.config.enable_progress_bar and sys.stderr.isatty():
            sys.stderr.write(f"\r[{'#' * number}{'.' * (total - number)}] {number}/{total} levels" + ("\n" if number == total else ""))
            sys.stderr.flush()

    def _prior(self, step: Any) -> dict[str, Column]:
        return {f: F.col(quoted(output(d), "values", f)) for d in step.depends_on for f in self.pipeline.get_step(d).fields}

    def _row(self) -> dict[str, Column]:
        return {c: F.col(quoted(c)) for c in self.inputs}

    def _verdict(self, step: Any) -> Column | None:
        """A predicate given as columns; null counts as false."""
        row, prior = self._row(), self._prior(step)
        if step.run_if is not None:
            return F.coalesce(as_column(step.run_if, row, prior), F.lit(False))
        if step.skip_if is not None:
            return ~F.coalesce(as_column(step.skip_if, row, prior), F.lit(False))
        return None

    def _column_steps(self, frame: DataFrame, steps: list[ColumnStep]) -> DataFrame:
        added = {}
        for s in steps:
            row, prior, verdict = self._row(), self._prior(s), self._verdict(s)
            made = {f: as_column(c, row, prior) for f, c in s.columns.items()}
            if verdict is not None:
                made = {f: F.when(verdict, c).otherwise(F.lit(s.defaults.get(f))) for f, c in made.items()}
            added[output(s.name)] = F.struct(
                F.struct(*(c.alias(f) for f, c in made.items())).alias("values"),
                F.lit(None).cast(ERROR).alias("error"),
                (~verdict if verdict is not None else F.lit(False)).alias("skipped"),
                F.lit(False).alias("from_cache"),
                F.lit(None).cast(USAGE).alias("usage"),
            )
        return frame.withColumns(added) if added else frame

    def _python_steps(self, frame: DataFrame, steps: list[PythonStep]) -> DataFrame:
        if self.config.dedupe:
            for s in steps:
                frame = self._deduplicated(frame, s)
            return frame
        prepared, plans = frame, []
        for s in steps:
            prepared, plan = self._prepare(prepared, s)
            plans.append(plan)
        return self._mapped(prepared, plans)

    def _prepare(self, frame: DataFrame, step: PythonStep) -> tuple[DataFrame, StepPlan]:
        """Adds what a step needs beside the row: its column predicate and its cached answer."""
        verdict = hit = None
        if isinstance(step.run_if, Column) or isinstance(step.skip_if, Column):
            verdict = f"__p_{step.name}"
            frame = frame.withColumn(verdict, self._verdict(step))
        if self.cache and step.cache:
            key, hit = f"__k_{step.name}", f"__h_{step.name}"
            frame = frame.withColumn(key, self._key(frame, step))
            known = self.cache.entries(step.name, keys=frame.select(key)).select(F.col("key").alias(key), F.col("value").alias(hit))
            frame = spread_left_join(frame, known, key, ROW)
        reads = step.reads if step.reads is not None else self.inputs
        prior = [(output(d), self.pipeline.get_step(d).fields) for d in step.depends_on]
        specs = {n: s.as_dict() for n, s in step.specs.items() if not n.startswith("__")}
        if verdict:  # the worker gets the outcome; columns can't travel
            step = copy.copy(step)
            step.run_if = step.skip_if = None
        return frame, StepPlan(step, list(reads), prior, specs, verdict, hit, output(step.name), to_arrow_type(record_type(step)))

    def _key(self, frame: DataFrame, step: PythonStep) -> Column:
        reads = sorted(step.reads if step.reads is not None else self.inputs)
        keep = {"ignoreNullFields": "false"}
        row = F.to_json(F.struct(*(F.col(quoted(c)) for c in reads)), keep) if reads else F.lit("")
        prior = self._prior(step)
        earlier = F.to_json(F.struct(*(prior[f].alias(f) for f in sorted(prior))), keep) if prior else F.lit("")
        defaults = {"temperature": self.config.temperature, "max_tokens": self.config.max_tokens}
        parts = step.key_parts()
        static = canonical_json({**parts, **{k: v for k, v in defaults.items() if k in parts and parts[k] is None}})
        return cache_key(static, row, earlier)

    def _mapped(self, frame: DataFrame, plans: list[StepPlan]) -> DataFrame:
        """Adds the outputs of a level by one Arrow function of the columns that its steps read; the others stay in the JVM."""
        budget = BudgetService.of(self.spark).budget(self.name, self.config.max_workers)
        helpers = [n for p in plans for n in (p.verdict, p.hit) if n]
        needed = [*dict.fromkeys([*(c for p in plans for c in p.reads), *(n for p in plans for n, _ in p.prior)]), *helpers]
        given = F.struct(*(F.col(quoted(c)) for c in needed)) if needed else F.struct(F.lit(True).alias("__none"))
        kind = T.StructType([T.StructField(p.output, record_type(p.step)) for p in plans])
        level = F.arrow_udf(level_function(plans, self.config, budget), kind).asNondeterministic()
        kept = [F.col(quoted(c)) for c in frame.columns if c not in helpers]
        return frame.select(*kept, level(given).alias("__level")).select(*kept, *(F.col(quoted("__level", p.output)).alias(p.output) for p in plans))

    def _deduplicated(self, frame: DataFrame, step: PythonStep) -> DataFrame:
        """One call for all rows that look alike to the step, the answer joined back."""
        key = f"__k_{step.name}"
        keyed = frame.withColumn(key, self._key(frame, step))
        one = keyed.groupBy(key).agg(F.min_by(F.struct(*map(quoted, keyed.drop(key).columns)), ROW).alias("one")).select(key, "one.*")
        if self.cache and step.cache:
            one = one.drop(key)
        prepared, plan = self._prepare(one, step)
        answered = self._mapped(prepared, [plan]).select(key, output(step.name))
        return spread_join(keyed, answered, key, ROW)

    def _to_cache(self, frame: DataFrame, steps: list[PythonStep], counts: dict[str, int] | None = None) -> DataFrame:
        """Adds the fresh answers to the cache; ``counts`` of them by step, where they are known."""
        counts = counts or {}
        for s in steps:
            if s.cache:
                out = F.col(quoted(output(s.name)))
                fresh = frame.where(~out["skipped"] & out["error"].isNull() & ~out["from_cache"])
                value = F.to_json(out["values"], {"ignoreNullFields": "false"})
                self.cache.append(s.name, fresh.select(F.col(quoted(f"__k_{s.name}")).alias("key"), value.alias("value")), count=counts.get(s.name))
        return frame.drop(*(f"__k_{s.name}" for s in steps))

    def _raise_first(self, steps: list[PythonStep]) -> None:
        if all(s.name in self.counted and not self.counted[s.name].failed for s in steps):
            return
        first = errors_of(self.frame, [s.name for s in steps]).orderBy("row_id", "step_name").first()
        if first:
            raise StepError(f"{first.error_type}: {first.message}", first.step_name, first.row_id)

    def _level_events(self, steps: list[Any], count: int, seconds: float) -> None:
        if not self.watching:
            return
        counted = self.counters(steps)
        usage = usage_of(counted, self.config.enable_caching)
        for s in steps:
            out = F.col(quoted(output(s.name)))
            if self.hooks.on_row_complete:
                for r in self.frame.select(ROW, out["values"].alias("v"), out["error"].alias("e"), out["from_cache"].alias("c")).orderBy(ROW).toLocalIterator():
                    values = r.v.asDict(True) if r.v else dict.fromkeys(s.fields)
                    self.hooks.fire("on_row_complete", RowCompleteEvent(s.name, r[ROW], values, r.e.message if r.e else None, r.c))
            self.hooks.fire("on_step_end", StepEndEvent(s.name, count, counted[s.name].failed, usage.get(s.name), seconds))

    def counters(self, steps: list[Any]) -> dict[str, Any]:
        """Each step's counters: those observed, the others by one aggregate over the frame."""
        if missing := [s for s in steps if s.name not in self.counted]:
            found = self.frame.agg(F.struct(*(usage_column(s, self.config.enable_caching) for s in missing)).alias("all")).first()["all"]
            self.counted |= {s.name: found[s.name] for s in missing}
        return {s.name: self.counted[s.name] for s in steps}


def errors_of(frame: DataFrame, names: list[str]) -> DataFrame:
    """row_id, step_name, error_type, message of the rows that failed, in one pass over the frame."""
    each = [F.struct(F.lit(n).alias("step_name"), F.col(quoted(output(n), "error")).alias("error")) for n in names]
    found = frame.select(F.col(ROW).alias("row_id"), F.explode(F.filter(F.array(*each), lambda x: x["error"].isNotNull())).alias("x"))
    return found.select("row_id", "x.step_name", F.col("x.error.type").alias("error_type"), F.col("x.error.message").alias("message"))


def usage_column(step: Any, caching: bool) -> Column:
    """Token sums and counters of a step, as one aggregate named after it."""
    out = F.col(quoted(output(step.name)))
    usage = out["usage"]
    fresh = ~out["skipped"] & out["error"].isNull() & ~out["from_cache"] & F.lit(bool(caching and step.cache))
    sums = [F.coalesce(F.sum(usage[k]), F.lit(0)).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
    counts = [
        F.count_if(usage.isNotNull()).alias("used"), F.count_if(out["skipped"]).alias("skipped"), F.count_if(out["from_cache"]).alias("hits"),
        F.count_if(fresh).alias("misses"), F.count_if(out["error"].isNotNull()).alias("failed"),
        F.min_by(usage["model"], F.when(usage["model"].isNotNull(), F.col(ROW))).alias("model"),
    ]
    return F.struct(*sums, *counts).alias(step.name)


def usage_of(counters: dict[str, Any], caching: bool) -> dict[str, StepUsage]:
    """Reports of the steps that used, skipped or looked up anything."""
    report = {}
    for name, r in counters.items():
        if r.used or r.skipped or r.hits or r.misses:
            processed = r.hits + r.misses if caching else r.used
            report[name] = StepUsage(r.prompt_tokens, r.completion_tokens, r.total_tokens, processed, r.skipped, r.model, r.hits, r.misses)
    return report


class PipelineResult:
    """Data, errors and cost: projections of one stored frame, computed when asked for."""

    def __init__(self, run: _Run | None, form: str = "spark"):
        self._run, self._form = run, run.form if run else form

    @classmethod
    def empty(cls, form: str) -> PipelineResult:
        return cls(None, form)

    @cached_property
    def frame(self) -> DataFrame:
        """The enriched data as a DataFrame."""
        return self.frame_with_row.drop(ROW)

    @cached_property
    def frame_with_row(self) -> DataFrame:
        """The enriched data with its row ids, to match errors with."""
        run = self._run
        pipeline, old = run.pipeline, {f.name: f.dataType for f in run.input_schema.fields}
        writers = last_writers(pipeline.step_names, {n: [f for f in pipeline.get_step(n).fields if not f.startswith("__")] for n in pipeline.step_names})
        more = {getattr(pipeline.get_step(n), "sources_field", None): n for n in pipeline.step_names}
        writers |= {f: n for f, n in more.items() if f}
        columns = []
        for name in run.shown:
            if name in writers:
                new = F.col(quoted(output(writers[name]), "values", name)).cast(old[name])
                columns.append(merged(F.col(quoted(name)), old[name], new, run.config.overwrite_fields).alias(name))
            else:
                columns.append(F.col(quoted(name)))
        columns += [F.col(quoted(output(s), "values", f)).alias(f) for f, s in writers.items() if f not in run.shown]
        return run.frame.select(*columns, ROW)

    @cached_property
    def data(self) -> Any:
        """The enriched data in the input's form."""
        if self._form == "spark":
            return self.frame
        if self._run is None:
            import pandas as pd

            return [] if self._form == "list" else pd.DataFrame()
        ordered = self.frame_with_row.orderBy(ROW).drop(ROW)
        return [r.asDict(True) for r in ordered.collect()] if self._form == "list" else ordered.toPandas()

    @cached_property
    def errors(self) -> DataFrame:
        """row_id, step_name, error_type, message."""
        if self._run is None:
            return SparkSession.active().createDataFrame([], "row_id long, step_name string, error_type string, message string")
        return errors_of(self._run.frame, self._run.pipeline.step_names)

    def close(self) -> None:
        """Frees what the run keeps in memory and in the shared folder; the data must not be read any more."""
        if self._run:
            self._run.close()

    def row_errors(self) -> list[RowError]:
        return [RowError(r.row_id, r.step_name, r.message, r.error_type) for r in self.errors.orderBy("row_id", "step_name").collect()]

    @cached_property
    def cost(self) -> CostSummary:
        if self._run is None:
            return CostSummary()
        run = self._run
        steps = usage_of(run.counters([run.pipeline.get_step(n) for n in run.pipeline.step_names]), run.config.enable_caching)
        total = [sum(getattr(u, k) for u in steps.values()) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
        return CostSummary(*total, steps)

    @property
    def error_count(self) -> int:
        """Errors of all rows and steps."""
        if self._run is None:
            return 0
        pipeline = self._run.pipeline
        return sum(c.failed for c in self._run.counters([pipeline.get_step(n) for n in pipeline.step_names]).values())

    @cached_property
    def _counts(self) -> tuple[int, int, int]:
        """Rows, errors, rows with an error."""
        if self._run is None:
            return 0, 0, 0
        failed = self.errors.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("rows")).first()
        return self._run.frame.count(), failed.n, failed.rows

    @property
    def has_errors(self) -> bool:
        return self._counts[1] > 0

    @property
    def success_rate(self) -> float:
        """1 - errors / rows; several failing steps count each, so it can fall below 0."""
        rows, errors, _ = self._counts
        return 1 - errors / rows if rows else 1.0

    @property
    def row_success_rate(self) -> float:
        rows, _, failed = self._counts
        return 1 - failed / rows if rows else 1.0
