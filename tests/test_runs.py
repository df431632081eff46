"""Runs: call counts, errors, caches, hooks, inputs."""

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from quillrow import (
    CacheManager, CheckpointManager, ColumnStep, EnrichmentConfig, EnrichmentHooks, EnrichmentResult, FunctionStep, LLMStep, Pipeline, PipelineError,
    StepContext, StepError, StepResult,
)
from quillrow.clients.base import LLMAPIError, LLMResponse
from quillrow.providers import RuleClient


@pytest.fixture
def calls(tmp_path):
    """A function that notes each call in a file, and a count of the notes."""
    note = str(tmp_path / "calls")
    open(note, "w").close()

    def count() -> int:
        with open(note) as file:
            return len(file.read().split())

    def f(ctx):
        with open(note, "a") as file:
            file.write("x\n")
        return {"y": ctx.row["x"] * 2}

    return f, count


def numbers(spark, n=10):
    return spark.range(n).select(F.col("id").cast("int").alias("x"))


def doubled(f, **more):
    return FunctionStep("double", f, ["y"], types={"y": "int"}, **more)


@pytest.mark.parametrize("external", [False, True])
def test_each_row_is_called_once_however_results_are_read(spark, calls, external):
    f, count = calls
    result = Pipeline([doubled(f, external=external)]).run(numbers(spark))
    assert result.data.count() == 10 and result.errors.count() == 0 and result.cost.total_tokens == 0
    assert result.data.alias("a").join(result.data.alias("b"), "x").count() == 10
    assert count() == 10


@pytest.mark.parametrize("as_column", [True, False])
def test_skipped_rows_are_not_called(spark, calls, as_column):
    f, count = calls
    predicate = F.col("x") < 4 if as_column else lambda row, prior: row["x"] < 4
    result = Pipeline([doubled(f, run_if=predicate)]).run(numbers(spark))
    assert {(r.x, r.y) for r in result.data.collect()} == {(i, 2 * i if i < 4 else None) for i in range(10)}
    assert count() == 4


def test_deduplicated_calls(spark, calls):
    f, count = calls
    twice = numbers(spark).union(numbers(spark))
    result = Pipeline([doubled(f, external=True)]).run(twice, EnrichmentConfig(dedupe=True))
    assert sorted((r.x, r.y) for r in result.data.collect()) == sorted((i, 2 * i) for i in [*range(10), *range(10)])
    assert count() == 10


def test_cache_saves_calls_and_forgets_failures(spark, calls, tmp_path):
    f, count = calls
    config = EnrichmentConfig(enable_caching=True, cache_dir=f"file://{tmp_path}/cache")

    def fails_on_three(ctx):
        out = f(ctx)
        if ctx.row["x"] == 3:
            raise ValueError("three")
        return out

    pipeline = Pipeline([doubled(fails_on_three)])
    first, second = pipeline.run(numbers(spark), config), pipeline.run(numbers(spark, 12), config)
    assert (first.cost.steps["double"].cache_misses, first.cost.steps["double"].cache_hits) == (9, 0)
    assert (second.cost.steps["double"].cache_misses, second.cost.steps["double"].cache_hits) == (2, 9)
    assert second.cost.steps["double"].cache_hit_rate == 9 / 11
    assert count() == 10 + 3
    assert sorted(r.y for r in second.data.collect() if r.y is not None) == [2 * i for i in range(12) if i != 3]
    assert pipeline.clear_cache(spark, cache_dir=config.cache_dir) == 11


def test_cache_table(spark, tmp_path):
    cache = CacheManager(spark, f"file://{tmp_path}/cache", ttl=0)
    cache.set("s", "k", "1")
    cache.set("s", "k", "2")
    assert cache.get("s", "k") == "2" and cache.get("s", "zz") is None and cache.get("none", "k") is None
    assert cache.delete_step("s") == 1 and cache.delete_all() == 0


def test_errors_and_rates(spark):
    def f(ctx):
        if ctx.row["x"] in (2, 5):
            raise KeyError(ctx.row["x"])
        return {"y": 1}

    steps = [doubled(f), FunctionStep("other", f, ["z"], types={"z": "int"})]
    result = Pipeline(steps).run([{"x": i} for i in range(10)], spark=spark)
    assert [(e.row_index, e.step_name, e.error_type) for e in result.row_errors()] == [(2, "double", "KeyError"), (2, "other", "KeyError"), (5, "double", "KeyError"), (5, "other", "KeyError")]
    assert result.has_errors and result.success_rate == 0.6 and result.row_success_rate == 0.8


def test_raise_names_the_lowest_row(spark):
    def f(ctx):
        raise ValueError(f"row {ctx.row['x']}")

    with pytest.raises(StepError) as caught:
        Pipeline([doubled(f)]).run([{"x": 4}, {"x": 1}], EnrichmentConfig(on_error="raise"), spark=spark)
    assert caught.value.row_index == 0 and caught.value.step_name == "double" and "row 4" in str(caught.value)


def test_lists_and_pandas_keep_form_and_order(spark):
    import pandas as pd

    pipeline = Pipeline([ColumnStep("s", {"x": lambda row, prior: row["x"] + 1, "__in": F.lit(1)})])
    assert pipeline.run([{"x": 3}, {"x": 1}, {"x": 2}], spark=spark).data == [{"x": 4}, {"x": 2}, {"x": 3}]
    frame = pd.DataFrame({"x": [3, 1]}, index=[7, 7])
    kept = pipeline.run(frame, spark=spark).data
    assert kept["x"].tolist() == [3, 1] and frame["x"].tolist() == [3, 1]
    assert pipeline.run(frame, EnrichmentConfig(overwrite_fields=True), spark=spark).data["x"].tolist() == [4, 2]
    empty = pipeline.run([], spark=spark)
    assert empty.data == [] and empty.success_rate == 1.0 and empty.cost.total_tokens == 0


def test_empty_frame(spark):
    assert Pipeline([doubled(lambda ctx: {"y": 1})]).run(numbers(spark, 0)).data.collect() == []


def test_async_steps_wait_together(spark):
    import time

    async def slow(ctx):
        await asyncio.sleep(0.05)
        return {"y": ctx.row["x"]}

    began = time.time()
    result = Pipeline([doubled(slow)]).run(numbers(spark, 80).coalesce(1), EnrichmentConfig(max_workers=80))
    assert result.data.count() == 80 and time.time() - began < 3.5


def test_custom_step_and_run_async(spark):
    class Mine:
        name, fields, depends_on, types = "mine", ["y"], [], {"y": "int"}

        async def run(self, ctx: StepContext) -> StepResult:
            return StepResult({"y": ctx.row["x"] + ctx.config.max_workers, "other": 1})

    result = asyncio.run(Pipeline([Mine()]).run_async(numbers(spark, 2), EnrichmentConfig(max_workers=7)))
    assert sorted(r.y for r in result.data.collect()) == [7, 8]


def test_hooks(spark):
    seen = []

    def broken(event):
        seen.append("broken")
        raise ValueError

    async def ended(event):
        seen.append(("end", event.num_rows, event.total_errors))

    hooks = EnrichmentHooks(
        on_pipeline_start=broken, on_pipeline_end=ended, on_step_start=lambda e: seen.append(("start", e.step_name)),
        on_row_complete=lambda e: seen.append((e.row_index, e.values, e.error)), on_step_end=lambda e: seen.append(("done", e.step_name, e.num_errors)),
    )

    def f(ctx):
        if ctx.row["x"]:
            raise ValueError("no")
        return {"y": 5}

    Pipeline([doubled(f)]).run([{"x": 0}, {"x": 1}], hooks=hooks, spark=spark)
    assert seen == ["broken", ("start", "double"), (0, {"y": 5}, None), (1, {"y": None}, "no"), ("done", "double", 1), ("end", 2, 1)]


def test_runner_overwrites_on_request(spark):
    runner = Pipeline([ColumnStep("s", {"x": F.lit(9)})]).runner()
    assert {r.x for r in runner.run(numbers(spark, 3)).collect()} == {0, 1, 2}
    assert {r.x for r in runner.run(numbers(spark, 3), overwrite_fields=True).collect()} == {9}


def checkpointed(folder, **more):
    return EnrichmentConfig(enable_checkpointing=True, checkpoint_dir=f"file://{folder}/ck", on_error="raise", **more)


def broken():
    def fails(ctx):
        raise ValueError("not yet")

    return fails


def later(f=lambda ctx: {"z": ctx.prior_results["y"] + 1}, **more):
    return FunctionStep("later", f, ["z"], ["double"], types={"z": "int"}, **more)


def test_checkpoint_skips_finished_levels(spark, calls, tmp_path):
    f, count = calls
    config = checkpointed(tmp_path)
    with pytest.raises(StepError):
        Pipeline([doubled(f), later(broken())]).run(numbers(spark), config)
    assert count() == 10
    done = Pipeline([doubled(f), later()]).run(numbers(spark), config)
    assert sorted(r.z for r in done.data.collect()) == [2 * i + 1 for i in range(10)]
    assert count() == 10


def test_checkpoint_goes_when_a_run_succeeds(spark, calls, tmp_path):
    f, count = calls
    config = checkpointed(tmp_path)
    pipeline = Pipeline([doubled(f), later()])
    for turn in (1, 2):
        assert sorted(r.z for r in pipeline.run(numbers(spark), config).data.collect()) == [2 * i + 1 for i in range(10)]
        assert count() == 10 * turn and CheckpointManager(spark, config.checkpoint_dir).list_checkpoints() == []


@pytest.mark.parametrize("identifier", [None, "same"])
def test_checkpoint_of_other_rows_is_left_alone(spark, calls, tmp_path, identifier):
    f, count = calls
    config = checkpointed(tmp_path)
    with pytest.raises(StepError):
        Pipeline([doubled(f), later(broken())]).run(numbers(spark), config, data_identifier=identifier)
    other = numbers(spark).select((F.col("x") + 100).alias("x"))
    done = Pipeline([doubled(f), later()]).run(other, config, data_identifier=identifier)
    assert sorted(r.z for r in done.data.collect()) == [2 * i + 201 for i in range(10)] and count() == 20


def test_checkpoint_of_another_version_is_left_alone(spark, calls, tmp_path):
    f, count = calls
    config = checkpointed(tmp_path)
    with pytest.raises(StepError):
        Pipeline([doubled(f, cache_version="1"), later(broken())]).run(numbers(spark), config, data_identifier="same")
    Pipeline([doubled(f, cache_version="2"), later()]).run(numbers(spark), config, data_identifier="same").data.collect()
    assert count() == 20
    with pytest.raises(StepError):
        Pipeline([doubled(f), later(broken())]).run(numbers(spark), config)
    Pipeline([doubled(f), later()]).run(numbers(spark), config.but(auto_resume=False)).data.collect()
    assert count() == 40


@pytest.mark.parametrize("caching", [False, True])
def test_a_lost_job_repeats_one_part(spark, calls, tmp_path, caching):
    """A worker dies in the middle of a level; what was stored before is not called again."""
    f, count = calls
    config = checkpointed(tmp_path, checkpoint_interval=10, enable_caching=caching, cache_dir=f"file://{tmp_path}/cache")
    many = numbers(spark, 100)

    def dies(ctx):
        if count() >= 40:
            raise SystemExit  # takes the worker along, and with it the job
        return f(ctx)

    with pytest.raises(Exception, match="."):
        Pipeline([doubled(dies)]).run(many, config)
    before = count()
    assert before >= 40
    done = Pipeline([doubled(f)]).run(many, config)
    assert sorted((r.x, r.y) for r in done.data.collect()) == [(i, 2 * i) for i in range(100)]
    assert "__k_double" not in done.data.columns and 60 <= count() - before < 80  # 100 less whole parts stored
    assert CheckpointManager(spark, config.checkpoint_dir).list_checkpoints() == []


def test_parts_of_two_levels(spark, calls, tmp_path):
    f, count = calls
    config = checkpointed(tmp_path, checkpoint_interval=7)
    done = Pipeline([doubled(f), later()]).run(numbers(spark, 50), config)
    assert sorted((r.x, r.y, r.z) for r in done.data.collect()) == [(i, 2 * i, 2 * i + 1) for i in range(50)] and count() == 50


def test_only_wanted_columns_are_read(spark, tmp_path):
    wide = spark.range(20).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("c"), F.lit("y").alias("d"))
    wide.write.parquet(f"{tmp_path}/wide")
    step = FunctionStep("s", lambda ctx: {"e": ctx.row["b"] + 1}, ["e"], types={"e": "bigint"}, reads=["b"])
    result = Pipeline([step]).run(spark.read.parquet(f"{tmp_path}/wide"), columns=["a"])
    plan = result.data._jdf.queryExecution().toString()
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan
    assert sorted(map(tuple, result.data.collect())) == [(i, 2 * i + 1) for i in range(20)]
    result.close()
    with pytest.raises(PipelineError):
        Pipeline([step]).run(wide, columns=["zz"])


class Scripted:
    """A client that goes through a list of answers and failures, anew for each row."""

    def __init__(self, script):
        self.script, self.turn, self.seen = script, 0, []

    async def complete(self, messages, model, temperature, max_tokens, response_format=None):
        self.seen.append([m["role"] for m in messages])
        answer = self.script[self.turn]
        self.turn += 1
        if isinstance(answer, Exception):
            raise answer
        return LLMResponse(answer)


def run_step(step, config):
    return asyncio.run(step.run(StepContext({"x": 1}, {}, {}, config)))


def test_model_step_corrects_and_retries():
    quick = EnrichmentConfig(retry_base_delay=0, max_retries=1)
    client = Scripted([LLMAPIError("busy", 429), "no json", json.dumps({"a": "ok", "b": 1})])
    done = run_step(LLMStep("s", {"a": "x"}, client=client), quick)
    assert done.values == {"a": "ok"} and done.metadata["attempts"] == 2
    assert client.seen == [["system", "user"], ["system", "user"], ["system", "user", "assistant", "user"]]
    with pytest.raises(StepError, match="no usable answer after 2"):
        run_step(LLMStep("s", {"a": "x"}, client=Scripted(["x", "y"]), max_retries=1), quick)
    with pytest.raises(StepError, match="can't be reached"):
        run_step(LLMStep("s", {"a": "x"}, client=Scripted([LLMAPIError("down", 500)] * 2)), quick)
    with pytest.raises(StepError, match="takes no tools"):
        run_step(LLMStep("s", {"a": "x"}, client=Scripted(["{}"]), grounding=True), quick)


class Strict:
    """Like a model class of a validation library."""

    def __init__(self, a):
        self.a = a

    @classmethod
    def model_validate(cls, answer):
        if not isinstance(answer["a"], int):
            raise ValueError("a is a whole number")
        return cls(answer["a"] + 1)

    def model_dump(self):
        return {"a": self.a, "more": 1}


def test_schemas_check_and_give_the_values():
    quick = EnrichmentConfig(retry_base_delay=0, max_retries=0)
    answers = [json.dumps({"a": "x"}), json.dumps({"a": 41})]
    assert run_step(LLMStep("s", ["a"], client=Scripted(answers), schema=Strict), quick).values == {"a": 42}
    assert run_step(LLMStep("s", ["a"], client=Scripted(answers), schema=lambda x: {"a": x["a"] * 2}), quick).values == {"a": "xx"}
    assert run_step(LLMStep("s", ["a"], client=Scripted(answers), schema=lambda x: None), quick).values == {"a": "x"}
    assert run_step(LLMStep("s", ["a"], client=Scripted(['{"a": 1, "b": 2}']), schema=EnrichmentResult), quick).values == {"a": 1}
    with pytest.raises(StepError, match="no usable answer after 1"):
        run_step(LLMStep("s", ["a"], client=Scripted(answers), schema=Strict, max_retries=0), quick)
    refused = LLMStep("s", {"a": {"prompt": "a", "default": "none"}}, client=Scripted([json.dumps({"a": "N/A"})]), schema=EnrichmentResult)
    assert run_step(refused, quick).values == {"a": "none"}


def test_model_cost_counts_answers_kept(spark):
    step = LLMStep("s", {"y": "x"}, client=lambda: RuleClient(lambda row, prior: {"y": "a b"}), model="m")
    cost = Pipeline([step]).run(numbers(spark, 5)).cost
    assert (cost.total_prompt_tokens, cost.total_completion_tokens, cost.steps["s"].model, cost.steps["s"].rows_processed) == (10, 15, "m", 5)


def test_filter_goes_below_python_steps(spark, calls):
    f, count = calls
    assert Pipeline([doubled(f)]).run(numbers(spark), where=F.col("x") > 7).data.count() == 2
    assert count() == 2


def test_layouts_of_calls_in_flight_run_side_by_side(spark, monkeypatch):
    import threading

    from quillrow import catalogue_runs

    together, plain = threading.Barrier(3, timeout=60), Pipeline.run

    def run(self, *given, **more):
        together.wait()  # breaks unless all three are under way
        return plain(self, *given, **more)

    monkeypatch.setattr(catalogue_runs.Pipeline, "run", run)
    assert all(r.within for r in catalogue_runs.calls_in_flight(spark, "/root/testdata/sf0.001").collect())
