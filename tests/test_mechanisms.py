"""Budget, cache buckets, clean-up, repeated runs, lookups and sessions on small and awkward inputs."""

import asyncio
import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillrow import EnrichmentConfig, FunctionStep, LLMStep, Pipeline, StepError
from quillrow.clients.base import LLMAPIError, LLMResponse
from quillrow.functions.asof import last_before
from quillrow.functions.sessions import sessions
from quillrow.plans.budget import BudgetService, Gate
from quillrow.plans.incremental import IncrementalTable
from quillrow.plans.skew import spread_join, spread_left_join
from quillrow.plans.storage import shared_root
from quillrow.sources.cache import BUCKETS, CacheManager, size_for
from quillrow.streaming import enrich_stream


def peak(calls):
    now = most = 0
    for _, change in sorted([(a, 1) for a, _ in calls] + [(b, -1) for _, b in calls]):
        now += change
        most = max(most, now)
    return most


def waits(kind):
    async def gently(ctx):
        began = time.time()
        await asyncio.sleep(0.03)
        return {"began": began, "ended": time.time()}

    def plainly(ctx):
        began = time.time()
        time.sleep(0.03)
        return {"began": began, "ended": time.time()}

    return gently if kind == "async" else plainly


@pytest.mark.parametrize("kind", ["async", "plain"])
@pytest.mark.parametrize(("parts", "workers"), [(1, 10), (16, 10), (4, 2), (2, 30)])
def test_as_many_calls_as_the_budget_allows(spark, kind, parts, workers):
    step = FunctionStep("s", waits(kind), ["began", "ended"], types={"began": "double", "ended": "double"}, external=True)
    rows = Pipeline([step]).run(spark.range(100).repartition(parts), EnrichmentConfig(max_workers=workers)).data.collect()
    assert peak([(r.began, r.ended) for r in rows]) == workers


def test_steps_of_one_level_share_the_budget(spark):
    steps = [FunctionStep(n, waits("async"), [f"{n}_a", f"{n}_b"]) for n in ("x", "y")]
    for s in steps:
        name, fn = s.name, s.fn

        async def named(ctx, fn=fn, name=name):
            found = await fn(ctx)
            return {f"{name}_a": found["began"], f"{name}_b": found["ended"]}

        s.fn, s.types = named, {f"{name}_a": "double", f"{name}_b": "double"}
    rows = Pipeline(steps).run(spark.range(40).repartition(3), EnrichmentConfig(max_workers=5)).data.collect()
    assert peak([(r[f"{n}_a"], r[f"{n}_b"]) for r in rows for n in ("x", "y")]) == 5


def test_leases_of_a_lost_task_return():
    service = BudgetService("127.0.0.1")
    budget = service.budget("lost", 2)

    async def play():
        dying, other = Gate(budget), Gate(budget)
        await dying.open()
        await other.open()
        await dying.take()
        await dying.take()
        waiting = asyncio.ensure_future(other.take())
        await asyncio.sleep(0.05)
        assert not waiting.done()
        dying.close()
        other.give(await asyncio.wait_for(waiting, 2))
        await other.settle()
        other.close()

    asyncio.run(play())


def test_leases_are_not_kept_by_a_task_that_has_settled():
    budget = BudgetService("127.0.0.1").budget("settled", 1)

    async def play():
        one, two = Gate(budget), Gate(budget)
        await one.open()
        await two.open()
        lease = await one.take()
        late = asyncio.ensure_future(two.take())
        await asyncio.sleep(0.02)
        late.cancel()
        one.give(lease)
        await two.settle()
        await one.settle()
        one.give(await asyncio.wait_for(one.take(), 2))
        await one.settle()
        one.close()
        two.close()

    asyncio.run(play())


def test_a_busy_task_leaves_leases_to_others():
    budget = BudgetService("127.0.0.1").budget("busy", 4)

    async def play():
        one, two = Gate(budget), Gate(budget)
        await one.open()
        await two.open()
        waiting = [asyncio.ensure_future(one.take()) for _ in range(10)]
        one.give(await asyncio.wait_for(waiting[0], 2))
        two.give(await asyncio.wait_for(two.take(), 2))  # while nine calls of the other task wait
        assert one.held == 1
        for w in waiting[1:]:
            one.give(await asyncio.wait_for(w, 2))
        for gate in (one, two):
            await gate.settle()
            assert gate.held == 0
            gate.close()

    asyncio.run(play())


def test_a_pause_holds_all_tasks():
    budget = BudgetService("127.0.0.1").budget("pause", 4)

    async def play():
        one, two = Gate(budget), Gate(budget)
        await one.open()
        await two.open()
        one.give(await one.take())
        one.pause(0.3)
        await asyncio.sleep(0.05)
        began = time.monotonic()
        two.give(await two.take())
        assert time.monotonic() - began > 0.2
        for gate in (one, two):
            await gate.settle()
            gate.close()

    asyncio.run(play())


def test_strangers_get_no_lease():
    service = BudgetService("127.0.0.1")

    async def play():
        gate = Gate(service.budget("r", 1).__class__("127.0.0.1", service.port, "wrong", "r", 1))
        await gate.open()
        with pytest.raises(ConnectionError):
            await asyncio.wait_for(gate.take(), 2)
        gate.close()

    asyncio.run(play())


def test_retry_after_reaches_the_budget(spark):
    class Limited:
        """Refuses the first call of a worker with a retry-after."""

        def __init__(self):
            self.refused = False

        async def complete(self, **options):
            if not self.refused:
                self.refused = True
                raise LLMAPIError("slow down", status_code=429, retry_after=0.2)
            return LLMResponse('{"a": "x"}')

    step = LLMStep("s", {"a": "a"}, client=Limited, reads=["id"])
    result = Pipeline([step]).run(spark.range(6).repartition(2), EnrichmentConfig(retry_base_delay=0.01))
    assert [r.a for r in result.data.collect()] == ["x"] * 6 and not result.has_errors


# clean-up


def folders(spark):
    place = f"{shared_root(spark)}/quillrow".removeprefix("file://")
    return sorted(n for n in os.listdir(place) if n.startswith("run-")) if os.path.isdir(place) else []


def cached_frames(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_closed_runs_leave_nothing(spark):
    before, frames = folders(spark), cached_frames(spark)
    external = FunctionStep("a", lambda ctx: {"x": 1}, ["x"], types={"x": "bigint"}, external=True)
    after = FunctionStep("b", lambda ctx: {"y": ctx.prior_results["x"] + 1}, ["y"], ["a"], types={"y": "bigint"}, external=True)
    plain = FunctionStep("c", lambda ctx: {"z": 1}, ["z"], types={"z": "bigint"})
    for _ in range(3):
        result = Pipeline([external, after, plain]).run(spark.range(4))
        assert [r.y for r in result.data.collect()] == [2] * 4
        new = [f for f in folders(spark) if f not in before]
        assert len(new) == 1 and os.listdir(f"{shared_root(spark)}/quillrow/{new[0]}".removeprefix("file://")) == ["level-1"]
        result.close()
        assert folders(spark) == before and cached_frames(spark) == frames


def test_failed_runs_leave_nothing(spark):
    before, frames = folders(spark), cached_frames(spark)
    steps = [FunctionStep("a", lambda ctx: {"x": "1"}, ["x"], external=True), FunctionStep("b", lambda ctx: 1 / 0, ["y"], ["a"])]
    with pytest.raises(StepError):
        Pipeline(steps).run(spark.range(3), EnrichmentConfig(on_error="raise"))
    assert folders(spark) == before and cached_frames(spark) == frames


def test_streams_leave_nothing(spark, tmp_path):
    for i in range(3):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before, frames, seen = folders(spark), cached_frames(spark), []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for external in (True, False):
        step = FunctionStep("s", lambda ctx: {"x": "1"}, ["x"], external=external)
        enrich_stream(Pipeline([step]), stream, lambda r, n: seen.append(r.data.count()), f"{tmp_path}/checkpoint-{external}").awaitTermination()
    assert seen == [5] * 6 and folders(spark) == before and cached_frames(spark) == frames


def test_counters_come_from_the_storing_job(spark):
    """Cost and error counts of a stored level need no job of their own."""
    from quillrow import EnrichmentHooks

    def shaky(ctx):
        if ctx.row["id"] % 3 == 0:
            raise ValueError("no")
        return {"x": "1"}

    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("counted", "")
    try:
        ends = []
        result = Pipeline([FunctionStep("s", shaky, ["x"], external=True, run_if=lambda row, prior: row["id"] < 8)]).run(spark.range(10), hooks=EnrichmentHooks(on_step_end=ends.append))
        done = jobs()
        assert result.error_count == 3 and result.cost.steps["s"].rows_skipped == 2 and jobs() == done
        assert [(e.num_rows, e.num_errors) for e in ends] == [(10, 3)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Pipeline([FunctionStep("s", shaky, ["x"], external=True)]).run(spark.range(0)).error_count == 0


# the cache


def entries(cache, step="s", **more):
    return sorted((r.key, r.value) for r in cache.entries(step, **more).collect())


def test_cache_buckets_and_generations(spark, tmp_path):
    cache = CacheManager(spark, str(tmp_path), ttl=10)
    rows = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(200)] + [("k0", "v00")], "key string, value string")
    cache.append("s", rows, now=100.0)
    cache.append("s", rows.where("key = 'k7'").withColumn("value", F.lit("new")), now=105.0)
    asked = spark.createDataFrame([("k7",), ("k8",), ("none",), (None,)], "key string")
    assert {r.bucket for r in cache.table("s", cache.buckets(asked.where("key is not null"))).select("bucket").distinct().collect()} <= set(range(BUCKETS))
    found = dict(entries(cache, now=106.0, keys=asked))
    assert found["k7"] == "new" and found["k8"] == "v8" and "none" not in found and len(found) < 60
    assert cache.cleanup_expired(now=112.0) == 200
    assert entries(cache, now=112.0) == [("k7", "new")]
    assert os.listdir(tmp_path / "step=s") == ["gen-1"] or sorted(x for x in os.listdir(tmp_path / "step=s") if not x.startswith(".")) == ["gen-1"]


def test_a_lookup_of_few_keys_leaves_files_of_a_large_cache_out(spark, tmp_path):
    cache = CacheManager(spark, str(tmp_path), ttl=0)
    rows = spark.range(70_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("value"))
    cache.append("s", rows)
    asked = rows.where("value % 109 = 0")
    cache.compact("s", lookups=asked.select("key"))
    all_files = len(cache.table("s").inputFiles())
    assert cache.table("s", cache.buckets(asked.select("key"), "s")).select(F.input_file_name()).distinct().count() < all_files
    # an append of another size beside it: every key is found, the newest value counts
    cache.append("s", asked.where("value < 1000").withColumn("value", F.concat("value", F.lit(" new"))))
    key = rows.where("value = 109").first().key
    assert cache.get("s", key) == "109 new"
    found = cache.entries("s", keys=asked.select("key")).join(asked.withColumnRenamed("value", "asked"), "key")
    assert found.count() == 643 and found.where("value <> asked").count() == 10
    cache.compact("s")
    assert cache.table("s").count() == 70_000 and len(cache.table("s").inputFiles()) == BUCKETS
    assert cache.get("s", key) == "109 new" and cache.table("s", []).count() == 0
    assert size_for(70_000) == 64 and size_for(64 * 65_536 + 1) == 128 and size_for(1, 643) == 256


def test_the_buckets_of_a_large_batch_are_told_by_its_first_keys(spark, tmp_path):
    cache = CacheManager(spark, str(tmp_path), ttl=0)
    seen = spark.sparkContext.accumulator(0)

    def noted(key):
        seen.add(1)
        return key

    key = F.udf(noted, "string")(F.col("id").cast("string"))
    assert cache.buckets(spark.range(0, 40_000, 1, 8).select(key.alias("key"))) == list(range(BUCKETS))
    assert seen.value < 20_000
    # a batch whose first keys are one and the same is gone through to its end
    same = F.when(F.col("id") < 39_000, F.lit("one")).otherwise(F.col("id").cast("string"))
    assert cache.buckets(spark.range(0, 40_000, 1, 8).select(same.alias("key"))) == list(range(BUCKETS))
    assert len(cache.buckets(spark.range(30).select(F.col("id").cast("string").alias("key")))) < 31


def test_a_run_without_fresh_answers_adds_no_files(spark, tmp_path):
    config = EnrichmentConfig(enable_caching=True, cache_dir=str(tmp_path))
    pipeline = Pipeline([FunctionStep("s", lambda ctx: {"x": str(ctx.row["id"])}, ["x"], reads=["id"])])
    pipeline.run(spark.range(200), config)
    before = {(f, os.stat(f).st_mtime_ns) for f in map(str, tmp_path.rglob("*"))}
    assert pipeline.run(spark.range(200), config).cost.steps["s"].cache_hits == 200
    assert {(f, os.stat(f).st_mtime_ns) for f in map(str, tmp_path.rglob("*"))} == before


def test_a_lost_compaction_leaves_the_table(spark, tmp_path):
    cache = CacheManager(spark, str(tmp_path), ttl=0)
    cache.set("s", "a", "1")
    os.makedirs(tmp_path / "step=s" / "gen-1" / "bucket=0")  # a job that never ended: no success marker
    assert entries(cache) == [("a", "1")] and cache.get("s", "a") == "1" and cache.get("s", "b") is None
    cache.set("s", "b", "2")
    cache.compact("s")
    assert entries(cache) == [("a", "1"), ("b", "2")] and cache.delete_step("s") == 2 and cache.get("s", "a") is None


def test_rows_that_look_alike_share_a_cached_answer(spark, tmp_path):
    config = EnrichmentConfig(enable_caching=True, cache_dir=str(tmp_path))
    pipeline = Pipeline([FunctionStep("s", lambda ctx: {"x": str(ctx.row["k"])}, ["x"], reads=["k"])])
    rows = spark.range(300).select("id", F.lit(1).alias("k")).unionByName(spark.range(5).select("id", F.lit(None).cast("int").alias("k")))
    assert pipeline.run(rows, config).cost.steps["s"].cache_misses == 305
    again = pipeline.run(rows, config)
    assert again.cost.steps["s"].cache_hits == 305 and again.data.groupBy("x").count().count() == 2


# repeated runs


def test_incremental_runs(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def call(ctx):
        calls.add(1)
        if ctx.row["v"] == "bad":
            raise ValueError("bad")
        return {"out": f"{ctx.row['v']}!"}

    table = IncrementalTable(Pipeline([FunctionStep("s", call, ["out"], reads=["v"])]), str(tmp_path / "answers"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string, note string")
    first = table.run(frame([(1, "a", "x"), (2, "b", "x"), (None, "a", "y"), (3, None, "x"), (4, "bad", "x")]))
    assert (first.called, first.reused, first.forgotten, first.errors.count()) == (5, 0, 0, 1)
    second = table.run(frame([(1, "a", "changed"), (2, "c", "x"), (5, None, "x"), (4, "bad", "x"), (6, "a", "z"), (6, "a", "z")]))
    assert (second.called, second.reused, second.forgotten) == (2, 4, 1)
    got = sorted(((r.id, r.v, r.note, r.out) for r in second.data.collect()), key=str)
    assert got == sorted([(1, "a", "changed", "a!"), (2, "c", "x", "c!"), (5, None, "x", "None!"), (4, "bad", "x", None), (6, "a", "z", "a!"), (6, "a", "z", "a!")], key=str)
    none = table.run(frame([]))
    assert (none.called, none.reused, none.forgotten, none.data.count()) == (0, 0, 3, 0)


def test_incremental_runs_follow_the_steps(spark, tmp_path):
    rows = spark.range(3)
    for version, called in (("1", 3), ("1", 0), ("2", 3)):
        step = FunctionStep("s", lambda ctx, v=version: {"out": v}, ["out"], reads=["id"], cache_version=version)
        result = IncrementalTable(Pipeline([step]), str(tmp_path / "answers")).run(rows)
        assert result.called == called and {r.out for r in result.data.collect()} == {version}


# lookups and sessions


def day(n, seconds=0.0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=seconds)


@pytest.mark.parametrize("bucket", [3600, 86_400, 10**9])
def test_last_before_against_brute_force(spark, bucket):
    rows = [(i, k, day(d, s), 7) for i, (k, d, s) in enumerate([("a", 0, 0), ("a", 0, 5), ("a", 3, 0), ("a", 30, 1), ("b", 1, 0), ("c", 1, 0), (None, 1, 0), ("a", 0, 5)])] + [(99, "a", None, 7)]
    past = [("a", day(0, 5), 1, "x"), ("a", day(0, 5), 2, None), ("a", day(2, 86_399.5), 3, "y"), ("a", day(9), 4, "z"), ("b", day(1), 5, "w"), ("b", day(2), 6, "w"), (None, day(0), 7, "n"), ("c", None, 8, "n")]
    left = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, __at int")
    right = spark.createDataFrame(past, "k string, t timestamp_ntz, n int, v string")
    found = {r.id: (r.n, r.v) for r in last_before(left, right, ("k", "k"), ("t", "t"), ["n", "v"], bucket=bucket, order="n").collect()}

    def brute(k, t):
        hits = [(pt, n, v) for pk, pt, n, v in past if k is not None and pk == k and t is not None and pt is not None and pt <= t]
        return max(hits, key=lambda x: x[:2])[1:] if hits else (None, None)

    assert found == {i: brute(k, t) for i, k, t, _ in rows}
    aged = {r.id: r.n for r in last_before(left, right, ("k", "k"), ("t", "t"), ["n"], bucket=bucket, within=3600, order="n").collect()}
    assert aged[1] == 2 and aged[2] == 3 and aged[3] is None


def test_last_before_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, "a", day(0))], "id long, k string, t timestamp"), spark.createDataFrame([], "k string, t timestamp, n int")
    assert [tuple(r)[-1] for r in last_before(left, right, ("k", "k"), ("t", "t"), ["n"]).collect()] == [None]
    assert last_before(left.limit(0), right, ("k", "k"), ("t", "t"), ["n"]).count() == 0


def test_a_changed_row_with_another_rows_old_values_is_called_for(spark, tmp_path):
    path, runs = str(tmp_path / "answers"), []
    for day, rows in (("one", [(1, 5), (2, 6), (3, 9)]), ("two", [(1, 6), (2, 7), (3, 9)])):
        step = FunctionStep("s", lambda ctx, day=day: {"out": f"{day} {ctx.row['v']}"}, ["out"], reads=["v"])
        runs.append(IncrementalTable(Pipeline([step]), path, ["id"]).run(spark.createDataFrame(rows, "id int, v int")))
    assert sorted(r.out for r in runs[1].data.collect()) == ["one 9", "two 6", "two 7"]
    assert [(r.called, r.reused, r.forgotten) for r in runs] == [(3, 0, 0), (2, 1, 2)]


@pytest.mark.parametrize("join", [spread_join, spread_left_join])
def test_lookups_send_no_keys_through_the_driver(spark, tmp_path, join):
    spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("key")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = join(rows, rows.where("id < 10").select("key", F.col("id").alias("known")), "key", "id")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.known for r in found.where("known is not null").collect()) == list(range(10))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_sessions_are_cut_at_gaps_and_at_their_bound(spark):
    rows = [("a", day(0, s), i) for i, s in enumerate([0, 10, 70, 71, 72, 73, 74])] + [("b", day(0), 1), ("b", day(0), 0), (None, day(0), 5), ("c", None, 1)]
    found = sessions(spark.createDataFrame(rows, "k string, t timestamp_ntz, n int"), "k", "t", 60, ["n"], order="n", most=3)
    got = {(r.k, r.began, r.part): [x.n for x in r.rows] for r in found.collect()}
    assert got == {("a", day(0), 0): [0, 1], ("a", day(0, 70), 0): [2, 3, 4], ("a", day(0, 70), 1): [5, 6], ("b", day(0), 0): [0, 1], (None, day(0), 0): [5]}


def test_budget_serves_several_threads(spark):
    """Runs started from different threads have a budget each."""
    found = {}

    def one(name):
        step = FunctionStep("s", waits("async"), ["began", "ended"], types={"began": "double", "ended": "double"}, external=True)
        found[name] = Pipeline([step]).run(spark.range(20).repartition(2), EnrichmentConfig(max_workers=3)).data.collect()

    threads = [threading.Thread(target=one, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert [peak([(r.began, r.ended) for r in rows]) for rows in found.values()] == [3, 3]
