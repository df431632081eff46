"""Streams that remember answers in their state."""

import datetime as dt
import os
import time

import pytest

from quillrow import ColumnStep, EnrichmentConfig, FunctionStep, PipelineError
from quillrow.streaming.memory import remembered

DAY = dt.datetime(2024, 1, 1)
KIND = "id bigint, who string, at timestamp, `made` string, `row` string"


def at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def run(spark, folder, step, batches, delay="0 seconds"):
    os.makedirs(f"{folder}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = remembered(stream, step, ["who"], "at", 3600, delay)
    for rows in batches:
        spark.createDataFrame([(i, who, at(h), "m", "r") for i, who, h in rows], KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)
        query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(made.schema).parquet(f"{folder}/out").collect()
    return {r["id"]: r for r in found}, len(found)


def test_answers_live_as_long_as_their_stretch(spark, tmp_path):
    def ask(ctx):
        return {"answer": f"{ctx.row['who']} {time.time_ns()}", "n": 2**60 + 1}

    step = FunctionStep("ask", ask, ["answer", "n"], types={"n": "bigint"})
    batches = [
        [(1, "a", 0.1), (2, "a", 0.9), (3, "b", 0.5), (4, None, 0.5)],
        [(5, "a", 0.2), (6, "a", 1.5), (7, None, 0.6)],  # nothing is over yet: the watermark stands at 0.9
        [(8, "a", 0.3), (9, "a", 1.1), (10, "a", None), (11, "a", None)],  # it stands at 1.5: the first hour is over
        [],
    ]
    found, n = run(spark, str(tmp_path), step, batches[:3])
    assert n == len(found) == 11
    same = lambda *ids: len({found[i]["answer"] for i in ids}) == 1
    assert same(1, 2, 5) and same(4, 7) and same(6, 9)
    assert len({found[i]["answer"] for i in (1, 3, 4, 6, 10, 11)}) == 6
    assert [i for i in found if found[i]["late"]] == [8]
    assert found[8]["answer"] is None and found[8]["error"] is None and not found[8]["from_memory"]
    assert sum(r["from_memory"] for r in found.values()) == 4  # 2 or 1, 5, 7, 9
    assert {r["n"] for r in found.values() if not r["late"]} == {2**60 + 1}
    assert {(r["made"], r["row"]) for r in found.values()} == {("m", "r")}
    assert found[6]["at"] == at(1.5) and found[10]["at"] is None


def test_failures_and_skipped_rows_are_not_remembered(spark, tmp_path):
    def ask(ctx):
        if ctx.row["id"] == 1:
            raise ValueError("not now")
        return {"answer": str(ctx.row["id"])}

    step = FunctionStep("ask", ask, {"answer": {"prompt": "p", "default": "none"}}, reads=["id", "who"], skip_if=lambda row, prior: row["id"] == 2)
    found, _ = run(spark, str(tmp_path), step, [[(1, "a", 0.1)], [(2, "a", 0.2)], [(3, "a", 0.3)], [(4, "a", 0.4)]])
    assert found[1]["answer"] is None and found[1]["error"]["message"] == "not now"
    assert found[2]["answer"] == "none" and not found[2]["from_memory"]
    assert found[3]["answer"] == "3" and not found[3]["from_memory"]
    assert found[4]["answer"] == "3" and found[4]["from_memory"]


def test_async_steps_and_a_delay_that_keeps_rows_from_being_late(spark, tmp_path):
    async def ask(ctx):
        return {"answer": f"{ctx.row['who']} {time.time_ns()}"}

    found, _ = run(spark, str(tmp_path), FunctionStep("ask", ask, ["answer"]), [[(1, "a", 0.5)], [(2, "a", 2.5)], [(3, "a", 0.6)]], "3 hours")
    assert found[3]["answer"] == found[1]["answer"] != found[2]["answer"]
    assert not any(r["late"] for r in found.values())


def test_refusals(spark, tmp_path):
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path))
    plain = FunctionStep("ask", lambda ctx: {}, ["answer"])
    with pytest.raises(PipelineError):
        remembered(stream, ColumnStep("c", {"x": stream["id"]}), ["who"], "at", 60, "0 seconds")
    with pytest.raises(PipelineError):
        remembered(stream, FunctionStep("ask", lambda ctx: {}, ["made"]), ["who"], "at", 60, "0 seconds")
    for key, seconds in (([], 60), (["who"], 0), (["nobody"], 60)):
        with pytest.raises(PipelineError):
            remembered(stream, plain, key, "at", seconds, "0 seconds")
    with pytest.raises(PipelineError):
        remembered(stream, FunctionStep("ask", lambda ctx: {}, ["answer"], run_if=stream["id"] > 1), ["who"], "at", 60, "0 seconds")


def test_rows_that_find_the_answer_share_its_record(monkeypatch):
    import types

    from pyspark.sql import Row

    from quillrow.streaming import memory

    asked, plain = [], memory.one_row
    monkeypatch.setattr(memory, "one_row", lambda *given: asked.append(given) or plain(*given))
    kept = []
    state = types.SimpleNamespace(get=lambda: kept[-1], exists=lambda: bool(kept), update=kept.append)
    handle = types.SimpleNamespace(getValueState=lambda *given: state, registerTimer=lambda at: None)
    one = memory._Memory(FunctionStep("s", lambda ctx: {"out": "x"}, ["out"], reads=["k"]), ["k"], EnrichmentConfig())
    one.init(handle)
    rows = [Row(row=Row(k=1, n=i)) for i in range(50)]
    got = list(one.handleInputRows((1, 10), iter(rows), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    one.close()
    assert [r.row.n for r in got] == list(range(50)) and [r.made["from_cache"] for r in got] == [False] + [True] * 49
    assert {r.made["values"]["out"] for r in got} == {"x"} and len(asked) == 2


def test_a_buckets_keys_share_their_messages_to_the_state(monkeypatch):
    import types

    from pyspark.sql import Row

    from quillrow.streaming import memory

    said, lists = [], {}

    def told(name, do=lambda *given: None):
        return lambda *given: said.append(name) or do(*given)

    entries = lists.setdefault("answers", [])
    state = types.SimpleNamespace(exists=told("exists", lambda: bool(entries)), get=told("get", lambda: iter(entries)), appendValue=told("append", entries.append))
    handle = types.SimpleNamespace(getListState=lambda *given: state, registerTimer=told("timer"))
    step = FunctionStep("s", lambda ctx: {"out": f"{ctx.row['k']} {time.time_ns()}"}, ["out"], reads=["k"])
    early, past = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 10)

    def batch(ends, keys, now=early):
        said.clear()
        one = memory._Memories(step, ["k"], EnrichmentConfig())
        one.init(handle)
        got = list(one.handleInputRows((7, ends), iter([Row(row={"k": k}, mark=f'["{k}"]') for k in keys]), now))
        one.close()
        return [r.made["values"] and r.made["values"]["out"] for r in got], [r.made["from_cache"] for r in got], [r.late for r in got]

    first, known, _ = batch(10, [*range(100), *range(100), *range(100)])
    assert said == ["exists", "append", "timer"] and known == [False] * 100 + [True] * 200
    assert first[:100] == first[100:200] == first[200:] and len(set(first)) == 100
    again, known, _ = batch(10, [3, 200, 200, 3])
    assert said == ["exists", "get", "append"] and known == [True, False, True, True]
    assert again[0] == again[3] == first[3] and again[1] == again[2]
    assert batch(10, [200, 3])[0] == [again[1], first[3]] and said == ["exists", "get"]
    assert batch(10, [3, 4], past) == ([None, None], [False, False], [True, True]) and said == []
    lone, known, late = batch(None, [5, 5])
    assert lone[0] != lone[1] and not any(known) and not any(late) and said == []


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "decimal(9,3)"])
def test_keys_of_one_bucket_keep_apart(spark, tmp_path, kind):
    values = {
        "string": ["a", "null", None, 'b", "c', ""], "double": [0.5, float("nan"), None, 0.0, -0.0],
        "timestamp": [at(1), at(1) + dt.timedelta(microseconds=1), None, at(2), at(3)], "decimal(9,3)": ["1", "1.001", None, "2", "-1"],
    }[kind]
    os.makedirs(f"{tmp_path}/in")
    fields = "id bigint, k string, at timestamp" if kind == "decimal(9,3)" else f"id bigint, k {kind}, at timestamp"
    rows = lambda more: spark.createDataFrame([(i + more, k, at(0.1)) for i, k in enumerate(values)], fields).selectExpr("id", f"cast(k as {kind}) k", "at")
    stream = spark.readStream.schema(rows(0).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    step = FunctionStep("ask", lambda ctx: {"answer": f"{time.time_ns()}"}, ["answer"])
    made = remembered(stream, step, ["k"], "at", 3600, "0 seconds", buckets=1)
    for more in (0, 5):
        rows(more).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01)
    query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    found = {r["id"]: r for r in spark.read.schema(made.schema).parquet(f"{tmp_path}/out").collect()}
    assert len(found) == 10 and all(found[i]["answer"] == found[i + 5]["answer"] and found[i + 5]["from_memory"] for i in range(5))
    assert len({r["answer"] for r in found.values()}) == (4 if kind == "double" else 5)
