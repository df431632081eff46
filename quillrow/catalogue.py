"""One query per engine operator over the test tables, and the same in SQL."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ColumnStep, EnrichmentConfig, FunctionStep, LLMStep, Pipeline, load_fields, web_search
from .functions.columns import cache_key, first_citations, list_cell, render, row_json, with_default
from .functions.prompts import Prompt
from .operators.search import WEB_TYPES
from .plans.storage import shared_root, stored
from .providers import RuleClient
from .spec import to_specs

QUERIES: dict[str, Any] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries of what the driver does before or after a run; the tests run them, but they are no work for a cluster.
DRIVER_QUERIES: dict[str, Any] = {}
DRIVER_SQL: dict[str, str] = {}


def query(sql: str | None = None, on_driver: bool = False):
    def register(f):
        (DRIVER_QUERIES if on_driver else QUERIES)[f.__name__] = f
        if sql:
            (DRIVER_SQL if on_driver else ORACLE_SQL)[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quillrow/{name}-{uuid.uuid4().hex}"


def tier_step(**more) -> ColumnStep:
    return ColumnStep("classify", {"tier": lambda row, prior: F.when(row["c_acctbal"] > 5000, "enterprise").otherwise("smb")}, **more)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'enterprise' ELSE 'smb' END AS tier FROM customer")
def column_step(spark, sf_dir):
    return Pipeline([tier_step()]).run(table(spark, sf_dir, "customer")).data.select("c_custkey", "tier")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'enterprise' ELSE 'smb' END AS tier,
       CASE WHEN c_acctbal > 5000 THEN 'research ' || c_name END AS research FROM customer""")
def flagship_conditional_research(spark, sf_dir):
    research = ColumnStep(
        "research",
        {"research": lambda row, prior: F.concat(F.lit("research "), row["c_name"]), "__note": lambda row, prior: prior["tier"]},
        depends_on=["classify"],
        run_if=lambda row, prior: prior["tier"] == "enterprise",
    )
    return Pipeline([tier_step(), research]).run(table(spark, sf_dir, "customer")).data.select("c_custkey", "tier", "research")


@query("SELECT c_custkey, upper(c_name) AS loud, CASE WHEN c_acctbal > 5000 THEN 'enterprise' ELSE 'smb' END AS tier FROM customer")
def function_step(spark, sf_dir):
    def classify(ctx):
        return {"loud": ctx.row["c_name"].upper(), "tier": "enterprise" if ctx.row["c_acctbal"] > 5000 else "smb", "dropped": 1}

    step = FunctionStep("classify", classify, ["loud", "tier"], reads=["c_name", "c_acctbal"])
    return Pipeline([step]).run(table(spark, sf_dir, "customer"), columns=["c_custkey"]).data


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def async_function_step(spark, sf_dir):
    async def shout(ctx):
        return {"kind": ctx.row["event_type"].upper()}

    step = FunctionStep("shout", shout, ["kind"], reads=["event_type"])
    return Pipeline([step]).run(table(spark, sf_dir, "events"), columns=["event_id"]).data


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_quantity * 2 + 1 AS b, (l_quantity * 2 + 1) * 3 AS c FROM lineitem")
def dag_linear(spark, sf_dir):
    steps = [
        ColumnStep("c", {"c": lambda row, prior: prior["b"] * 3}, depends_on=["b"]),
        ColumnStep("a", {"a": lambda row, prior: row["l_quantity"] * 2}),
        ColumnStep("b", {"b": lambda row, prior: prior["a"] + 1}, depends_on=["a"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "lineitem")).data.select("l_orderkey", "l_linenumber", "a", "b", "c")


@query("SELECT o_orderkey, o_custkey + 1 AS a, o_custkey + 11 AS b, o_custkey + 101 AS c, 2 * o_custkey + 112 AS d FROM orders")
def dag_diamond(spark, sf_dir):
    steps = [
        FunctionStep("a", lambda ctx: {"a": ctx.row["o_custkey"] + 1}, ["a"], types={"a": "bigint"}, reads=["o_custkey"]),
        FunctionStep("b", lambda ctx: {"b": ctx.prior_results["a"] + 10}, ["b"], ["a"], types={"b": "bigint"}, reads=[]),
        ColumnStep("c", {"c": lambda row, prior: prior["a"] + 100}, depends_on=["a"]),
        ColumnStep("d", {"d": lambda row, prior: prior["b"] + prior["c"]}, depends_on=["b", "c"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), columns=["o_orderkey"]).data


@query("SELECT o_orderkey, 'zeta' AS who, 'zeta after beta' AS last FROM orders")
def merge_last_writer(spark, sf_dir):
    steps = [
        ColumnStep("zeta", {"who": F.lit("zeta")}),
        ColumnStep("alpha", {"who": F.lit("alpha")}),
        ColumnStep("beta", {"last": F.lit("beta")}),
        ColumnStep("end", {"last": lambda row, prior: F.concat(prior["who"], F.lit(" after "), prior["last"])}, depends_on=["alpha", "zeta", "beta"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "orders")).data.select("o_orderkey", "who", "last")


@query("SELECT o_orderkey, false AS sees_first, true AS sees_second FROM orders")
def prior_direct_only(spark, sf_dir):
    def look(ctx):
        return {"sees_first": "first" in ctx.prior_results, "sees_second": "second" in ctx.prior_results}

    steps = [
        ColumnStep("one", {"first": F.lit(1)}),
        ColumnStep("two", {"second": F.lit(2)}, depends_on=["one"]),
        FunctionStep("three", look, ["sees_first", "sees_second"], ["two"], types={"sees_first": "boolean", "sees_second": "boolean"}, reads=[]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "orders")).data.select("o_orderkey", "sees_first", "sees_second")


@query("SELECT n_nationkey, n_name, n_regionkey, length(n_name) * 2 AS doubled FROM nation")
def internal_fields(spark, sf_dir):
    steps = [
        ColumnStep("size", {"__length": lambda row, prior: F.length(row["n_name"])}),
        ColumnStep("twice", {"doubled": lambda row, prior: prior["__length"] * 2}, depends_on=["size"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "nation")).data


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes ' || c_name END AS note FROM customer")
def run_if_partial(spark, sf_dir):
    step = FunctionStep("note", lambda ctx: {"note": f"owes {ctx.row['c_name']}"}, ["note"], run_if=lambda row, prior: row["c_acctbal"] < 0, reads=["c_name", "c_acctbal"])
    return Pipeline([step]).run(table(spark, sf_dir, "customer"), columns=["c_custkey"]).data


@query("SELECT c_custkey, CASE WHEN NOT c_acctbal < 0 THEN 'has ' || c_name END AS note FROM customer")
def skip_if_partial(spark, sf_dir):
    step = FunctionStep("note", lambda ctx: {"note": f"has {ctx.row['c_name']}"}, ["note"], skip_if=F.col("c_acctbal") < 0, reads=["c_name"])
    return Pipeline([step]).run(table(spark, sf_dir, "customer"), columns=["c_custkey"]).data


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 AND value > 50 THEN 'high' END AS on_high,
       CASE WHEN event_id % 7 = 0 OR NOT value > 50 THEN 'kept' END AS not_high FROM events""")
def run_if_null_predicate(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("amount", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    steps = [
        ColumnStep("high", {"on_high": F.lit("high")}, run_if=lambda row, prior: row["amount"] > 50),
        ColumnStep("kept", {"not_high": F.lit("kept")}, skip_if=lambda row, prior: row["amount"] > 50),
    ]
    return Pipeline(steps).run(events).data.select("event_id", "on_high", "not_high")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'Unknown' END AS segment FROM customer")
def skip_default(spark, sf_dir):
    fields = {"segment": {"prompt": "the market segment", "default": "Unknown"}}
    step = LLMStep("segment", fields, client=RuleClient(lambda row, prior: {"segment": row["c_mktsegment"]}), run_if=F.col("c_acctbal") > 0, reads=["c_mktsegment"])
    return Pipeline([step]).run(table(spark, sf_dir, "customer"), columns=["c_custkey"]).data


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'C' END AS first, CASE WHEN event_type = 'click' THEN 'saw C' ELSE 'saw nothing' END AS second FROM events")
def skip_chain(spark, sf_dir):
    steps = [
        ColumnStep("one", {"first": F.lit("C")}, run_if=lambda row, prior: row["event_type"] == "click"),
        FunctionStep("two", lambda ctx: {"second": f"saw {ctx.prior_results['first'] or 'nothing'}"}, ["second"], ["one"], reads=[]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "events")).data.select("event_id", "first", "second")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN 'ok' END AS state FROM orders")
def predicate_error(spark, sf_dir):
    step = FunctionStep("state", lambda ctx: {"state": "ok"}, ["state"], run_if=lambda row, prior: 1 / (row["o_orderkey"] % 10) > 0, reads=["o_orderkey"])
    return Pipeline([step]).run(table(spark, sf_dir, "orders")).data.select("o_orderkey", "state")


def _blanked(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey") % 4
    blank = F.when(key == 0, F.lit(None)).when(key == 1, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", blank.alias("c_mktsegment"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment ELSE 'filled' END AS c_mktsegment FROM customer")
def overwrite_false(spark, sf_dir):
    return Pipeline([ColumnStep("fill", {"c_mktsegment": F.lit("filled")})]).run(_blanked(spark, sf_dir)).data


@query("SELECT c_custkey, 'filled' AS c_mktsegment FROM customer")
def overwrite_true(spark, sf_dir):
    return Pipeline([ColumnStep("fill", {"c_mktsegment": F.lit("filled")})]).run(_blanked(spark, sf_dir), EnrichmentConfig(overwrite_fields=True)).data


def _failing() -> FunctionStep:
    def check(ctx):
        if ctx.row["o_orderkey"] % 9 == 0:
            raise ValueError(f"bad order {ctx.row['o_orderkey']}")
        return {"state": "good"}

    return FunctionStep("check", check, ["state"], reads=["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'good' END AS state FROM orders")
def error_isolation(spark, sf_dir):
    return Pipeline([_failing()]).run(table(spark, sf_dir, "orders"), columns=["o_orderkey"]).data


@query("SELECT 'check' AS step_name, 'ValueError' AS error_type, 'bad order ' || o_orderkey AS message FROM orders WHERE o_orderkey % 9 = 0")
def error_frame(spark, sf_dir):
    return Pipeline([_failing()]).run(table(spark, sf_dir, "orders")).errors.select("step_name", "error_type", "message")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'got:good' ELSE 'got:None' END AS echo FROM orders")
def sentinel_propagates(spark, sf_dir):
    echo = FunctionStep("echo", lambda ctx: {"echo": f"got:{ctx.prior_results['state']}"}, ["echo"], ["check"], reads=[])
    return Pipeline([_failing(), echo]).run(table(spark, sf_dir, "orders"), columns=["o_orderkey"]).data.select("o_orderkey", "echo")


@query("""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE o_orderkey % 9 = 0) AS BIGINT) AS n_errors,
       round(1 - count(*) FILTER (WHERE o_orderkey % 9 = 0) / count(*), 6) AS success_rate FROM orders""")
def success_rate(spark, sf_dir):
    result = Pipeline([_failing()]).run(table(spark, sf_dir, "orders"))
    failed = result.errors.agg(F.count(F.lit(1)).alias("n_errors"))
    rows = result.frame.agg(F.count(F.lit(1)).alias("n_rows"))
    both = rows.join(failed)  # one row each
    return both.select("n_rows", "n_errors", F.round(1 - F.col("n_errors") / F.col("n_rows"), 6).alias("success_rate"))


_ANSWER = "CASE event_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN chr(9) || 'Unknown' || chr(10) WHEN 2 THEN '  ' WHEN 3 THEN event_type ELSE chr(160) || 'no data\u2003' END"


@query("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN event_type ELSE 'none' END AS answer FROM events")
def refusal_defaults(spark, sf_dir):
    step = ColumnStep("answer", {"answer": with_default(F.expr(_ANSWER), "none")})
    return Pipeline([step]).run(table(spark, sf_dir, "events")).data.select("event_id", "answer")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'none' END AS kind FROM events")
def null_default_missing_key(spark, sf_dir):
    def answer(row, prior):
        return [{"kind": row["event_type"]}, {"kind": None}, {"other": 1}][row["event_id"] % 3]

    step = LLMStep("kind", {"kind": {"prompt": "kind", "default": "none"}}, client=RuleClient(answer), structured_outputs=False, reads=["event_id", "event_type"])
    return Pipeline([step]).run(table(spark, sf_dir, "events")).data.select("event_id", "kind")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
       CASE WHEN event_id % 4 < 2 THEN true END AS flag FROM events""")
def strict_validation(spark, sf_dir):
    def answer(row, prior):
        k = json.loads(row["props"])["k"]
        return [{"k": k, "flag": True}, {"k": str(k), "flag": "yes"}, {"k": k, "flag": "maybe"}, {"k": k, "flag": True, "more": 1}][row["event_id"] % 4]

    fields = {"k": {"prompt": "k", "type": "Number"}, "flag": {"prompt": "flag", "type": "Boolean"}}
    step = LLMStep("strict", fields, client=RuleClient(answer), max_retries=0, reads=["event_id", "props"])
    return Pipeline([step]).run(table(spark, sf_dir, "events"), columns=["event_id"]).data


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def enum_validation(spark, sf_dir):
    fields = {"segment": {"prompt": "segment", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}}
    client = RuleClient(lambda row, prior: {"segment": row["c_mktsegment"] if row["c_custkey"] % 2 == 0 else row["c_mktsegment"].lower()})
    step = LLMStep("segment", fields, client=client, max_retries=0, reads=["c_custkey", "c_mktsegment"])
    return Pipeline([step]).run(table(spark, sf_dir, "customer"), columns=["c_custkey"]).data


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS n_words, string_split(p_name, ' ')[1] AS first_word FROM part")
def list_field(spark, sf_dir):
    step = LLMStep("words", {"words": {"prompt": "words", "type": "List[String]"}}, client=RuleClient(lambda row, prior: {"words": row["p_name"].split(" ")}), reads=["p_name"])
    done = Pipeline([step]).run(table(spark, sf_dir, "part")).data
    return done.select("p_partkey", F.size("words").alias("n_words"), F.get("words", F.lit(0)).alias("first_word"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    step = LLMStep("props", {"parsed": {"prompt": "props", "type": "JSON"}}, client=RuleClient(lambda row, prior: {"parsed": json.loads(row["props"])}), reads=["props"])
    done = Pipeline([step]).run(table(spark, sf_dir, "events")).data
    return done.select("event_id", F.get_json_object("parsed", "$.k").cast("bigint").alias("k"))


@query("""SELECT r_regionkey, '<row_data>' || chr(10) || '{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}' || chr(10) || '</row_data>' AS data,
       '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS canonical FROM region""")
def prompt_text(spark, sf_dir):
    prompt = Prompt(to_specs({"summary": "Sum up the region"}))
    step = FunctionStep("prompt", lambda ctx: {"prompt": prompt.build(ctx.row)}, ["prompt"])
    regions = table(spark, sf_dir, "region")
    done = Pipeline([step]).run(regions).data
    data = F.regexp_extract("prompt", r"(?s)<row_data>.*</row_data>", 0)
    return done.select("r_regionkey", data.alias("data"), row_json(["r_regionkey", "r_name"], done).alias("canonical"))


@query("SELECT n_nationkey, 'Research ' || n_name || ' in region ' || n_regionkey AS question FROM nation")
def query_template(spark, sf_dir):
    step = ColumnStep("question", {"question": lambda row, prior: render("Research {n_name} in region {n_regionkey}", {**row, **prior})})
    return Pipeline([step]).run(table(spark, sf_dir, "nation")).data.select("n_nationkey", "question")


@query("SELECT n_nationkey, 'about ' || n_name AS summary, CAST(2 AS INT) AS n_sources FROM nation")
def web_search_step(spark, sf_dir):
    async def backend(text, options):
        return [f"draft {text}", text], ["https://a.example", "https://a.example"]

    steps = [
        FunctionStep("search", web_search("about {n_name}", backend=backend), ["__web_context", "sources"], types=WEB_TYPES, external=True, reads=["n_name"]),
        ColumnStep("summary", {"summary": lambda row, prior: prior["__web_context"]}, depends_on=["search"]),
    ]
    done = Pipeline(steps).run(table(spark, sf_dir, "nation")).data
    return done.select("n_nationkey", "summary", F.size("sources").alias("n_sources"))


@query("""SELECT p.page_id, CAST(2 AS INT) AS n_kept, p.url AS first_url, 'first' AS first_title FROM pages p""")
def citation_dedupe(spark, sf_dir):
    cited = F.array(*(F.struct(u.alias("url"), F.lit(t).alias("title"), F.lit("").alias("snippet")) for u, t in
                      ((F.lit(""), "none"), (F.col("url"), "first"), (F.lit("https://b.example"), "b"), (F.col("url"), "again"))))
    step = ColumnStep("sources", {"sources": first_citations(cited)})
    done = Pipeline([step]).run(table(spark, sf_dir, "pages")).data
    return done.select("page_id", F.size("sources").alias("n_kept"), F.col("sources")[0]["url"].alias("first_url"), F.col("sources")[0]["title"].alias("first_title"))


@query("SELECT n_nationkey, CAST(2 AS INT) AS n_sources, 'https://' || n_name AS first_url FROM nation")
def grounded_step(spark, sf_dir):
    def cites(row):
        return [{"url": f"https://{row['n_name']}"}, {"url": ""}, {"url": "https://b.example"}, {"url": f"https://{row['n_name']}"}]

    step = LLMStep("fact", {"fact": "a fact"}, client=RuleClient(lambda row, prior: {"fact": "x"}, cites), grounding=True, reads=["n_name"])
    done = Pipeline([step]).run(table(spark, sf_dir, "nation")).data
    return done.select("n_nationkey", F.size("sources").alias("n_sources"), F.col("sources")[0]["url"].alias("first_url"))


@query("""SELECT n_nationkey, sha256('step' || chr(30) || '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' || chr(30) || '{}') AS key FROM nation""")
def content_key(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    return nations.select("n_nationkey", cache_key("step", row_json(["n_nationkey", "n_name"], nations), F.lit("{}")).alias("key"))


def _cached_runs(spark, sf_dir, versions: list[str], ttl: int = 3600) -> list:
    config = EnrichmentConfig(enable_caching=True, cache_dir=fresh_folder(spark, "cache"), cache_ttl=ttl)
    customers = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    runs = []
    for version in versions:
        step = FunctionStep("loud", lambda ctx: {"loud": ctx.row["c_mktsegment"].lower()}, ["loud"], cache_version=version, skip_if=lambda row, prior: row["c_custkey"] % 5 == 0)
        runs.append(Pipeline([step]).run(customers, config).cost.steps["loud"])
    return runs


def _counters(spark, runs: list) -> DataFrame:
    rows = [(i, r.cache_hits, r.cache_misses, r.rows_skipped, r.rows_processed) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, hits long, misses long, skipped long, processed long")


_SEEN = "count(*) FILTER (WHERE c_custkey % 5 <> 0)"
_COUNTERS = """SELECT CAST(run AS INT) AS run, CAST(CASE WHEN fresh THEN 0 ELSE {n} END AS BIGINT) AS hits, CAST(CASE WHEN fresh THEN {n} ELSE 0 END AS BIGINT) AS misses,
       CAST(count(*) - {n} AS BIGINT) AS skipped, CAST({n} AS BIGINT) AS processed
FROM customer, (VALUES {v}) AS r(run, fresh) GROUP BY run, fresh"""


@query(_COUNTERS.format(n=_SEEN, v="(0, true), (1, false)"))
def cache_hit_miss(spark, sf_dir):
    return _counters(spark, _cached_runs(spark, sf_dir, ["1", "1"]))


@query(_COUNTERS.format(n=_SEEN, v="(0, true), (1, true), (2, false)"))
def cache_version(spark, sf_dir):
    return _counters(spark, _cached_runs(spark, sf_dir, ["1", "2", "1"]))


@query("SELECT c_custkey, c_name AS live, CAST(NULL AS VARCHAR) AS late, (SELECT count(*) FROM customer) AS removed FROM customer")
def cache_ttl(spark, sf_dir):
    from .sources.cache import CacheManager

    cache = CacheManager(spark, fresh_folder(spark, "ttl"), ttl=10)
    customers = table(spark, sf_dir, "customer")
    cache.append("s", customers.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")), now=1000.0)
    found = customers.select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    for name, now in (("live", 1010.0), ("late", 1011.0)):
        found = found.join(cache.entries("s", now=now).withColumnRenamed("value", name), "key", "left")
    found = stored(found.select("c_custkey", "live", "late"), fresh_folder(spark, "ttl-found"))  # before the entries go
    return found.withColumn("removed", F.lit(cache.cleanup_expired(now=1011.0)).cast("bigint"))


@query("SELECT doc_id, length(text) AS n_points FROM documents")
def dedupe_calls(spark, sf_dir):
    step = FunctionStep("size", lambda ctx: {"n_points": len(ctx.row["text"])}, ["n_points"], types={"n_points": "bigint"}, reads=["text"])
    return Pipeline([step]).run(table(spark, sf_dir, "documents"), EnrichmentConfig(dedupe=True), columns=["doc_id"]).data


def _summaries(spark, sf_dir):
    """Two model steps whose token counts follow from the row: the prompt's row has six words, answers three."""
    client = RuleClient(lambda row, prior: {"answer": "en" if row["lang"] == "en" else "other"})
    other = RuleClient(lambda row, prior: {"kind": "short" if row["n_chars"] < 1000 else "long"})
    steps = [
        LLMStep("language", {"answer": "language"}, client=client, reads=["lang", "n_chars"], model="m-1"),
        LLMStep("length", {"kind": "kind"}, client=other, reads=["lang", "n_chars"], model="m-2", run_if=F.col("lang") == "en"),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "documents"), EnrichmentConfig(max_workers=16), columns=["doc_id"])


@query("""SELECT 'language' AS step_name, CAST(4 * count(*) AS BIGINT) AS prompt_tokens, CAST(2 * count(*) AS BIGINT) AS completion_tokens,
       CAST(count(*) AS BIGINT) AS processed, CAST(0 AS BIGINT) AS skipped, 'm-1' AS model FROM documents
UNION ALL SELECT 'length', CAST(4 * count(*) FILTER (WHERE lang = 'en') AS BIGINT), CAST(2 * count(*) FILTER (WHERE lang = 'en') AS BIGINT),
       CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT), CAST(count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') AS BIGINT), 'm-2' FROM documents""")
def usage_by_step(spark, sf_dir):
    steps = _summaries(spark, sf_dir).cost.steps
    rows = [(n, u.prompt_tokens, u.completion_tokens, u.rows_processed, u.rows_skipped, u.model) for n, u in steps.items()]
    return spark.createDataFrame(rows, "step_name string, prompt_tokens long, completion_tokens long, processed long, skipped long, model string")


@query("""WITH each AS (SELECT 'language' AS step_name, 6 * count(*) AS n FROM documents
    UNION ALL SELECT 'length', 6 * count(*) FILTER (WHERE lang = 'en') FROM documents)
SELECT step_name, CAST(sum(n) AS BIGINT) AS total_tokens FROM each GROUP BY ROLLUP (step_name)""")
def cost_rollup(spark, sf_dir):
    run = _summaries(spark, sf_dir)._run
    each = [F.struct(F.lit(n).alias("step_name"), F.col(f"`__s_{n}`.usage.total_tokens").alias("n")) for n in ("language", "length")]
    usage = run.frame.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return usage.rollup("step_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))


@query("""SELECT * FROM (VALUES ('size', 'Measure it' || chr(10) || 'Be brief', 'Number', NULL, 0, '0'), ('level', 'Pick one', 'String', 'Low', 3, NULL),
       ('news', 'Find news', 'String', NULL, 0, NULL)) AS t(name, prompt, kind, first_option, n_options, fallback)""", on_driver=True)
def field_csv(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "fields.csv")
        with open(path, "w", encoding="utf-8") as file:
            file.write('Category,Field,Prompt,Type,Enum,Instructions,Default\nbusiness,size,Measure it,Number,,Be brief,0\nbusiness,level,Pick one,,"Low, Medium, High",,\nweb,news,Find news,,,,\n')
        fields = load_fields(path)
    rows = [(n, d["prompt"], d["type"], d.get("enum", [None])[0], len(d.get("enum", [])), d.get("default")) for n, d in fields.items()]
    return spark.createDataFrame(rows, "name string, prompt string, kind string, first_option string, n_options int, fallback string")


@query("SELECT p_partkey, len(list_filter(list_transform(string_split(p_brand || ', ' || p_type || ',,', ','), lambda x: trim(x)), lambda x: x <> '')) AS n_parts FROM part")
def list_cells(spark, sf_dir):
    cell = F.concat("p_brand", F.lit(", "), "p_type", F.lit(",,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(list_cell(cell)).cast("bigint").alias("n_parts"))


@query("SELECT o_orderkey, o_custkey * 2 AS doubled, o_custkey * 2 + 1 AS after FROM orders")
def checkpoint_resume(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    config = EnrichmentConfig(enable_checkpointing=True, checkpoint_dir=fresh_folder(spark, "checkpoints"), on_error="raise")

    def steps(second):
        return [
            FunctionStep("one", lambda ctx: {"doubled": ctx.row["o_custkey"] * 2}, ["doubled"], types={"doubled": "bigint"}, reads=["o_custkey"]),
            FunctionStep("two", second, ["after"], ["one"], types={"after": "bigint"}, reads=[]),
        ]

    def broken(ctx):
        raise ValueError("not yet")

    from .errors import StepError

    try:
        Pipeline(steps(broken)).run(orders, config, data_identifier="orders", columns=["o_orderkey"])
    except StepError:
        pass
    done = Pipeline(steps(lambda ctx: {"after": ctx.prior_results["doubled"] + 1})).run(orders, config.but(on_error="continue"), data_identifier="orders", columns=["o_orderkey"])
    return done.data.select("o_orderkey", "doubled", "after")


@query("SELECT c_custkey, c_name || '!' AS shout FROM customer WHERE c_acctbal > 9000")
def filter_before_steps(spark, sf_dir):
    step = FunctionStep("shout", lambda ctx: {"shout": ctx.row["c_name"] + "!"}, ["shout"], reads=["c_name"])
    unused = FunctionStep("unused", lambda ctx: 1 / 0, ["unused"], reads=[])
    return Pipeline([step, unused]).run(table(spark, sf_dir, "customer"), where=F.col("c_acctbal") > 9000, select_fields=["shout"]).data.select("c_custkey", "shout")


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def streaming_enrichment(spark, sf_dir):
    from .streaming import append_to, enrich_stream

    schema = table(spark, sf_dir, "events").schema
    folder = fresh_folder(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    step = FunctionStep("kind", lambda ctx: {"kind": ctx.row["event_type"].upper()}, ["kind"], reads=["event_type"])
    enrich_stream(Pipeline([step]), stream, append_to(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "kind")
