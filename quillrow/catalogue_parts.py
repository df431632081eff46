"""Queries of the engine's smaller parts over the test tables, and the same in SQL."""

from __future__ import annotations

import csv
import json
import os
import tempfile
import warnings

from pyspark.sql import functions as F

from . import ColumnStep, EnrichmentConfig, EnrichmentHooks, EnrichmentResult, FunctionStep, LLMStep, Pipeline, StepResult, web_search
from .catalogue import fresh_folder, query, table
from .clients.base import LLMAPIError, LLMResponse
from .clients.vendors import anthropic_tool, google_tool, openai_tool
from .errors import StepError
from .functions.answers import response_schema
from .functions.prompts import Prompt
from .operators.search import WEB_TYPES
from .records import GroundingConfig
from .sources.fields import FieldManager
from .spec import canonical_json, to_specs

# sources, graph, runner


@query("SELECT n_nationkey, upper(n_name) AS loud, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS BIGINT) AS place FROM nation", on_driver=True)
def list_source_and_sink(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").orderBy(F.desc("n_nationkey")).collect()]
    done = Pipeline([ColumnStep("loud", {"loud": lambda row, prior: F.upper(row["n_name"])})]).run(rows, spark=spark).data
    return spark.createDataFrame([(r["n_nationkey"], r["loud"], i + 1) for i, r in enumerate(done)], "n_nationkey int, loud string, place long")


@query("""SELECT r_name AS category, n_name AS field, 'Describe ' || n_name || chr(10) || 'Key ' || n_nationkey AS prompt,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Number' ELSE 'String' END AS kind, count(*) OVER (PARTITION BY r_name) AS n_fields
FROM nation JOIN region ON n_regionkey = r_regionkey""", on_driver=True)
def field_categories(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "fields.csv")
        with open(path, "w", encoding="utf-8", newline="") as file:
            out = csv.writer(file)
            out.writerow(["Category", "Field", "Prompt", "Type", "Guidance"])
            out.writerows([r.r_name, r.n_name, f"Describe {r.n_name}", "" if r.n_nationkey % 2 else "Number", f"Key {r.n_nationkey}"] for r in both.collect())
        fields = FieldManager(path)
    rows = [(c, n, s.prompt, s.type, fields.get_field_count(c)) for c in fields.get_categories() for n, s in fields.get_category_fields(c).items()]
    return spark.createDataFrame(rows, "category string, field string, prompt string, kind string, n_fields long")


@query("""SELECT r_name AS step, CAST(0 AS BIGINT) AS level, true AS known FROM region
UNION ALL SELECT n_name, 1, true FROM nation UNION ALL SELECT 'end', 2, true""", on_driver=True)
def graph_levels(spark, sf_dir):
    regions = {r.r_regionkey: f"{r.r_name}" for r in table(spark, sf_dir, "region").collect()}
    nations = table(spark, sf_dir, "nation").collect()
    steps = [ColumnStep("end", {"end": F.lit(1)}, depends_on=[r.n_name for r in nations])]
    steps += [ColumnStep(r.n_name, {r.n_name: F.lit(1)}, depends_on=[regions[r.n_regionkey]]) for r in nations]
    steps += [ColumnStep(name, {name: F.lit(1)}) for name in regions.values()]
    graph = Pipeline(steps)
    rows = [(n, i, graph.get_step(n).name == n and n in graph.step_names) for i, level in enumerate(graph.execution_levels) for n in level]
    return spark.createDataFrame(rows, "step string, level long, known boolean")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'filled') AS c_mktsegment, (SELECT count(*) FROM customer) AS processed FROM customer")
def runner_fills_blanks(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))

    class Filling(_Counting):
        def answer(self, row, options):
            return {"c_mktsegment": "filled"}

    runner = Pipeline([LLMStep("fill", {"c_mktsegment": "segment"}, client=Filling(), reads=["c_custkey"])]).runner(EnrichmentConfig(max_workers=16))
    done = runner.run(customers)
    return done.select("c_custkey", "c_mktsegment", F.lit(runner.last.cost.steps["fill"].rows_processed).cast("bigint").alias("processed"))


@query("SELECT o_orderkey, o_custkey + 30 AS lifted FROM orders")
def custom_step(spark, sf_dir):
    class Lift:
        name, fields, depends_on, types, reads = "lift", ["lifted"], [], {"lifted": "bigint"}, ["o_custkey"]

        async def run(self, ctx):
            return StepResult({"lifted": ctx.row["o_custkey"] + ctx.config.max_workers, "not_declared": 1})

    return Pipeline([Lift()]).run(table(spark, sf_dir, "orders"), EnrichmentConfig(max_workers=30), columns=["o_orderkey"]).data


# predicates


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'run' END AS by_run, CASE WHEN o_orderkey % 4 <> 1 THEN 'run' END AS by_skip FROM orders")
def async_predicates(spark, sf_dir):
    async def chosen(row, prior):
        return row["o_orderkey"] % 4 == 1

    steps = [
        FunctionStep("one", lambda ctx: {"by_run": "run"}, ["by_run"], run_if=chosen, reads=["o_orderkey"]),
        FunctionStep("two", lambda ctx: {"by_skip": "run"}, ["by_skip"], skip_if=chosen, reads=["o_orderkey"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "orders"), columns=["o_orderkey"]).data


# prompts: the SQL holds their text in full

_HEAD = "You complete rows of a table. Below are the fields to fill, one row, and what earlier steps found out about it."
_KEYS = """## Reading a field
* `prompt`: the question this field answers
* `type`: kind of value: String, Number, Boolean, Date, List[String] or JSON
* `format`: shape the value takes
* `enum`: the closed list of values
* `examples`: an answer of the wanted kind
* `bad_examples`: an answer of an unwanted kind
* `default`: the value for a field that stays unknown"""
_ANSWER = """## Answer
* One JSON object, bare, with these keys and no others: size, motto.
* A value with a `format` has exactly that shape.
* A field with an `enum` takes one of its values, spelt as listed.
* A field that row, earlier results and general knowledge leave open is its `default`."""
_FIELDS = """<field_specifications>
<field name="size">
  <prompt>How large is it</prompt>
  <type>Number</type>
  <format>0.0</format>
  <enum>1.0, 2.0</enum>
  <example>1.0</example>
  <bad_example>one</bad_example>
  <default>None</default>
</field>
<field name="motto">
  <prompt>Its motto</prompt>
</field>
</field_specifications>"""
_TAIL = "Now answer with the JSON object alone, keys size, motto."
_SPECS = {"size": {"prompt": "How large is it", "type": "Number", "format": "0.0", "enum": ["1.0", "2.0"], "examples": ["1.0"], "bad_examples": ["one"], "default": None}, "motto": "Its motto"}
_ROW = """'<row_data>' || chr(10) || '{"n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || '}' || chr(10) || '</row_data>'"""


def _joined(*parts: str) -> str:
    return " || chr(10) || chr(10) || ".join(p if p.startswith("'<row") or p.startswith("'<prior") else "'" + p.replace("'", "''") + "'" for p in parts)


@query(f"SELECT n_nationkey, {_joined(_HEAD, '## Background' + chr(10) + 'Atlas', _KEYS, _ANSWER, _ROW, _FIELDS, _TAIL)} AS prompt FROM nation")
def prompt_whole(spark, sf_dir):
    prompt = Prompt(to_specs(_SPECS), header="Atlas")
    step = FunctionStep("prompt", lambda ctx: {"prompt": prompt.build(ctx.row)}, ["prompt"], reads=["n_name", "n_regionkey"])
    return Pipeline([step]).run(table(spark, sf_dir, "nation"), columns=["n_nationkey"]).data


_PRIOR = """'<prior_results>' || chr(10) || '{"short": "' || left(n_name, 2) || '"}' || chr(10) || '</prior_results>'"""


@query(f"SELECT n_nationkey, {_joined('Do it', _ROW, _FIELDS, _PRIOR, _TAIL)} AS prompt FROM nation")
def prompt_replaced_with_prior(spark, sf_dir):
    prompt = Prompt(to_specs(_SPECS), system_prompt="Do it", header="not used")
    steps = [
        ColumnStep("short", {"short": lambda row, prior: F.left(row["n_name"], F.lit(2))}),
        FunctionStep("prompt", lambda ctx: {"prompt": prompt.build(ctx.row, ctx.prior_results)}, ["prompt"], ["short"], reads=["n_name", "n_regionkey"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "nation"), columns=["n_nationkey"]).data.select("n_nationkey", "prompt")


# answers


@query("""SELECT p_brand AS field, 'About ' || p_brand || '. Format: ' || n || ' parts. Examples: x; ' || p_brand AS description, CASE WHEN n % 2 = 0 THEN 'number' ELSE 'string' END AS kind,
       true AS required, false AS more FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""", on_driver=True)
def answer_schema(spark, sf_dir):
    brands = {r.p_brand: r["count"] for r in table(spark, sf_dir, "part").groupBy("p_brand").count().collect()}
    fields = {b: {"prompt": f"About {b}", "format": f"{n} parts", "examples": ["x", b], "type": "String" if n % 2 else "Number"} for b, n in brands.items()}
    schema = response_schema(to_specs(fields))["json_schema"]["schema"]
    rows = [(b, d["description"], d["type"], b in schema["required"], schema["additionalProperties"]) for b, d in schema["properties"].items()]
    return spark.createDataFrame(rows, "field string, description string, kind string, required boolean, more boolean")


class _Counting:
    """Base of clients that look at how they are called."""

    structured_outputs = True

    def answer(self, row, options):
        raise NotImplementedError

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None):
        from .clients.base import tagged

        options = {"messages": messages, "model": model, "temperature": temperature, "max_tokens": max_tokens, "format": response_format, "tools": tools}
        found = self.answer(tagged(messages[0]["content"], "row_data"), options)
        return LLMResponse(found if isinstance(found, str) else json.dumps(found))


@query("SELECT n_nationkey, 'json_schema' AS strict, 'json_object' AS loose, 'json_object' AS listed FROM nation")
def answer_formats(spark, sf_dir):
    class Format(_Counting):
        def answer(self, row, options):
            return dict.fromkeys(("strict", "loose", "listed"), options["format"]["type"]) if options["format"]["type"] == "json_object" else {"strict": options["format"]["type"]}

    steps = [
        LLMStep("strict", {"strict": "x"}, client=Format(), reads=["n_nationkey"]),
        LLMStep("loose", {"loose": "x"}, client=Format(), structured_outputs=False, reads=["n_nationkey"]),
        LLMStep("listed", ["listed"], client=Format(), reads=["n_nationkey"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "nation"), EnrichmentConfig(max_workers=16), columns=["n_nationkey"]).data


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 2 END AS turns, CASE WHEN n_nationkey % 3 = 0 THEN 'no json' END AS refused FROM nation")
def correction_turns(spark, sf_dir):
    class Learner(_Counting):
        def answer(self, row, options):
            turns = options["messages"]
            if row["n_nationkey"] % 3 == 0 and len(turns) == 2:
                return "no json"
            return {"turns": len(turns), "refused": turns[2]["content"] if len(turns) > 2 else None}

    step = LLMStep("learn", ["turns", "refused"], client=Learner(), reads=["n_nationkey"])
    done = Pipeline([step]).run(table(spark, sf_dir, "nation"), EnrichmentConfig(max_workers=16), columns=["n_nationkey"]).data
    return done.select("n_nationkey", F.col("turns").cast("int").alias("turns"), "refused")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CASE WHEN c_custkey % 10 = 1 THEN 3 ELSE 1 END END AS calls,
       CASE WHEN c_custkey % 10 = 0 THEN 'StepError' END AS error FROM customer""")
def call_retries(spark, sf_dir):
    class Shaky(_Counting):
        def __init__(self):
            self.calls = {}

        def answer(self, row, options):
            key = row["c_custkey"]
            self.calls[key] = self.calls.get(key, 0) + 1
            if key % 10 == 0 or key % 10 == 1 and self.calls[key] < 3:
                raise LLMAPIError("busy", 429)
            return {"calls": self.calls[key]}

    step = LLMStep("shaky", ["calls"], client=Shaky, reads=["c_custkey"])
    result = Pipeline([step]).run(table(spark, sf_dir, "customer"), EnrichmentConfig(max_workers=16, max_retries=2, retry_base_delay=0), columns=["c_custkey"])
    failed = result.frame_with_row.join(result.errors.withColumnRenamed("row_id", "__row_id"), "__row_id", "left")
    return failed.select("c_custkey", F.col("calls").cast("int").alias("calls"), F.col("error_type").alias("error"))


@query("SELECT n_nationkey, 'm-9 0.7 123' AS own, 'gpt-4.1-mini 0.4 77' AS of_run FROM nation")
def call_options(spark, sf_dir):
    class Told(_Counting):
        def answer(self, row, options):
            said = f"{options['model']} {options['temperature']} {options['max_tokens']}"
            return {"own": said, "of_run": said}

    steps = [
        LLMStep("own", ["own"], client=Told(), model="m-9", temperature=0.7, max_tokens=123, reads=["n_nationkey"]),
        LLMStep("of_run", ["of_run"], client=Told(), reads=["n_nationkey"]),
    ]
    return Pipeline(steps).run(table(spark, sf_dir, "nation"), EnrichmentConfig(max_workers=16, temperature=0.4, max_tokens=77), columns=["n_nationkey"]).data


@query("SELECT 'fact' AS step_name, 'StepError' AS error_type, true AS names_tools, n_nationkey FROM nation")
def client_without_tools(spark, sf_dir):
    class Plain:
        async def complete(self, messages, model, temperature, max_tokens, response_format=None):
            return LLMResponse('{"fact": "x"}')

    result = Pipeline([LLMStep("fact", {"fact": "a fact"}, client=Plain, grounding=True, reads=["n_name"])]).run(table(spark, sf_dir, "nation"), EnrichmentConfig(max_workers=16))
    rows = result.frame_with_row.select("n_nationkey", F.col("__row_id").alias("row_id"))
    return result.errors.join(rows, "row_id").select("step_name", "error_type", F.col("message").contains("tools").alias("names_tools"), "n_nationkey")


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN k + 0.5 END AS k, CASE WHEN k % 2 = 0 THEN event_type END AS kind
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def schema_values(spark, sf_dir):
    class Even(EnrichmentResult):
        @classmethod
        def model_validate(cls, answer):
            if answer["k"] % 2:
                raise ValueError("k is even")
            return cls(k=answer["k"] + 0.5, kind=answer["kind"].strip(), more=1)

    class Reading(_Counting):
        def answer(self, row, options):
            return {"k": json.loads(row["props"])["k"], "kind": f" {row['event_type']} "}

    step = LLMStep("even", {"k": {"prompt": "k", "type": "Number"}, "kind": "kind"}, client=Reading(), schema=Even, max_retries=0, reads=["props", "event_type"])
    return Pipeline([step]).run(table(spark, sf_dir, "events"), EnrichmentConfig(max_workers=16), columns=["event_id"]).data


# web search


@query("""SELECT n_nationkey, '{"filters":{"allowed_domains":["' || n_name || '.example"]},"type":"web_search","user_location":{"country":"' || left(n_name, 2) || '","type":"approximate"}}' AS openai,
       '{"allowed_domains":["' || n_name || '.example"],"max_uses":' || n_regionkey + 1 || ',"name":"web_search","type":"web_search_20250305","user_location":{"country":"' || left(n_name, 2) || '","type":"approximate"}}' AS anthropic,
       '{"google_search":{"exclude_domains":["bad.example"]}}' AS google FROM nation""")
def search_tools(spark, sf_dir):
    def tools(ctx):
        place = {"country": ctx.row["n_name"][:2]}
        only = GroundingConfig(allowed_domains=[f"{ctx.row['n_name']}.example"], user_location=place, max_searches=ctx.row["n_regionkey"] + 1).tool()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            made = {"openai": openai_tool(only), "anthropic": anthropic_tool(only), "google": google_tool(GroundingConfig(blocked_domains=["bad.example"]).tool())}
        return {k: canonical_json(v) for k, v in made.items()}

    step = FunctionStep("tools", tools, ["openai", "anthropic", "google"], reads=["n_name", "n_regionkey"])
    return Pipeline([step]).run(table(spark, sf_dir, "nation"), columns=["n_nationkey"]).data


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'last of ' || c_name END AS found,
       CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 2 ELSE 0 END AS n_sources, CASE WHEN c_custkey % 4 = 3 THEN 'ValueError' END AS error FROM customer""")
def search_failures(spark, sf_dir):
    async def backend(text, options):
        key = int(text.split()[-1])
        if key % 4 == 0:
            raise LLMAPIError("down", 503)
        if key % 4 == 1:
            return [], []
        if key % 4 == 3:
            raise ValueError("not the service's fault")
        return ["first", f"last of {text.split()[0]}"], ["u", "u"]

    step = FunctionStep("search", web_search("{c_name} {c_custkey}", backend=backend), ["__web_context", "sources"], types=WEB_TYPES, external=True, reads=["c_name", "c_custkey"])
    shown = ColumnStep("shown", {"found": lambda row, prior: prior["__web_context"]}, depends_on=["search"])
    result = Pipeline([step, shown]).run(table(spark, sf_dir, "customer"), EnrichmentConfig(max_workers=16), columns=["c_custkey"])
    both = result.frame_with_row.join(result.errors.withColumnRenamed("row_id", "__row_id"), "__row_id", "left")
    sources = F.when(F.col("sources").isNotNull(), F.size("sources"))
    return both.select("c_custkey", "found", sources.alias("n_sources"), F.col("error_type").alias("error"))


# cache


def _runs(spark, sf_dir, makes: list, config: EnrichmentConfig) -> list:
    customers = table(spark, sf_dir, "customer")
    return [Pipeline([make()]).run(customers, config).cost.steps for make in makes]


def _cached(spark, **more) -> EnrichmentConfig:
    return EnrichmentConfig(enable_caching=True, cache_dir=fresh_folder(spark, "cache"), max_workers=16, **more)


@query("SELECT CAST(run AS INT) AS run, CASE WHEN hit THEN n ELSE 0 END AS hits, CASE WHEN hit THEN 0 ELSE n END AS misses, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS rate FROM (SELECT count(*) AS n FROM customer), (VALUES (0, false), (1, true), (2, false), (3, false)) AS r(run, hit)")
def model_step_key(spark, sf_dir):
    class Fixed(_Counting):
        def answer(self, row, options):
            return {"a": "x"}

    def made(**more):
        return lambda: LLMStep("s", {"a": "ask"}, client=Fixed(), reads=["c_custkey"], **more)

    runs = _runs(spark, sf_dir, [made(), made(), made(model="other"), made(temperature=0.9)], _cached(spark))
    rows = [(i, r["s"].cache_hits, r["s"].cache_misses, r["s"].cache_hit_rate) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, hits long, misses long, rate double")


@query("""SELECT CAST(run AS INT) AS run, CASE WHEN run = 0 THEN 0 ELSE good END AS hits, CASE WHEN run = 0 THEN good ELSE 0 END AS misses, skipped
FROM (SELECT count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 5 > 0) AS good, count(*) FILTER (WHERE c_custkey % 3 = 0) AS skipped FROM customer), (VALUES (0), (1)) AS r(run)""")
def cache_keeps_good_answers_only(spark, sf_dir):
    def answer(ctx):
        if ctx.row["c_custkey"] % 5 == 0:
            raise ValueError("no")
        return {"a": "x"}

    def made():
        return FunctionStep("s", answer, ["a"], skip_if=F.col("c_custkey") % 3 == 0, reads=["c_custkey"])

    runs = _runs(spark, sf_dir, [made, made], _cached(spark))
    return spark.createDataFrame([(i, r["s"].cache_hits, r["s"].cache_misses, r["s"].rows_skipped) for i, r in enumerate(runs)], "run int, hits long, misses long, skipped long")


@query("""SELECT o_orderpriority, count(*) AS n_rows, CAST(0 AS BIGINT) AS entries, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS cleared FROM orders GROUP BY o_orderpriority""")
def cache_bypass_and_clear(spark, sf_dir):
    from .sources.cache import CacheManager

    config = _cached(spark)
    steps = [
        FunctionStep("kept", lambda ctx: {"a": ctx.row["o_orderpriority"]}, ["a"], reads=["o_orderpriority"]),
        FunctionStep("passing", lambda ctx: {"b": ctx.row["o_orderpriority"]}, ["b"], reads=["o_orderpriority"], cache=False),
    ]
    pipeline = Pipeline(steps)
    done = pipeline.run(table(spark, sf_dir, "orders"), config, columns=["o_orderkey"])
    grouped = done.data.groupBy(F.col("b").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("n_rows"))
    entries = CacheManager(spark, config.cache_dir).entries("passing").count()
    cleared = pipeline.clear_cache(spark, cache_dir=config.cache_dir)
    return grouped.withColumns({"entries": F.lit(entries).cast("bigint"), "cleared": F.lit(cleared).cast("bigint")})


# checkpoints


@query("SELECT -o_orderkey AS o_orderkey, -2 * o_custkey AS doubled, 1 - 2 * o_custkey AS after FROM orders")
def checkpoint_of_other_rows(spark, sf_dir):
    """A run over one table fails and leaves its checkpoint; the same steps over another table of equal size don't go on from it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    other = orders.select((-F.col("o_orderkey")).alias("o_orderkey"), (-F.col("o_custkey")).alias("o_custkey"))
    config = EnrichmentConfig(enable_checkpointing=True, checkpoint_dir=fresh_folder(spark, "checkpoints"), on_error="raise")

    def steps(fails):
        def second(ctx):
            if fails:
                raise ValueError("not yet")
            return {"after": ctx.prior_results["doubled"] + 1}

        return [
            FunctionStep("one", lambda ctx: {"doubled": ctx.row["o_custkey"] * 2}, ["doubled"], types={"doubled": "bigint"}, reads=["o_custkey"]),
            FunctionStep("two", second, ["after"], ["one"], types={"after": "bigint"}, reads=[]),
        ]

    try:
        Pipeline(steps(True)).run(orders, config, data_identifier="orders")
    except StepError:
        pass
    return Pipeline(steps(False)).run(other, config, data_identifier="orders", columns=["o_orderkey"]).data.select("o_orderkey", "doubled", "after")


@query("SELECT count(*) AS n_rows, sum(o_custkey * 2) AS total, true AS all_marked, true AS some_made, CAST(0 AS BIGINT) AS wrong FROM orders")
def checkpoint_parts(spark, sf_dir):
    """A worker dies inside a level; answers of finished parts carry the first run's mark, all others the second's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    count = orders.count()
    config = EnrichmentConfig(enable_checkpointing=True, checkpoint_dir=fresh_folder(spark, "checkpoints"), checkpoint_interval=max(1, count // 8))
    fatal = orders.agg(F.max("o_orderkey")).first()[0]

    def step(mark, dies):
        def answer(ctx):
            if dies and ctx.row["o_orderkey"] == fatal:
                raise SystemExit  # takes the worker along, and with it the job
            return {"doubled": ctx.row["o_custkey"] * 2, "mark": mark}

        return FunctionStep("double", answer, ["doubled", "mark"], types={"doubled": "bigint"}, reads=["o_orderkey", "o_custkey"])

    try:
        Pipeline([step("first", True)]).run(orders, config)
    except Exception:
        pass
    done = Pipeline([step("second", False)]).run(orders, config).data
    kept, made = F.count_if(F.col("mark") == "first"), F.count_if(F.col("mark") == "second")
    # parts before the fatal one are kept, if it isn't the first; then nothing is
    wrong = F.count_if((F.col("o_orderkey") == fatal) & (F.col("mark") == "first"))
    found = done.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doubled").alias("total"), (kept + made == F.count(F.lit(1))).alias("all_marked"), (made > 0).alias("some_made"), wrong.alias("wrong"))
    return found


# hooks


@query("""SELECT event, n FROM (SELECT count(*) AS c, count(*) FILTER (WHERE c_custkey % 7 = 0) AS bad FROM customer),
    LATERAL (VALUES ('pipeline start', c), ('step start', 2 * c), ('row', 2 * c), ('row error', bad), ('step end errors', bad), ('pipeline end errors', bad), ('failed hook', 1)) AS e(event, n)""", on_driver=True)
def hook_events(spark, sf_dir):
    seen: dict[str, int] = {}

    def add(event, n):
        seen[event] = seen.get(event, 0) + n

    async def row(e):
        add("row", 1)
        add("row error", int(e.error is not None))

    def ended(e):
        add("pipeline end errors", e.total_errors)
        add("failed hook", 1)
        raise RuntimeError("a hook's failure goes no further")

    hooks = EnrichmentHooks(
        on_pipeline_start=lambda e: add("pipeline start", e.num_rows), on_step_start=lambda e: add("step start", e.num_rows), on_row_complete=row,
        on_step_end=lambda e: add("step end errors", e.num_errors), on_pipeline_end=ended,
    )

    def check(ctx):
        if ctx.row["c_custkey"] % 7 == 0:
            raise ValueError("no")
        return {"a": "x"}

    steps = [FunctionStep("check", check, ["a"], reads=["c_custkey"]), ColumnStep("then", {"b": lambda row, prior: prior["a"]}, depends_on=["check"])]
    Pipeline(steps).run(table(spark, sf_dir, "customer"), hooks=hooks)
    return spark.createDataFrame(list(seen.items()), "event string, n long")


# what is refused, with the name that is at fault

_FAULTS = {
    "graph": "'step ''one'' depends on unknown steps: ' || n_name",
    "names": "'step names must differ: ' || n_name",
    "cycle": "'the steps ' || least(n_name, 'MM') || ', ' || greatest(n_name, 'MM') || ' depend on each other in a cycle'",
    "predicates": "'step ''' || n_name || ''': run_if and skip_if exclude each other'",
    "sources": "'step ''s'': sources field ''' || n_name || ''' is also a declared field'",
    "field type": "'unknown field type ''' || n_name || '''; known: String, Number, Boolean, Date, List[String], JSON'",
    "grounding": "'unknown grounding options: ' || n_name",
    "csv": "'f.csv lacks the columns Field, Prompt'",
    "category": "'no category ''' || n_name || '''; there are a'",
    "on_error": "'on_error must be ''continue'' or ''raise'''",
    "search size": "'search_context_size is one of low, medium, high'",
    "columns": "'not among the input''s columns: ' || n_name",
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, n_name, {message} AS message FROM nation" for kind, message in _FAULTS.items()), on_driver=True)
def refusals_of_wrong_settings(spark, sf_dir):
    def csv_file(folder, first, *more):
        path = os.path.join(folder, "f.csv")
        with open(path, "w", encoding="utf-8", newline="") as file:
            csv.writer(file).writerows([first, *more])
        return path

    one = ColumnStep("one", {"x": F.lit(1)})
    nations = table(spark, sf_dir, "nation")
    rows = []
    with tempfile.TemporaryDirectory() as folder:
        for name in [r.n_name for r in nations.collect()]:
            wrong = {
                "graph": lambda: Pipeline([ColumnStep("one", {}, depends_on=[name])]),
                "names": lambda: Pipeline([ColumnStep(name, {}), ColumnStep(name, {})]),
                "cycle": lambda: Pipeline([ColumnStep(name, {}, depends_on=["MM"]), ColumnStep("MM", {}, depends_on=[name])]),
                "predicates": lambda: ColumnStep(name, {}, run_if=F.lit(True), skip_if=F.lit(True)),
                "sources": lambda: LLMStep("s", {name: "x"}, grounding=True, sources_field=name),
                "field type": lambda: to_specs({"a": {"prompt": "x", "type": name}}),
                "grounding": lambda: LLMStep("s", {"a": "x"}, grounding={name: 1}),
                "csv": lambda: FieldManager(csv_file(folder, ["Category", name])),
                "category": lambda: FieldManager(csv_file(folder, ["Category", "Field", "Prompt"], ["a", "b", "c"])).get_category_fields(name),
                "on_error": lambda: EnrichmentConfig(on_error=name),
                "search size": lambda: web_search("q", search_context_size=name),
                "columns": lambda: Pipeline([one]).run(nations, columns=[name]),
            }
            for kind, attempt in wrong.items():
                try:
                    attempt()
                    rows.append((kind, name, None))
                except Exception as refused:
                    rows.append((kind, name, str(refused).replace(f"{folder}/", "")))
    return spark.createDataFrame(rows, "kind string, n_name string, message string")


@query("SELECT c_mktsegment, count(*) AS n_rows, true AS same, true AS by_rows, true AS by_steps FROM customer GROUP BY c_mktsegment")
def checkpoint_identity(spark, sf_dir):
    """A run's fingerprint: the same for the rows in any order, another for other rows, and marks that follow a step's settings."""
    from .config import EnrichmentConfig as Config
    from .hooks import EnrichmentHooks as Hooks
    from .plans.pipeline import _Run

    customers = table(spark, sf_dir, "customer")
    rows = []

    def run(frame, version="1"):
        step = FunctionStep("s", lambda ctx: {"a": "x"}, ["a"], cache_version=version, reads=[])
        return _Run(Pipeline([step]), frame, Config(), Hooks(), "spark", None)

    for segment in [r.c_mktsegment for r in customers.select("c_mktsegment").distinct().collect()]:
        own = customers.where(F.col("c_mktsegment") == segment)
        n = own.count()
        mark = run(own)._fingerprint(n)
        same = mark == run(own.orderBy(F.desc("c_custkey")))._fingerprint(n)
        other = mark != run(own.withColumn("c_acctbal", F.col("c_acctbal") + 1))._fingerprint(n)
        rows.append((segment, n, same, other, run(own)._marks() == run(own)._marks() != run(own, "2")._marks()))
    return spark.createDataFrame(rows, "c_mktsegment string, n_rows long, same boolean, by_rows boolean, by_steps boolean")
