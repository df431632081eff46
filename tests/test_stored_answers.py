"""Answers in a column: the expression's check against the one in Python."""

import itertools
import json

import pytest

from quillrow import FunctionStep, LLMStep, Pipeline, PipelineError
from quillrow.clients.base import RuleClient
from quillrow.functions.answers import parse, to_column
from quillrow.functions.checks import checked_answer
from quillrow.functions.columns import list_cell
from quillrow.operators.stored import stored_answers
from quillrow.spec import to_specs

FIELDS = {
    "s": {"prompt": "s", "default": "none"}, "n": {"prompt": "n", "type": "Number"}, "b": {"prompt": "b", "type": "Boolean"},
    "l": {"prompt": "l", "type": "List[String]"}, "e": {"prompt": "e", "enum": ["Low", "High", "N/A"]}, "d": {"prompt": "d", "type": "Date", "default": None},
}
SPECS = to_specs(FIELDS)
GOOD = {"s": "x", "n": 12.5, "b": True, "l": ["a", ""], "e": "Low", "d": "2024-01-01"}
ODD = [None, "", " ", "x", "N/A", " Unknown\t", "é\u0130\u00a0", "\U0001f600", 0, 1, 2, -1, 1.0, 0.1, 1e300, 2**53 + 1, 10**17 + 1, 10**30, 0.30000000000000004, 123456789.987654321,
       "12.5", " 12.5 ", "1e5", "1_000", "007", "nan", True, False, "yes", "OFF", " t ", "maybe", [], [None], ["a", None], ["a", 1], ["a"], "[]", {}, {"k": 1}, "low", "High"]


def contents():
    whole = json.dumps(GOOD)
    yield from ("", " ", "null", "[]", "5", "{}", whole, f"  {whole}\n", whole + "}", whole + " x", f"{whole},{whole}", f"[{whole}]", whole[:-1], whole + "] ", f"```{whole}```",
                whole[:-1] + ', "s": "again"}', whole.replace("12.5", "NaN"), whole.replace("12.5", "-0.0"), whole.replace("12.5", "12.50"), whole.replace('"x"', '"\\ud83d"'),
                json.dumps({**GOOD, "more": 1}), json.dumps({**GOOD, "S": "x"}), whole.replace('"x"', "'x'"))
    for name, value in itertools.product(GOOD, ODD):
        yield json.dumps({**GOOD, name: value})
        yield json.dumps({**GOOD, name: value}, ensure_ascii=False)
    for name in GOOD:
        yield json.dumps({k: v for k, v in GOOD.items() if k != name})


def wanted(content):
    try:
        return {n: to_column(v, SPECS[n].spark_type) for n, v in parse(content, SPECS, True).items()}
    except Exception:
        return None


def test_what_is_sure_equals_the_python_check(spark):
    texts = [*contents(), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    found = {r["i"]: r["made"] for r in frame.select("i", checked_answer(frame["content"], SPECS).alias("made")).collect()}
    passed = 0
    for i, text in enumerate(texts):
        if found[i] is not None:
            assert text is not None and found[i].asDict() == wanted(text), text
            passed += 1
    good = sum(t is not None and wanted(t) is not None for t in texts)
    assert good > 100 and passed > good * 0.7  # most of what passes needs no Python
    assert found[texts.index(json.dumps(GOOD))] is not None


def test_plan_of_the_check_has_no_python(spark):
    frame = spark.range(3).selectExpr("cast(id as string) as content")
    plan = frame.select(checked_answer(frame["content"], SPECS).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_steps_agree_with_python_on_every_row(spark):
    texts = list(contents())
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    result = Pipeline(stored_answers("answer", "content", FIELDS)).run(frame)
    for r in result.data.collect():
        want = wanted(r["content"]) or dict.fromkeys(FIELDS)
        assert repr({n: r[n] for n in FIELDS}) == repr(want), r["content"]  # by text: NaN is unlike itself


def test_only_the_rest_is_asked_again(spark):
    frame = spark.createDataFrame([(1, json.dumps({"k": 1})), (2, "cut"), (3, None)], "i int, content string")
    fields = {"k": {"prompt": "k", "type": "Number"}}
    model = LLMStep("m", fields, client=RuleClient(lambda row, prior: {"k": 100 + row["i"]}), reads=["i"])
    result = Pipeline(stored_answers("answer", "content", fields, again=model)).run(frame)
    assert {r["i"]: r["k"] for r in result.data.collect()} == {1: 1.0, 2: 102.0, 3: 103.0}
    assert result.cost.steps["answer_rest"].rows_skipped == 1
    with pytest.raises(PipelineError):
        stored_answers("answer", "content", {"other": "x"}, again=model)


def test_steps_can_follow(spark):
    frame = spark.createDataFrame([('{"k": "v"}',)], "content string")
    after = FunctionStep("after", lambda ctx: {"twice": ctx.prior_results["k"] * 2}, ["twice"], depends_on=["answer"])
    assert Pipeline([*stored_answers("answer", "content", {"k": "k"}), after]).run(frame).data.first()["twice"] == "vv"


def test_list_cells_with_more_behind_the_array(spark):
    frame = spark.createDataFrame([('["a", "b"]',), ('["a"] b, c',), ("",), (None,)], "c string")
    assert [r[0] for r in frame.select(list_cell(frame["c"])).collect()] == [["a", "b"], ['["a"] b', "c"], [], None]
