"""Pieces that need no Spark session."""

import pickle

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillrow import ColumnStep, EnrichmentConfig, FieldSpec, FunctionStep, GroundingConfig, LLMStep, Pipeline, load_fields
from quillrow.clients.vendors import anthropic_tool, google_tool, openai_tool
from quillrow.errors import ConfigurationError, FieldValidationError, PipelineError
from quillrow.functions.answers import is_refusal, parse, response_schema, validate
from quillrow.functions.columns import REFUSALS
from quillrow.functions.prompts import Prompt, used_keys
from quillrow.operators.model import distinct_citations
from quillrow.plans.graph import last_writers, levels
from quillrow.sources.fields import FieldManager, list_cell
from quillrow.spec import to_spec, to_specs, typed_default


def test_levels_sort_by_name_inside_a_level():
    assert levels([("d", ["b", "c"]), ("c", ["a"]), ("b", ["a"]), ("a", [])]) == [["a"], ["b", "c"], ["d"]]


@pytest.mark.parametrize(
    "needs, words",
    [([("a", []), ("a", [])], "differ"), ([("a", ["x"])], "unknown"), ([("a", ["b"]), ("b", ["a"])], "cycle"), ([], "at least one")],
)
def test_wrong_graphs(needs, words):
    with pytest.raises(PipelineError, match=words):
        levels(needs)


def test_last_writer_wins():
    assert last_writers(["a", "b"], {"a": ["x", "y"], "b": ["x"]}) == {"x": "b", "y": "a"}


def test_run_if_and_skip_if_exclude_each_other():
    for make in (lambda: FunctionStep("s", len, ["f"], run_if=len, skip_if=len), lambda: ColumnStep("s", {}, run_if=1, skip_if=1), lambda: LLMStep("s", ["f"], run_if=len, skip_if=len)):
        with pytest.raises(PipelineError, match="exclude"):
            make()


@pytest.mark.parametrize("bad", [{"temperature": 3}, {"max_tokens": 0}, {"max_workers": 0}, {"max_retries": -1}, {"cache_ttl": -1}, {"on_error": "stop"}, {"enable_checkpointing": True}])
def test_wrong_settings(bad):
    with pytest.raises(ConfigurationError):
        EnrichmentConfig(**bad)


def test_presets():
    assert EnrichmentConfig.for_development().max_workers == 5
    assert EnrichmentConfig.for_production("/shared").checkpoint_interval == 100
    assert EnrichmentConfig.for_server(max_retries=2).max_retries == 2


def test_field_specs():
    assert to_spec("p") == FieldSpec("p")
    assert to_spec({"prompt": "p", "default": None}).has_default and not FieldSpec("p").has_default
    assert not pickle.loads(pickle.dumps(FieldSpec("p"))).has_default
    assert typed_default(FieldSpec("p", "Number", default="1.5")) == 1.5
    for wrong in ({"prompt": "p", "kind": 1}, {"type": "String"}, {"prompt": "p", "type": "Text"}, 5):
        with pytest.raises(FieldValidationError):
            to_spec(wrong)
    with pytest.raises(FieldValidationError):
        typed_default(FieldSpec("p", "Number", default="x"))


SPECS = to_specs(
    {"s": "text", "n": {"prompt": "n", "type": "Number"}, "b": {"prompt": "b", "type": "Boolean"}, "l": {"prompt": "l", "type": "List[String]"},
     "j": {"prompt": "j", "type": "JSON"}, "e": {"prompt": "e", "enum": ["Low", "High"]}}
)
GOOD = {"s": "x", "n": "12.5", "b": "yes", "l": ["a"], "j": {"k": 1}, "e": "Low"}


def test_validation_is_lax_for_numbers_and_strict_for_text():
    assert validate(GOOD, SPECS) == {**GOOD, "n": 12.5, "b": True}
    for name, value in [("s", 5), ("s", None), ("n", None), ("n", "x"), ("b", 2), ("b", "maybe"), ("l", "a"), ("l", [1]), ("j", "{}"), ("e", "low")]:
        with pytest.raises(FieldValidationError):
            validate({**GOOD, name: value}, SPECS)
    with pytest.raises(FieldValidationError, match="missing"):
        validate({k: v for k, v in GOOD.items() if k != "s"}, SPECS)
    with pytest.raises(FieldValidationError, match="not asked"):
        validate({**GOOD, "more": 1}, SPECS)


@given(st.sampled_from(REFUSALS), st.sampled_from(["", " ", "\t", "\n", " ", " "]), st.booleans())
def test_refusals(text, edge, loud):
    assert is_refusal(edge + (text.upper() if loud else text) + edge)
    assert not is_refusal(f"x{text}")


def test_defaults_replace_refusals_only_where_present():
    specs = to_specs({"a": {"prompt": "a", "default": "none"}, "b": "b"})
    assert parse('{"a": "N/A"}', specs, False) == {"a": "none"}
    assert parse('{"b": "N/A", "c": 1}', specs, False) == {"b": "N/A"}
    with pytest.raises(ValueError):
        parse("```{}```", specs, False)


def test_response_schema_lists_every_field():
    schema = response_schema(SPECS)["json_schema"]["schema"]
    assert schema["required"] == list(SPECS) and schema["additionalProperties"] is False
    assert schema["properties"]["e"]["enum"] == ["Low", "High"]


def test_prompt_names_only_used_keys():
    assert used_keys(to_specs({"a": "x"})) == set()
    assert used_keys(to_specs({"a": {"prompt": "x", "default": None}})) == {"default"}
    text = Prompt(to_specs({"a": {"prompt": "x", "enum": ["p", "q"]}}), header="Banks").build({"r": 1}, {"old": "y"})
    assert "## Background\nBanks" in text and "  <enum>p, q</enum>" in text and '<prior_results>\n{"old": "y"}\n</prior_results>' in text and "`format`" not in text
    own = Prompt(to_specs({"a": "x"}), system_prompt="Do it", header="Banks").build({})
    assert own.startswith("Do it") and "Banks" not in own and own.endswith("keys a.") and "<prior_results>" not in own


def test_prompt_parts_stand_in_order():
    every = {"type": "Number", "format": "0.0", "enum": ["1.0", "2.0"], "examples": ["1.0"], "bad_examples": ["one", "two"], "default": None}
    specs = to_specs({"plain": "the first", "full": {"prompt": "the second", **every}})
    assert used_keys(specs) == set(every)
    text = Prompt(specs).build({"r": None, "d": 1.5})
    assert [text.index(x) for x in ("## Reading", "## Answer", "<row_data>", "<field_specifications>", "Now answer")] == sorted(text.index(x) for x in ("## Reading", "## Answer", "<row_data>", "<field_specifications>", "Now answer"))
    assert '<row_data>\n{"r": null, "d": 1.5}\n</row_data>' in text
    assert '<field name="plain">\n  <prompt>the first</prompt>\n</field>' in text
    tags = ["prompt>the second", "type>Number", "format>0.0", "enum>1.0, 2.0", "example>1.0", "bad_example>one", "bad_example>two", "default>None"]
    assert '<field name="full">\n' + "".join(f"  <{t}</{t.split('>')[0]}>\n" for t in tags) + "</field>" in text
    assert "its `default`" in text and "its `default`" not in Prompt(to_specs({"a": "x"})).build({})


def test_response_format_choice():
    fields = {"a": "x"}
    assert LLMStep("s", fields).structured
    assert not LLMStep("s", ["a"]).structured and not LLMStep("s", fields, base_url="http://x").structured
    assert not LLMStep("s", fields, client=object()).structured and not LLMStep("s", fields, schema=dict).structured
    assert not LLMStep("s", fields, structured_outputs=False).structured


def test_grounding():
    assert GroundingConfig.of(False) is None and GroundingConfig.of(True).tool() == {"type": "web_search"}
    with pytest.raises(PipelineError):
        GroundingConfig.of({"site": "x"})
    with pytest.raises(PipelineError, match="sources"):
        LLMStep("s", {"sources": "x"}, grounding=True)
    LLMStep("s", {"sources": "x"})
    tool = GroundingConfig.of({"allowed_domains": ["a"], "max_searches": 2}).tool()
    with pytest.warns(UserWarning):
        assert openai_tool(tool)["filters"] == {"allowed_domains": ["a"]}
    assert anthropic_tool(tool)["max_uses"] == 2
    with pytest.warns(UserWarning):
        assert google_tool(tool) == {"google_search": {}}


def test_citations_keep_the_first_of_each_url():
    got = distinct_citations([{"url": "a", "title": "1"}, {"url": ""}, {"url": None}, {"url": "b"}, {"url": "a", "title": "2"}])
    assert [(c["url"], c["title"]) for c in got] == [("a", "1"), ("b", None)]


def test_list_cells():
    assert list_cell('["a", "b, c"]') == ["a", "b, c"] and list_cell("a, b,,") == ["a", "b"]
    assert list_cell("") is None and list_cell("[broken, x") == ["[broken", "x"]


def test_field_files(tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("Category,Field,Prompt,Data_Type,Guidance\na,x,ask,Number,hint\nb,x,again,,\n,lost,p,,\n")
    manager = FieldManager(str(path))
    assert manager.get_categories() == ["a", "b"] and manager.get_field_count() == 2 and manager.get_field_count("zz") == 0
    assert manager.get_category_fields("a")["x"] == FieldSpec("ask\nhint", "Number")
    assert load_fields(str(path))["x"]["prompt"] == "again"
    with pytest.raises(FieldValidationError, match="there are a, b"):
        load_fields(str(path), "zz")
    for text in ("", "Category,Field\na,b\n", "Category,Field,Prompt\n,,\n"):
        path.write_text(text)
        with pytest.raises(FieldValidationError):
            FieldManager(str(path))
    with pytest.raises(FieldValidationError, match="no such"):
        FieldManager(str(tmp_path / "none.csv"))


def test_pipeline_shape():
    p = Pipeline([ColumnStep("b", {"y": None}, ["a"]), ColumnStep("a", {"x": None})])
    assert p.step_names == ["a", "b"] and p.execution_levels == [["a"], ["b"]]
    with pytest.raises(KeyError):
        p.get_step("zz")
    assert p.only(["x"]).step_names == ["a"]
