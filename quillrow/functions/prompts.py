"""System messages of model steps.

What is equal for all rows of a step comes first, so that providers can cache
it; the row follows, and the form of the answer is said once more at the end.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from ..spec import FieldSpec


@dataclass(frozen=True)
class Key:
    """A part of a field's definition: how it is tagged, what it means, and what an answer owes it."""

    name: str
    tag: str
    meaning: str
    duty: str | None = None

    def values(self, spec: FieldSpec) -> list[Any]:
        """What a field says under this key, nothing if it leaves it open; a type is said unless it is String."""
        if self.name == "default":
            return [spec.default] if spec.has_default else []
        value = getattr(spec, self.name)
        if value is None or self.name == "type" and value == "String":
            return []
        if self.name == "enum":
            return [", ".join(value)]
        return list(value) if isinstance(value, tuple) else [value]


KEYS = (
    Key("prompt", "prompt", "the question this field answers"),
    Key("type", "type", "kind of value: String, Number, Boolean, Date, List[String] or JSON"),
    Key("format", "format", "shape the value takes", "A value with a `format` has exactly that shape."),
    Key("enum", "enum", "the closed list of values", "A field with an `enum` takes one of its values, spelt as listed."),
    Key("examples", "example", "an answer of the wanted kind"),
    Key("bad_examples", "bad_example", "an answer of an unwanted kind"),
    Key("default", "default", "the value for a field that stays unknown"),
)
TASK = "You complete rows of a table. Below are the fields to fill, one row, and what earlier steps found out about it."
#: As ``json.dumps`` writes, but made once.
_PLAIN = json.JSONEncoder(default=str)
UNKNOWN = "A field that row, earlier results and general knowledge leave open is {instead}."
USER_TURN = "Fill in the fields for this row."


def used_keys(specs: dict[str, FieldSpec]) -> set[str]:
    """Optional keys that some field uses; a default counts whenever it is given, even as null."""
    return {k.name for k in KEYS if k.name != "prompt" and any(k.values(s) for s in specs.values())}


def _listed(title: str, lines: list[str]) -> str:
    return "\n".join([f"## {title}", *(f"* {x}" for x in lines)])


def instructions(specs: dict[str, FieldSpec], header: str | None = None) -> str:
    """Task, background, the keys in use, and what an answer has to be."""
    used = used_keys(specs) | {"prompt"}
    duties = [f"One JSON object, bare, with these keys and no others: {', '.join(specs)}.", *(k.duty for k in KEYS if k.duty and k.name in used)]
    duties.append(UNKNOWN.format(instead="its `default`" if "default" in used else '"Unable to determine" if it is a String, else null'))
    parts = [TASK, f"## Background\n{header}" if header else "", _listed("Reading a field", [f"`{k.name}`: {k.meaning}" for k in KEYS if k.name in used]), _listed("Answer", duties)]
    return "\n\n".join(filter(None, parts))


def field_block(specs: dict[str, FieldSpec]) -> str:
    """The field definitions, tagged; keys that a field leaves open have no tag."""

    def field(name: str, spec: FieldSpec) -> str:
        return "".join([f'<field name="{name}">\n', *(f"  <{k.tag}>{v}</{k.tag}>\n" for k in KEYS for v in k.values(spec)), "</field>\n"])

    return f"<field_specifications>\n{''.join(field(*item) for item in specs.items())}</field_specifications>"


class Prompt:
    """A step's message builder; what doesn't depend on the row is made once."""

    def __init__(self, specs: dict[str, FieldSpec], system_prompt: str | None = None, header: str | None = None):
        self.head = instructions(specs, header) if system_prompt is None else system_prompt
        self.fields, self.tail = field_block(specs), f"Now answer with the JSON object alone, keys {', '.join(specs)}."

    def build(self, row: dict[str, Any], prior: dict[str, Any] | None = None) -> str:
        def tagged(tag: str, value: Any) -> str:
            return f"<{tag}>\n{_PLAIN.encode(value)}\n</{tag}>"

        return "\n\n".join([self.head, tagged("row_data", row), self.fields, *([tagged("prior_results", prior)] if prior else []), self.tail])


def correction(problem: str, names: list[str]) -> str:
    """The turn after an answer that could not be used."""
    return f"That answer could not be used: {problem}\nAnswer again with one JSON object holding exactly: {', '.join(names)}"
