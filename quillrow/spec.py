"""Field definitions and their Spark types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from .errors import FieldValidationError

#: Output type of a field -> Spark type of its column.  A JSON object is kept as canonical text.
SPARK_TYPES = {
    "String": "string",
    "Number": "double",
    "Boolean": "boolean",
    "Date": "string",
    "List[String]": "array<string>",
    "JSON": "string",
}
_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=str)
_UNSET: Any = type("Unset", (), {"__repr__": lambda s: "UNSET", "__reduce__": lambda s: "_UNSET"})()


@dataclass(frozen=True)
class FieldSpec:
    """What a field holds.  ``default`` counts as given even when it is None."""

    prompt: str
    type: str = "String"
    format: str | None = None
    enum: tuple[str, ...] | None = None
    examples: tuple[str, ...] | None = None
    bad_examples: tuple[str, ...] | None = None
    default: Any = field(default=_UNSET)

    def __post_init__(self):
        if not isinstance(self.prompt, str):
            raise FieldValidationError("a field needs a prompt")
        if self.type not in SPARK_TYPES:
            raise FieldValidationError(f"unknown field type {self.type!r}; known: {', '.join(SPARK_TYPES)}")
        for name in ("enum", "examples", "bad_examples"):
            value = getattr(self, name)
            if value is not None:
                if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                    raise FieldValidationError(f"{name} must be a list of strings")
                object.__setattr__(self, name, tuple(value))

    @property
    def has_default(self) -> bool:
        return self.default is not _UNSET

    @property
    def spark_type(self) -> str:
        return "string" if self.enum else SPARK_TYPES[self.type]

    def as_dict(self) -> dict[str, Any]:
        """Only what is set."""
        names = ("type", "format", "enum", "examples", "bad_examples")
        found = {"prompt": self.prompt} | {n: getattr(self, n) for n in names if getattr(self, n) is not None}
        found = {k: list(v) if isinstance(v, tuple) else v for k, v in found.items()}
        return found | ({"default": self.default} if self.has_default else {})


def to_spec(value: FieldSpec | dict | str) -> FieldSpec:
    """A spec from its short forms: the prompt alone, or a dict of known keys."""
    if isinstance(value, FieldSpec):
        return value
    if isinstance(value, str):
        return FieldSpec(value)
    if isinstance(value, dict):
        known = set(FieldSpec.__dataclass_fields__)
        if extra := set(value) - known:
            raise FieldValidationError(f"unknown field keys: {', '.join(sorted(extra))}")
        if "prompt" not in value:
            raise FieldValidationError("a field needs a prompt")
        return FieldSpec(**value)
    raise FieldValidationError(f"a field is a prompt, a dict or a FieldSpec, not {type(value).__name__}")


def to_specs(fields: dict | list | tuple) -> dict[str, FieldSpec]:
    """Specs by name; a plain list of names gives each an empty prompt."""
    if isinstance(fields, dict):
        return {name: to_spec(value) for name, value in fields.items()}
    return {name: FieldSpec("") for name in fields}


def typed_default(spec: FieldSpec) -> Any:
    """The default as a value of the field's column; wrong ones are refused when the plan is built."""
    value = spec.default
    if value is None:
        return None
    kind = spec.spark_type
    try:
        if kind == "double":
            return float(value)
        if kind == "boolean":
            if isinstance(value, str):
                return {"true": True, "false": False}[value.strip().lower()]
            return bool(value)
        if kind == "array<string>":
            return [str(x) for x in ([value] if isinstance(value, str) else value)]
    except (KeyError, TypeError, ValueError):
        raise FieldValidationError(f"default {value!r} doesn't fit type {spec.type}") from None
    return value if isinstance(value, str) else canonical_json(value)


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces; other objects as text."""
    return _CANONICAL.encode(value)
