"""Field definitions from a CSV file."""

from __future__ import annotations

import csv
import json
import logging
import os

from ..errors import FieldValidationError
from ..spec import FieldSpec

log = logging.getLogger("quillrow")
REQUIRED = ("Category", "Field", "Prompt")


def list_cell(cell: str | None) -> list[str] | None:
    """A JSON array, or parts between commas; None if nothing is in it."""
    text = (cell or "").strip()
    if not text:
        return None
    if text.startswith("["):
        try:
            found = json.loads(text)
            if isinstance(found, list):
                return [str(x) for x in found]
        except ValueError:
            pass
    return [p for x in text.split(",") if (p := x.strip())]


def _spec(row: dict[str, str]) -> FieldSpec:
    def cell(name: str) -> str | None:
        return (row.get(name) or "").strip() or None

    prompt = "\n".join(x for x in (cell("Prompt") or "", cell("Instructions"), cell("Guidance")) if x)
    given = {"type": cell("Type") or cell("Data_Type"), "format": cell("Format"), "default": cell("Default")}
    lists = {"enum": list_cell(row.get("Enum")), "examples": list_cell(row.get("Examples")), "bad_examples": list_cell(row.get("Bad_Examples"))}
    return FieldSpec(prompt, **{k: v for k, v in {**given, **lists}.items() if v is not None})


class FieldManager:
    """Field categories of a CSV file: the columns Category, Field and Prompt, and optional ones."""

    def __init__(self, path: str):
        self.path = path
        if not os.path.exists(path):
            raise FieldValidationError(f"no such field file: {path}")
        try:
            with open(path, newline="", encoding="utf-8-sig") as file:
                reader = csv.DictReader(file, strict=True)
                names, rows = reader.fieldnames, list(reader)
        except (csv.Error, UnicodeDecodeError) as problem:
            raise FieldValidationError(f"{path} is not a readable CSV file: {problem}") from problem
        if not names:
            raise FieldValidationError(f"{path} is empty")
        if missing := [c for c in REQUIRED if c not in names]:
            raise FieldValidationError(f"{path} lacks the columns {', '.join(missing)}")
        self.categories: dict[str, dict[str, FieldSpec]] = {}
        for number, row in enumerate(rows, 2):
            category, name = (row["Category"] or "").strip(), (row["Field"] or "").strip()
            if not category or not name:
                log.warning("%s, line %d: no category or field; skipped", path, number)
                continue
            self.categories.setdefault(category, {})[name] = _spec(row)
        if not self.categories:
            raise FieldValidationError(f"{path} has no valid categories")

    def get_categories(self) -> list[str]:
        return list(self.categories)

    def validate_category(self, category: str) -> bool:
        return category in self.categories

    def get_category_fields(self, category: str) -> dict[str, FieldSpec]:
        if category not in self.categories:
            raise FieldValidationError(f"no category {category!r}; there are {', '.join(self.categories)}")
        return dict(self.categories[category])

    def get_field_count(self, category: str | None = None) -> int:
        if category is None:
            return sum(map(len, self.categories.values()))
        return len(self.categories.get(category, {}))

    def __str__(self) -> str:
        return f"FieldManager({self.path}: {len(self.categories)} categories, {self.get_field_count()} fields)"


def load_fields(path: str, category: str | None = None) -> dict[str, dict]:
    """Field dicts of one category, or of all; of equal names the later category's counts."""
    manager = FieldManager(path)
    chosen = [category] if category is not None else manager.get_categories()
    return {name: spec.as_dict() for c in chosen for name, spec in manager.get_category_fields(c).items()}
