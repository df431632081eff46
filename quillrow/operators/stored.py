"""Fields from answers that stand in a column already, with Python or a model only for what fails there."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PipelineError
from ..functions.answers import parse
from ..functions.checks import checked_answer
from ..plans.pipeline import quoted
from ..spec import to_specs
from .model import LLMStep
from .steps import ColumnStep, FunctionStep, PythonStep


def stored_answers(name: str, content: str, fields: dict, depends_on: list[str] | None = None, again: LLMStep | None = None) -> list[ColumnStep | PythonStep]:
    """Steps that read the strict answers of column ``content``: name_read, name_rest, and ``name`` with the fields.

    Answers that surely pass are read by column expressions; only the rest
    goes to a Python worker, where it is parsed as a model step's answer would
    be.  With ``again``, a model step over the same fields, the rest is asked
    anew instead, corrections included.  A row that fails there has the error
    of name_rest and null fields.
    """
    specs = to_specs(fields)
    if not specs:
        raise PipelineError(f"step {name!r} has no fields")
    read, rest = f"{name}_read", f"{name}_rest"
    before = list(depends_on or [])
    # not by the field of name_read, which would then be among what the model is told of earlier steps
    undecided = checked_answer(F.col(quoted(content)), specs).isNull()
    first = ColumnStep(read, {"__checked": lambda row, prior: checked_answer(row[content], specs)}, depends_on=before)
    if again is None:
        def parsed(ctx: Any) -> dict[str, Any]:
            return parse(ctx.row[content] or "", specs, True)

        types = {n: s.spark_type for n, s in specs.items()}
        second: PythonStep = FunctionStep(rest, parsed, list(specs), depends_on=before, run_if=undecided, types=types, reads=[content])
    else:
        if sorted(again.specs) != sorted(specs) or again.run_if is not None or again.skip_if is not None:
            raise PipelineError(f"step {name!r}: the model step that asks again has the same fields and no predicate")
        second = copy.copy(again)
        second.name, second.run_if = rest, undecided

    def chosen(field: str) -> Callable[[dict[str, Column], dict[str, Column]], Column]:
        return lambda row, prior: F.when(prior["__checked"].isNotNull(), prior["__checked"][field]).otherwise(prior[field])

    return [first, second, ColumnStep(name, {n: chosen(n) for n in specs}, depends_on=[read, rest])]
