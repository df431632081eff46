"""Column steps and function steps."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from ..errors import PipelineError
from ..records import StepContext, StepResult
from ..spec import FieldSpec, to_specs, typed_default


def one_predicate(name: str, run_if: Any, skip_if: Any) -> None:
    if run_if is not None and skip_if is not None:
        raise PipelineError(f"step {name!r}: run_if and skip_if exclude each other")


class ColumnStep:
    """Fields as column expressions: the fast path, no Python worker.

    ``columns`` maps a field to a Column or to ``f(row, prior) -> Column``, where
    row and prior map names to Columns.  Predicates have the same two forms; a
    null predicate counts as false.  ``defaults`` are the values of skipped rows.
    """

    in_python = False
    cache = False

    def __init__(self, name: str, columns: dict[str, Any], depends_on: list[str] | None = None, run_if: Any = None, skip_if: Any = None, defaults: dict[str, Any] | None = None):
        one_predicate(name, run_if, skip_if)
        self.name, self.columns, self.depends_on = name, columns, list(depends_on or [])
        self.run_if, self.skip_if, self.defaults = run_if, skip_if, defaults or {}
        self.fields = list(columns)
        self.specs: dict[str, FieldSpec] = {}


class PythonStep:
    """What steps that run in a Python worker share."""

    in_python = True
    external = False
    specs: dict[str, FieldSpec] = {}

    def skipped(self) -> dict[str, Any]:
        """Values of a skipped row: given defaults, else null."""
        return {f: typed_default(self.specs[f]) if f in self.specs and self.specs[f].has_default else None for f in self.types}


class FunctionStep(PythonStep):
    """``fn(ctx) -> dict`` over every row, plain or async; undeclared keys are dropped.

    ``types`` gives fields their Spark types (string otherwise); ``reads`` names
    the only columns the function looks at, so that others are not sent to it.
    ``external`` marks calls that cost: plain functions then run in threads and
    the step's results are stored before anything reads them.
    """

    def __init__(
        self, name: str, fn: Callable[[StepContext], Any], fields: list[str] | dict, depends_on: list[str] | None = None, cache: bool = True,
        cache_version: str | None = None, run_if: Any = None, skip_if: Any = None, types: dict[str, str] | None = None,
        reads: list[str] | None = None, external: bool = False,
    ):
        one_predicate(name, run_if, skip_if)
        self.name, self.fn, self.depends_on = name, fn, list(depends_on or [])
        self.specs = to_specs(fields) if isinstance(fields, dict) else {}
        self.fields = list(fields)
        self.types = {f: (types or {}).get(f) or (self.specs[f].spark_type if f in self.specs else "string") for f in self.fields}
        self.cache, self.cache_version, self.reads, self.external = cache, cache_version, reads, external
        self.run_if, self.skip_if = run_if, skip_if
        self.is_async = inspect.iscoroutinefunction(fn)
        self.skipped()

    def key_parts(self) -> dict[str, Any]:
        return {"step": self.name, "version": self.cache_version}

    async def run(self, ctx: StepContext) -> StepResult:
        if self.is_async:
            found = await self.fn(ctx)
        elif self.external:
            found = await asyncio.to_thread(self.fn, ctx)
        else:
            found = self.fn(ctx)
        return StepResult({k: v for k, v in found.items() if k in self.types})


class CustomStep(PythonStep):
    """A user's own step object, its outputs cut to its declared fields."""

    def __init__(self, step: Any):
        self.step, self.name, self.depends_on = step, step.name, list(step.depends_on or [])
        self.fields = list(step.fields)
        self.types = {f: getattr(step, "types", {}).get(f, "string") for f in self.fields}
        self.cache, self.reads = getattr(step, "cache", True), getattr(step, "reads", None)
        self.run_if, self.skip_if = getattr(step, "run_if", None), getattr(step, "skip_if", None)
        self.external = getattr(step, "external", False)
        one_predicate(self.name, self.run_if, self.skip_if)

    def key_parts(self) -> dict[str, Any]:
        return {"step": self.name, "model": getattr(self.step, "model", None), "version": getattr(self.step, "cache_version", None)}

    async def run(self, ctx: StepContext) -> StepResult:
        return await self.step.run(ctx)


def to_step(step: Any) -> ColumnStep | PythonStep:
    return step if isinstance(step, (ColumnStep, PythonStep)) else CustomStep(step)


def as_column(value: Any, row: dict[str, Column], prior: dict[str, Column]) -> Column:
    return value if isinstance(value, Column) else value(row, prior)
