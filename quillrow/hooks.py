"""Events of a run, and the callbacks that get them on the driver."""

from __future__ import annotations

import asyncio
import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .records import CostSummary, StepUsage

log = logging.getLogger("quillrow")


@dataclass(frozen=True)
class PipelineStartEvent:
    step_names: list[str]
    num_rows: int
    config: Any = None


@dataclass(frozen=True)
class PipelineEndEvent:
    num_rows: int
    total_errors: int
    cost: CostSummary = field(default_factory=CostSummary)
    elapsed_seconds: float = 0.0


@dataclass(frozen=True)
class StepStartEvent:
    step_name: str
    num_rows: int
    level: int


@dataclass(frozen=True)
class StepEndEvent:
    step_name: str
    num_rows: int
    num_errors: int
    usage: StepUsage | None = None
    elapsed_seconds: float = 0.0


@dataclass(frozen=True)
class RowCompleteEvent:
    step_name: str
    row_index: int
    values: dict[str, Any]
    error: str | None = None
    from_cache: bool = False


@dataclass
class EnrichmentHooks:
    """Plain or async callbacks; what they raise is logged and goes no further.

    ``on_row_complete`` brings every row's values through the driver, partition
    by partition: it is for tables that a person could look through.
    """

    on_pipeline_start: Callable | None = None
    on_pipeline_end: Callable | None = None
    on_step_start: Callable | None = None
    on_step_end: Callable | None = None
    on_row_complete: Callable | None = None

    def fire(self, name: str, event: Any) -> None:
        callback = getattr(self, name)
        if callback is None:
            return
        try:
            found = callback(event)
            if inspect.isawaitable(found):
                asyncio.run(_wait(found))
        except Exception:
            log.exception("hook %s failed", name)


async def _wait(awaitable: Any) -> Any:
    return await awaitable
