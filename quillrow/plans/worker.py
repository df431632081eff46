"""What runs in a Python worker: all Python steps of one level, as one Arrow function of the columns they read."""

from __future__ import annotations

import asyncio
import inspect
import json
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa

from ..functions.answers import to_column
from ..operators.steps import PythonStep
from ..records import StepContext
from .budget import Budget, Gate, current_gate

#: Rows whose Python objects live at the same time.
ROWS = 1024


@dataclass(frozen=True)
class StepPlan:
    """Where a step's inputs stand in a batch, and the Arrow type of its output."""

    step: PythonStep
    reads: list[str]
    prior: list[tuple[str, list[str]]]
    fields: dict[str, Any]
    verdict: str | None
    hit: str | None
    output: str
    kind: pa.DataType


def _typed(step: PythonStep, values: dict[str, Any]) -> dict[str, Any]:
    return {f: to_column(values.get(f), kind) for f, kind in step.types.items()}


async def _wanted(step: PythonStep, row: dict, prior: dict, verdict: bool | None) -> bool:
    if verdict is not None:
        return verdict
    for predicate, runs in ((step.run_if, True), (step.skip_if, False)):
        if callable(predicate):
            found = predicate(row, prior)
            if inspect.isawaitable(found):
                found = await found
            return bool(found) is runs
    return True


async def _called(plan: StepPlan, context: StepContext, gate: Gate | None) -> Any:
    """The step's answer, given while this task holds a lease of the run's call budget."""
    if gate is None:
        return await plan.step.run(context)
    lease = await gate.take()
    try:
        return await plan.step.run(context)
    finally:
        gate.give(lease)


async def one_row(plan: StepPlan, row: dict, prior: dict, verdict: bool | None, hit: str | None, config: Any, gate: Gate | None = None) -> dict[str, Any]:
    """A row's output record; whatever the step raises becomes its error."""
    out = {"values": None, "error": None, "skipped": False, "from_cache": False, "usage": None}
    try:
        if not await _wanted(plan.step, row, prior, verdict):
            out |= {"values": plan.step.skipped(), "skipped": True}
        elif hit is not None:
            out |= {"values": _typed(plan.step, json.loads(hit)), "from_cache": True}
        else:
            result = await _called(plan, StepContext(row, plan.fields, prior, config), gate)
            out["values"] = _typed(plan.step, result.values)
            out["usage"] = vars(result.usage) if result.usage else None
    except Exception as problem:
        out |= {"values": None, "error": {"type": type(problem).__name__, "message": str(problem)}}
    return out


def _now(coroutine: Any) -> Any:
    """The value of a coroutine that never waits."""
    try:
        coroutine.send(None)
    except StopIteration as done:
        return done.value
    coroutine.close()
    raise RuntimeError("a step declared as plain waited for something")


def _waits(step: PythonStep) -> bool:
    plain = getattr(step, "is_async", True) is False and not step.external
    return not plain or any(inspect.iscoroutinefunction(p) for p in (step.run_if, step.skip_if))


def level_function(plans: list[StepPlan], config: Any, budget: Budget | None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """All steps of a level in one pass; calls that wait do so under the run's budget.

    Takes structs of the columns that the steps read and gives structs of their
    outputs, so that other columns stay in the JVM.
    """

    def work(structs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting = [p for p in plans if _waits(p.step)]
        loop = asyncio.new_event_loop() if waiting else None
        gate = Gate(budget) if waiting and budget else None
        kind = pa.struct([pa.field(p.output, p.kind) for p in plans])
        try:
            if gate:
                loop.set_default_executor(ThreadPoolExecutor(budget.limit))  # plain external calls wait in threads
                loop.run_until_complete(gate.open())
            for whole in structs:
                done = []
                for start in range(0, len(whole), ROWS):
                    batch = pa.RecordBatch.from_struct_array(whole.slice(start, ROWS))
                    jobs = {p.output: list(_inputs(p, batch)) for p in plans}
                    found: dict[str, list] = {}
                    for p in plans:
                        if p not in waiting:
                            found[p.output] = [_now(one_row(p, *job, config)) for job in jobs[p.output]]
                    if waiting:
                        found |= loop.run_until_complete(_together(waiting, jobs, config, gate))
                    done.append(pa.StructArray.from_arrays([pa.array(found[p.output], p.kind) for p in plans], fields=list(kind)))
                yield pa.concat_arrays(done) if done else pa.array([], kind)
        finally:
            if gate and gate.writer:
                gate.close()
            if loop:
                loop.run_until_complete(asyncio.sleep(0))  # lets what was closed end
                loop.close()

    return work


def _inputs(plan: StepPlan, batch: pa.RecordBatch) -> Iterator[tuple]:
    """row, prior, verdict, hit of every row."""
    rows = batch.select(plan.reads).to_pylist() if plan.reads else [{} for _ in range(batch.num_rows)]
    earlier = [(fields, batch.column(batch.schema.get_field_index(name)).field("values").to_pylist()) for name, fields in plan.prior]
    verdicts = batch.column(batch.schema.get_field_index(plan.verdict)).to_pylist() if plan.verdict else [None] * batch.num_rows
    hits = batch.column(batch.schema.get_field_index(plan.hit)).to_pylist() if plan.hit else [None] * batch.num_rows
    for i, row in enumerate(rows):
        prior: dict[str, Any] = {}
        for fields, values in earlier:
            own = values[i] or {}
            prior |= {f: own.get(f) for f in fields}
        yield row, prior, verdicts[i], hits[i]


def _may_call(row: dict, prior: dict, verdict: bool | None, hit: str | None) -> bool:
    return hit is None and verdict is not False


def _begun(coroutine: Any, loop: asyncio.AbstractEventLoop) -> asyncio.Task:
    """A task that has run up to where it first waits, so that one that never does costs no turn of the loop."""
    return asyncio.Task(coroutine, loop=loop, eager_start=True) if sys.version_info >= (3, 12) else loop.create_task(coroutine)


async def _together(plans: list[StepPlan], jobs: dict[str, list], config: Any, gate: Gate | None) -> dict[str, list]:
    current_gate.set(gate)
    loop = asyncio.get_running_loop()
    tasks: dict[str, list[asyncio.Task]] = {p.output: [] for p in plans}
    for p in plans:
        for job in jobs[p.output]:
            if gate and not gate.spare and _may_call(*job):
                await gate.ready()
            tasks[p.output].append(_begun(one_row(p, *job, config, gate), loop))
    if gate:
        gate.started()
    if waiting := [t for own in tasks.values() for t in own if not t.done()]:
        await asyncio.wait(waiting)
    if gate:
        await gate.settle()
    return {name: [t.result() for t in own] for name, own in tasks.items()}
