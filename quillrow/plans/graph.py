"""The step graph: checks, levels, and who writes a field last."""

from __future__ import annotations

from ..errors import PipelineError


def levels(needs: list[tuple[str, list[str]]]) -> list[list[str]]:
    """Steps by level, sorted by name inside one; a step stands below all it depends on."""
    names = [n for n, _ in needs]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise PipelineError(f"step names must differ: {', '.join(twice)}")
    if not names:
        raise PipelineError("a pipeline needs at least one step")
    for name, on in needs:
        if unknown := [d for d in on if d not in names]:
            raise PipelineError(f"step {name!r} depends on unknown steps: {', '.join(unknown)}")
    left, out = dict(needs), []
    done: set[str] = set()
    while left:
        ready = sorted(n for n, on in left.items() if done.issuperset(on))
        if not ready:
            raise PipelineError(f"the steps {', '.join(sorted(left))} depend on each other in a cycle")
        out.append(ready)
        done.update(ready)
        for n in ready:
            del left[n]
    return out


def last_writers(order: list[str], fields: dict[str, list[str]]) -> dict[str, str]:
    """Field -> the step whose value counts; later steps of the order win."""
    return {f: step for step in order for f in fields[step]}
