"""Web search as the function of a function step."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..clients.base import LLMAPIError
from ..records import StepContext

SIZES = ("low", "medium", "high")
TOOLS = ("web_search", "web_search_preview")


def web_search(
    query: str, *, model: str = "gpt-4.1-mini", search_context_size: str = "medium", api_key: str | None = None, include_sources: bool = True,
    user_location: dict | None = None, allowed_domains: list[str] | None = None, tool_type: str = "web_search", backend: Callable[[str, dict], Any] | None = None,
) -> Callable[[StepContext], Any]:
    """An async function giving ``__web_context`` (text) and ``sources`` (urls) for ``query.format(**row, **prior)``.

    ``backend(query, options)`` awaits to (text parts, urls); without one the
    OpenAI client is used.  The last text part is kept and urls are not
    deduplicated.  Failures of the service give empty results; a template field
    that the row lacks is an error.
    """
    if search_context_size not in SIZES:
        raise ValueError(f"search_context_size is one of {', '.join(SIZES)}")
    if tool_type not in TOOLS:
        raise ValueError(f"tool_type is one of {', '.join(TOOLS)}")
    if allowed_domains and tool_type != "web_search":
        raise ValueError("allowed_domains needs tool_type 'web_search'")
    tool: dict[str, Any] = {"type": tool_type, "search_context_size": search_context_size}
    if user_location:
        tool["user_location"] = {"type": "approximate", **user_location}
    if allowed_domains:
        tool["filters"] = {"allowed_domains": list(allowed_domains)}

    async def search(ctx: StepContext) -> dict[str, Any]:
        try:
            text = query.format(**{**ctx.row, **ctx.prior_results})
        except KeyError as missing:
            raise ValueError(f"search template field {missing} is not in the row") from None
        use = backend
        if use is None:
            from ..clients.vendors import openai_search as use
        try:
            parts, urls = await use(text, {"model": model, "api_key": api_key, "tool": tool})
        except (LLMAPIError, TimeoutError, ConnectionError):
            return {"__web_context": "", "sources": []}
        return {"__web_context": parts[-1] if parts else "", "sources": list(urls) if include_sources else []}

    return search


WEB_TYPES = {"__web_context": "string", "sources": "array<string>"}
