"""What a model client is, and one that answers by rule."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from ..records import UsageInfo


@dataclass(frozen=True)
class LLMResponse:
    content: str
    usage: UsageInfo | None = None
    citations: list = field(default_factory=list)


class LLMAPIError(Exception):
    """A call that failed outside the answer's content, and may be retried."""

    def __init__(self, message: str, status_code: int | None = None, retry_after: float | None = None, is_rate_limit: bool = False):
        super().__init__(message)
        self.status_code, self.retry_after = status_code, retry_after
        self.is_rate_limit = is_rate_limit or status_code == 429


@runtime_checkable
class LLMClient(Protocol):
    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None) -> LLMResponse: ...


def tagged(message: str, tag: str) -> dict[str, Any]:
    """A JSON block of a system message, empty if it isn't there."""
    found = re.search(rf"<{tag}>\n(.*?)\n</{tag}>", message, re.DOTALL)
    return json.loads(found[1]) if found else {}


class RuleClient:
    """Answers from the row by a function: no network, the same answer each time.

    ``rule(row, prior)`` gives the fields as a dict, or raw text; tokens are
    counted as words of the prompt's row and of the answer.
    """

    structured_outputs = True

    def __init__(self, rule: Callable[[dict, dict], Any], citations: Callable[[dict], list] | None = None):
        self.rule, self.citations = rule, citations

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None) -> LLMResponse:
        row, prior = tagged(messages[0]["content"], "row_data"), tagged(messages[0]["content"], "prior_results")
        answer = self.rule(row, prior)
        content = answer if isinstance(answer, str) else json.dumps(answer)
        words = [len(json.dumps(row).split()), len(content.split())]
        found = self.citations(row) if self.citations and tools else []
        return LLMResponse(content, UsageInfo(words[0], words[1], sum(words), model), found)
