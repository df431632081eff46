"""Model steps: prompt, call, parse, check, correct, default."""

from __future__ import annotations

import asyncio
import hashlib
import random
from collections.abc import Callable
from typing import Any

from ..clients.base import LLMAPIError, LLMResponse
from ..errors import FieldValidationError, PipelineError, StepError
from ..functions.answers import parse, response_schema
from ..functions.prompts import USER_TURN, Prompt, correction
from ..plans.budget import current_gate
from ..records import GroundingConfig, StepContext, StepResult, UsageInfo
from ..spec import canonical_json, to_specs
from .steps import PythonStep, one_predicate

SOURCES_TYPE = "array<struct<url:string,title:string,snippet:string>>"


def distinct_citations(citations: list) -> list[dict[str, Any]]:
    """Citations with a url, the first of each url, in order."""
    kept: dict[str, dict[str, Any]] = {}
    for c in citations:
        c = c if isinstance(c, dict) else vars(c)
        if c.get("url"):
            kept.setdefault(c["url"], {k: c.get(k) for k in ("url", "title", "snippet")})
    return list(kept.values())


class LLMStep(PythonStep):
    """Fields answered by a language model.

    ``client`` is a client or a function that makes one; the latter is called
    once per worker and is the form to use for clients that hold connections.
    ``schema`` checks the answer where no strict format does: a class with
    ``model_validate``, whose ``model_dump`` gives the values, or a function of
    the parsed answer that returns a dict of them (else they stay as they came).  An answer that
    can't be parsed or checked goes back with the problem up to
    ``max_retries`` times; API failures are retried by the run's settings.
    Only the usage of the answer that was kept is counted.
    """

    external = True

    def __init__(
        self, name: str, fields: dict | list, depends_on: list[str] | None = None, model: str = "gpt-4.1-mini", temperature: float | None = None,
        max_tokens: int | None = None, system_prompt: str | None = None, system_prompt_header: str | None = None, api_key: str | None = None,
        base_url: str | None = None, client: Any = None, schema: Callable[[dict], Any] | None = None, max_retries: int = 2, cache: bool = True,
        structured_outputs: bool | None = None, grounding: Any = None, sources_field: str | None = "sources", run_if: Any = None, skip_if: Any = None,
        reads: list[str] | None = None,
    ):
        one_predicate(name, run_if, skip_if)
        self.name, self.depends_on, self.model = name, list(depends_on or []), model
        self.temperature, self.max_tokens, self.max_retries = temperature, max_tokens, max_retries
        self.api_key, self.base_url, self.client, self.schema = api_key, base_url, client, schema
        self.system_prompt, self.header = system_prompt, system_prompt_header
        self.cache, self.reads, self.run_if, self.skip_if = cache, reads, run_if, skip_if
        self.specs = to_specs(fields)
        self.has_specs = isinstance(fields, dict)
        self.fields = list(self.specs)
        self.grounding = GroundingConfig.of(grounding)
        self.sources_field = sources_field if self.grounding else None
        self.types = {n: s.spark_type for n, s in self.specs.items()}
        if self.sources_field:
            if self.sources_field in self.types:
                raise PipelineError(f"step {name!r}: sources field {self.sources_field!r} is also a declared field")
            self.types[self.sources_field] = SOURCES_TYPE
        if self.grounding and base_url:
            raise PipelineError(f"step {name!r}: compatible endpoints take no web search")
        self.structured = self._structured(structured_outputs)
        self.response_format = response_schema(self.specs) if self.structured else {"type": "json_object"}
        self.prompt = Prompt(self.specs, system_prompt, system_prompt_header)
        self.skipped()
        self._live: Any = None

    def _structured(self, wanted: bool | None) -> bool:
        """Whether a strict schema is asked for; by default of clients known to take one."""
        if wanted is not None:
            return wanted and self.has_specs and bool(self.specs)
        if self.schema is not None or not self.has_specs or not self.specs or self.base_url or getattr(self.client, "base_url", None):
            return False
        return self.client is None or bool(getattr(self.client, "structured_outputs", False))

    def __getstate__(self) -> dict[str, Any]:
        return {**self.__dict__, "_live": None}

    def key_parts(self) -> dict[str, Any]:
        def digest(x):
            return hashlib.sha256(x.encode()).hexdigest() if x else ""

        return {
            "step": self.name, "model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "format": self.response_format,
            "fields": {n: s.as_dict() for n, s in self.specs.items()}, "prompt": digest(self.system_prompt), "header": digest(self.header),
            "grounding": digest(canonical_json(self.grounding.tool())) if self.grounding else "",
        }

    def live_client(self) -> Any:
        if self._live is None:
            if self.client is None:
                from ..clients.vendors import OpenAIClient

                self._live = OpenAIClient(api_key=self.api_key, base_url=self.base_url)
            else:
                made = hasattr(self.client, "complete") and not isinstance(self.client, type)
                self._live = self.client if made else self.client()
        return self._live

    async def run(self, ctx: StepContext) -> StepResult:
        config = ctx.config
        first = self.temperature if self.temperature is not None else config.temperature if config else 0.2
        options = {
            "model": self.model, "temperature": first, "max_tokens": self.max_tokens or (config.max_tokens if config else 4000),
            "response_format": self.response_format,
        }
        if self.grounding:
            options["tools"] = [self.grounding.tool()]
        start = [{"role": "system", "content": self.prompt.build(ctx.row, ctx.prior_results)}, {"role": "user", "content": USER_TURN}]
        attempts, base = (config.max_retries, config.retry_base_delay) if config else (3, 1.0)
        for attempt in range(attempts + 1):
            try:
                return await self._conversation(list(start), options)
            except LLMAPIError as failure:
                if attempt == attempts:
                    raise StepError(f"the model can't be reached: {failure}", self.name) from failure
                wait = max(base * 2**attempt, failure.retry_after or 0.0)
                if failure.retry_after and (gate := current_gate.get()):
                    gate.pause(failure.retry_after)  # the service asks all tasks, not only this row
                await asyncio.sleep(wait * (1 + random.random() / 4))
        raise AssertionError

    async def _conversation(self, messages: list[dict[str, str]], options: dict[str, Any]) -> StepResult:
        problem: Exception | None = None
        for attempt in range(self.max_retries + 1):
            try:
                response: LLMResponse = await self.live_client().complete(messages=messages, **options)
            except TypeError as failure:
                if "tools" in options:
                    raise StepError(f"the client takes no tools: {failure}", self.name) from failure
                raise
            try:
                values = parse(response.content, self.specs, self.structured, None if self.structured else self.schema)
            except (ValueError, FieldValidationError) as failure:
                problem = failure
                messages += [{"role": "assistant", "content": response.content}, {"role": "user", "content": correction(str(failure), self.fields)}]
                continue
            if self.sources_field and response.citations:
                values[self.sources_field] = distinct_citations(response.citations)
            return StepResult(values, response.usage or UsageInfo(model=self.model), {"attempts": attempt + 1})
        raise StepError(f"no usable answer after {self.max_retries + 1} attempts: {problem}", self.name)
