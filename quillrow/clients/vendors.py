"""Adapters of hosted models; each needs its vendor's package, imported on first use."""

from __future__ import annotations

import json
from typing import Any

from ..records import UsageInfo, unsupported
from .base import LLMAPIError, LLMResponse


def _failure(error: Exception) -> LLMAPIError:
    """A vendor's exception by its status; rate limits and time-outs by name where there is none."""
    status = getattr(error, "status_code", None) or getattr(error, "code", None)
    status = status if isinstance(status, int) else None
    text = f"{type(error).__name__} {error}".lower()
    if status is None and ("429" in text or "rate" in text):
        status = 429
    elif status is None and "timeout" in text:
        status = 408
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        wait = float(headers.get("retry-after"))
    except (TypeError, ValueError):
        wait = None
    return LLMAPIError(str(error), status, wait)


def _split(messages: list[dict[str, str]]) -> tuple[str, list[dict[str, str]]]:
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    return system, [m for m in messages if m["role"] != "system"]


def _tool(tools: list[dict[str, Any]] | None) -> dict[str, Any] | None:
    return next((t for t in tools or [] if t.get("type") == "web_search"), None)


def openai_tool(tool: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {**tool.get("provider_kwargs", {}), "type": "web_search"}
    if tool.get("allowed_domains"):
        out["filters"] = {"allowed_domains": tool["allowed_domains"]}
    for option in ("blocked_domains", "max_searches"):
        if tool.get(option):
            unsupported("OpenAI", option)
    if tool.get("user_location"):
        out["user_location"] = {"type": "approximate", **tool["user_location"]}
    return out


def anthropic_tool(tool: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {"type": "web_search_20250305", "name": "web_search"}
    out |= {k: tool[k] for k in ("allowed_domains", "blocked_domains") if tool.get(k)}
    if tool.get("user_location"):
        out["user_location"] = {"type": "approximate", **tool["user_location"]}
    if tool.get("max_searches"):
        out["max_uses"] = tool["max_searches"]
    return out | tool.get("provider_kwargs", {})


def google_tool(tool: dict[str, Any]) -> dict[str, Any]:
    search: dict[str, Any] = {}
    if tool.get("blocked_domains"):
        search["exclude_domains"] = tool["blocked_domains"]
    if tool.get("allowed_domains"):
        unsupported("Google", "allowed_domains")
    return {"google_search": search | tool.get("provider_kwargs", {})}


class OpenAIClient:
    """Responses API; with ``base_url`` the chat API of a compatible server, which takes no tools."""

    def __init__(self, api_key: str | None = None, base_url: str | None = None):
        self.api_key, self.base_url = api_key, base_url
        self.structured_outputs = base_url is None
        self._client: Any = None

    def __getstate__(self):
        return {**self.__dict__, "_client": None}

    def _connect(self) -> Any:
        if self._client is None:
            import openai

            self._client = openai.AsyncOpenAI(api_key=self.api_key, base_url=self.base_url)
        return self._client

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None) -> LLMResponse:
        client = self._connect()
        if self.base_url:
            if tools:
                raise LLMAPIError("compatible endpoints take no tools", 400)
            try:
                done = await client.chat.completions.create(model=model, messages=messages, temperature=temperature, max_tokens=max_tokens, response_format=response_format)
            except Exception as error:
                raise _failure(error) from error
            u = done.usage
            usage = UsageInfo(u.prompt_tokens, u.completion_tokens, u.total_tokens, model) if u else None
            return LLMResponse(done.choices[0].message.content or "", usage)
        system, turns = _split(messages)
        options: dict[str, Any] = {"model": model, "instructions": system, "input": turns, "temperature": temperature, "max_output_tokens": max_tokens}
        if response_format:
            inner = response_format.get("json_schema")
            options["text"] = {"format": {"type": "json_schema", **inner} if inner else response_format}
        if tool := _tool(tools):
            options["tools"] = [openai_tool(tool)]
        try:
            done = await client.responses.create(**options)
        except Exception as error:
            raise _failure(error) from error
        notes = [a for item in done.output for part in getattr(item, "content", None) or [] for a in getattr(part, "annotations", None) or []]
        cited = [{"url": a.url, "title": getattr(a, "title", None), "snippet": None} for a in notes if getattr(a, "url", None)]
        u = done.usage
        return LLMResponse(done.output_text, UsageInfo(u.input_tokens, u.output_tokens, u.total_tokens, model) if u else None, cited)


async def openai_search(query: str, options: dict[str, Any]) -> tuple[list[str], list[str]]:
    """Text parts and cited urls of one search."""
    client = OpenAIClient(options["api_key"])._connect()
    try:
        done = await client.responses.create(model=options["model"], input=query, tools=[options["tool"]])
    except Exception as error:
        raise _failure(error) from error
    parts = [p for item in done.output for p in getattr(item, "content", None) or [] if hasattr(p, "text")]
    return [p.text for p in parts], [a.url for p in parts for a in getattr(p, "annotations", None) or [] if getattr(a, "url", None)]


class AnthropicClient:
    structured_outputs = True

    def __init__(self, api_key: str | None = None):
        self.api_key = api_key
        self._client: Any = None

    def __getstate__(self):
        return {**self.__dict__, "_client": None}

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None) -> LLMResponse:
        if self._client is None:
            import anthropic

            self._client = anthropic.AsyncAnthropic(api_key=self.api_key)
        system, turns = _split(messages)
        options: dict[str, Any] = {"model": model, "system": system, "messages": turns, "temperature": temperature, "max_tokens": max_tokens}
        if tool := _tool(tools):
            options["tools"] = [anthropic_tool(tool)]
        elif response_format and "json_schema" in response_format:
            options["output_config"] = {"format": {"type": "json_schema", "schema": response_format["json_schema"]["schema"]}}
        try:
            done = await self._client.messages.create(**options)
        except Exception as error:
            raise _failure(error) from error
        texts = [b for b in done.content if getattr(b, "type", "") == "text"]
        cited = [{"url": c.url, "title": getattr(c, "title", None), "snippet": getattr(c, "cited_text", None)} for b in texts for c in getattr(b, "citations", None) or [] if getattr(c, "url", None)]
        u = done.usage
        return LLMResponse("".join(b.text for b in texts), UsageInfo(u.input_tokens, u.output_tokens, u.input_tokens + u.output_tokens, model), cited)


class GoogleClient:
    structured_outputs = True

    def __init__(self, api_key: str | None = None):
        self.api_key = api_key
        self._client: Any = None

    def __getstate__(self):
        return {**self.__dict__, "_client": None}

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None) -> LLMResponse:
        if self._client is None:
            from google import genai

            self._client = genai.Client(api_key=self.api_key)
        system, turns = _split(messages)
        contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in turns]
        config: dict[str, Any] = {"system_instruction": system, "temperature": temperature, "max_output_tokens": max_tokens}
        if tool := _tool(tools):
            config["tools"] = [google_tool(tool)]
        elif response_format:
            config["response_mime_type"] = "application/json"
            if "json_schema" in response_format:
                config["response_json_schema"] = json.loads(json.dumps(response_format["json_schema"]["schema"]))
        try:
            done = await self._client.aio.models.generate_content(model=model, contents=contents, config=config)
        except Exception as error:
            raise _failure(error) from error
        chunks = [c.web for x in done.candidates or [] for c in getattr(getattr(x, "grounding_metadata", None), "grounding_chunks", None) or [] if getattr(c, "web", None)]
        u = done.usage_metadata
        usage = UsageInfo(u.prompt_token_count or 0, u.candidates_token_count or 0, u.total_token_count or 0, model) if u else None
        return LLMResponse(done.text or "", usage, [{"url": w.uri, "title": getattr(w, "title", None), "snippet": None} for w in chunks])
