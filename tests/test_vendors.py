"""The vendor adapters against stand-ins of the vendors' packages."""

import asyncio
import json
import sys
from types import SimpleNamespace as Thing

import pytest

from quillrow.clients.base import LLMAPIError
from quillrow.clients.vendors import AnthropicClient, GoogleClient, OpenAIClient, openai_search
from quillrow.functions.answers import response_schema
from quillrow.records import GroundingConfig
from quillrow.spec import to_specs

TURNS = [{"role": "system", "content": "sys"}, {"role": "user", "content": "go"}, {"role": "assistant", "content": "{"}, {"role": "user", "content": "again"}]
FORMAT = response_schema(to_specs({"a": "x"}))
TOOLS = [GroundingConfig(blocked_domains=["bad.example"]).tool()]


class Refusal(Exception):
    def __init__(self, status=None, wait=None):
        super().__init__("refused")
        if status:
            self.status_code = status
        self.response = Thing(headers={"retry-after": wait} if wait else {})


class RateLimitFault(Exception):
    pass


class RequestTimeout(Exception):
    pass


@pytest.fixture
def vendor(monkeypatch):
    """Installs stand-ins; what was asked is noted, and what they answer or raise can be set."""
    state = Thing(asked=[], keys=[], answer=None, fault=None)

    def call(**options):
        async def later():
            state.asked.append(options)
            if state.fault:
                raise state.fault
            return state.answer

        return later()

    def openai(api_key=None, base_url=None):
        state.keys.append((api_key, base_url))
        return Thing(responses=Thing(create=call), chat=Thing(completions=Thing(create=call)))

    def anthropic(api_key=None):
        state.keys.append(api_key)
        return Thing(messages=Thing(create=call))

    genai = Thing(Client=lambda api_key=None: Thing(aio=Thing(models=Thing(generate_content=call))))
    monkeypatch.setitem(sys.modules, "openai", Thing(AsyncOpenAI=openai))
    monkeypatch.setitem(sys.modules, "anthropic", Thing(AsyncAnthropic=anthropic))
    monkeypatch.setitem(sys.modules, "google", Thing(genai=genai))
    return state


def ask(client, tools=None, form=FORMAT):
    return asyncio.run(client.complete(TURNS, "m", 0.1, 50, form, tools) if tools else client.complete(TURNS, "m", 0.1, 50, form))


def test_openai_responses(vendor):
    notes = [Thing(url="https://a.example", title="A"), Thing(url=None)]
    vendor.answer = Thing(output=[Thing(content=[Thing(annotations=notes, text="t")]), Thing(content=None)], output_text='{"a": "x"}', usage=Thing(input_tokens=3, output_tokens=2, total_tokens=5))
    client = OpenAIClient("key")
    found = ask(client, TOOLS)
    assert found.content == '{"a": "x"}' and found.usage.total_tokens == 5 and found.usage.model == "m"
    assert found.citations == [{"url": "https://a.example", "title": "A", "snippet": None}]
    asked = vendor.asked[0]
    assert asked["instructions"] == "sys" and asked["input"] == TURNS[1:] and asked["max_output_tokens"] == 50 and vendor.keys == [("key", None)]
    assert asked["text"]["format"]["name"] == "enrichment_result" and asked["text"]["format"]["type"] == "json_schema" and asked["tools"] == [{"type": "web_search"}]
    ask(client, form={"type": "json_object"})
    assert vendor.asked[1]["text"] == {"format": {"type": "json_object"}} and "tools" not in vendor.asked[1] and len(vendor.keys) == 1
    assert asyncio.run(openai_search("q", {"api_key": "k", "model": "m", "tool": {"type": "web_search"}})) == (["t"], ["https://a.example"])


def test_openai_chat_of_compatible_servers(vendor):
    vendor.answer = Thing(choices=[Thing(message=Thing(content="hi"))], usage=Thing(prompt_tokens=1, completion_tokens=2, total_tokens=3))
    client = OpenAIClient("key", "http://here")
    found = ask(client)
    assert (found.content, found.usage.prompt_tokens, found.usage.total_tokens) == ("hi", 1, 3) and vendor.asked[0]["messages"] == TURNS
    assert not client.structured_outputs and vendor.keys == [("key", "http://here")]
    with pytest.raises(LLMAPIError, match="no tools"):
        ask(client, TOOLS)


def test_anthropic(vendor):
    cited = [Thing(url="https://a.example", title="A", cited_text="said"), Thing(url="")]
    vendor.answer = Thing(content=[Thing(type="text", text='{"a":', citations=cited), Thing(type="tool_use"), Thing(type="text", text=' "x"}', citations=None)], usage=Thing(input_tokens=3, output_tokens=2))
    client = AnthropicClient("key")
    found = ask(client)
    assert json.loads(found.content) == {"a": "x"} and found.usage.total_tokens == 5 and found.citations == [{"url": "https://a.example", "title": "A", "snippet": "said"}]
    asked = vendor.asked[0]
    assert asked["system"] == "sys" and asked["messages"] == TURNS[1:] and asked["output_config"]["format"]["schema"]["required"] == ["a"]
    ask(client, TOOLS)
    assert "output_config" not in vendor.asked[1] and vendor.asked[1]["tools"][0]["blocked_domains"] == ["bad.example"]


def test_google(vendor):
    web = [Thing(web=Thing(uri="https://a.example", title="A")), Thing(web=None)]
    vendor.answer = Thing(text='{"a": "x"}', candidates=[Thing(grounding_metadata=Thing(grounding_chunks=web)), Thing(grounding_metadata=None)], usage_metadata=Thing(prompt_token_count=3, candidates_token_count=None, total_token_count=3))
    client = GoogleClient("key")
    found = ask(client)
    assert found.citations == [{"url": "https://a.example", "title": "A", "snippet": None}] and (found.usage.completion_tokens, found.usage.total_tokens) == (0, 3)
    asked = vendor.asked[0]
    assert [c["role"] for c in asked["contents"]] == ["user", "model", "user"] and asked["config"]["response_json_schema"]["required"] == ["a"]
    ask(client, TOOLS)
    assert vendor.asked[1]["config"]["tools"] == [{"google_search": {"exclude_domains": ["bad.example"]}}] and "response_mime_type" not in vendor.asked[1]["config"]


@pytest.mark.parametrize("make", [OpenAIClient, lambda: OpenAIClient(base_url="http://here"), AnthropicClient, GoogleClient])
def test_faults_become_api_errors(vendor, make):
    for fault, status, wait in ((Refusal(429, "2.5"), 429, 2.5), (Refusal(503), 503, None), (RateLimitFault("slow"), 429, None), (RequestTimeout("late"), 408, None), (ValueError("odd"), None, None)):
        vendor.fault = fault
        with pytest.raises(LLMAPIError) as caught:
            ask(make())
        assert (caught.value.status_code, caught.value.retry_after, caught.value.is_rate_limit) == (status, wait, status == 429)
