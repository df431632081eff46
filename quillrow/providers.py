"""Model clients by name; vendor packages are imported only when a client connects."""

from .clients.base import LLMAPIError, LLMClient, LLMResponse, RuleClient
from .clients.vendors import AnthropicClient, GoogleClient, OpenAIClient

__all__ = ["AnthropicClient", "GoogleClient", "LLMAPIError", "LLMClient", "LLMResponse", "OpenAIClient", "RuleClient"]
