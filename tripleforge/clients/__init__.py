"""Language-model clients: a registry, two that need no network, and three that speak HTTP."""

from .base import ClientConfig, LLMClient, LLMClientError, available_clients, create_client, register_client
from .http import GeminiClient, LMStudioClient, OllamaClient
from .local import ReplayClient, RuleClient

__all__ = ["ClientConfig", "GeminiClient", "LLMClient", "LLMClientError", "LMStudioClient", "OllamaClient", "ReplayClient", "RuleClient", "available_clients", "create_client", "register_client"]
