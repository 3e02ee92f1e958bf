"""What a client is, its configuration and its registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class LLMClientError(Exception):
    """A call that gave no usable answer."""


#: What a client has where its configuration says nothing.
CLIENT_DEFAULTS: dict[str, dict[str, Any]] = {
    "gemini": {"model_id": "gemini-2.0-flash", "max_workers": 10},
    "lmstudio": {"model_id": "local-model", "base_url": "http://localhost:1234/v1", "api_key": "lm-studio", "max_workers": 5, "batch_length": 5},
    "ollama": {"model_id": "llama3.1", "base_url": "http://localhost:11434", "max_workers": 5, "batch_length": 5},
}


@dataclass(frozen=True)
class ClientConfig:
    """max_char_buffer, extraction_passes: characters of a text in one prompt of an extraction, and how often all of it is read; max_workers: calls of one task at a time; batch_length: calls handed to them at a time."""

    client_type: str = "rule"
    model_id: str | None = None
    temperature: float = 0.0
    max_workers: int | None = None
    max_char_buffer: int = 8000
    extraction_passes: int = 1
    batch_length: int | None = None
    api_key: str | None = None
    base_url: str | None = None
    timeout: int = 120
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, value in CLIENT_DEFAULTS.get(self.client_type, {}).items():
            if getattr(self, name) is None:
                object.__setattr__(self, name, value)
        for name in ("max_char_buffer", "extraction_passes", "max_workers", "batch_length"):
            value = getattr(self, name)
            if value is None and name in ("max_workers", "batch_length"):
                continue
            if not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a number of 1 or more, not {value!r}")


class LLMClient(Protocol):
    """extract and augment answer a prompt with text; a client is made on the executor, once a partition."""

    def extract(self, record_id: str, text: str, prompt: str) -> str: ...

    def augment(self, record_id: str, text: str, prompt: str, iteration: int) -> str: ...


_CLIENTS: dict[str, Callable[[ClientConfig], LLMClient]] = {}


def register_client(name: str):
    """Registers a factory, which takes the place of one of the same name."""

    def put(factory: Callable[[ClientConfig], LLMClient]):
        _CLIENTS[name] = factory
        return factory

    return put


def available_clients() -> list[str]:
    return sorted(_CLIENTS)


def create_client(config: ClientConfig) -> LLMClient:
    if config.client_type not in _CLIENTS:
        raise ValueError(f"unknown client {config.client_type!r}; there are {', '.join(available_clients())}")
    return _CLIENTS[config.client_type](config)
