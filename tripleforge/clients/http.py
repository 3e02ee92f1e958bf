"""Clients of language-model servers over HTTP."""

from __future__ import annotations

import http.client
import json
import os
import time
import urllib.error
import urllib.request
from typing import Any

from .base import ClientConfig, LLMClientError, register_client


def post(url: str, body: dict[str, Any], headers: dict[str, str], timeout: int) -> dict[str, Any]:
    """The JSON answer to a JSON request; any failure is a client error with the first 500 characters of what is known.

    A broken connection, a time-out, and a server that is busy or failing are tried again, up to TRIES times in
    all, after a pause that doubles; a request that the server refuses is not.
    """
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    for again in range(TRIES - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, http.client.HTTPException, ValueError) as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
            if not again or refused or isinstance(e, ValueError):
                raise LLMClientError(f"{url}: {e!r}"[:500]) from e
            time.sleep(PAUSE * 2 ** (TRIES - 1 - again))
    raise AssertionError


#: Times that a request is sent at most, and seconds before the second time.
TRIES, PAUSE = 3, 0.5


class _Http:
    url = ""

    def __init__(self, config: ClientConfig) -> None:
        self.config = config
        self.model_id = config.model_id
        self.base = (config.base_url or self.url).rstrip("/")

    def ask(self, prompt: str) -> str:
        raise NotImplementedError

    def extract(self, record_id: str, text: str, prompt: str) -> str:
        return self.ask(prompt)

    def augment(self, record_id: str, text: str, prompt: str, iteration: int) -> str:
        return self.ask(prompt)


def _field(answer: Any, *path: str | int) -> str:
    try:
        for p in path:
            answer = answer[p]
    except (KeyError, IndexError, TypeError) as e:
        raise LLMClientError(f"unexpected answer: {str(answer)[:400]}") from e
    return str(answer)


@register_client("ollama")
class OllamaClient(_Http):
    def ask(self, prompt: str) -> str:
        body = {"model": self.model_id, "prompt": prompt, "stream": False, "options": {"temperature": self.config.temperature}}
        return _field(post(f"{self.base.removesuffix('/v1')}/api/generate", body, {}, self.config.timeout), "response")


@register_client("lmstudio")
class LMStudioClient(_Http):
    def ask(self, prompt: str) -> str:
        body = {"model": self.model_id, "messages": [{"role": "user", "content": prompt}], "temperature": self.config.temperature}
        headers = {"Authorization": f"Bearer {self.config.api_key}"}
        return _field(post(f"{self.base}/chat/completions", body, headers, self.config.timeout), "choices", 0, "message", "content")


@register_client("gemini")
class GeminiClient(_Http):
    url = "https://generativelanguage.googleapis.com/v1beta"

    def ask(self, prompt: str) -> str:
        key = self.config.api_key or os.environ.get("LANGEXTRACT_API_KEY") or os.environ.get("GOOGLE_API_KEY")
        if not key:
            raise LLMClientError("no API key")
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": self.config.temperature, "responseMimeType": "application/json"}}
        return _field(post(f"{self.base}/models/{self.model_id}:generateContent", body, {"x-goog-api-key": key}, self.config.timeout), "candidates", 0, "content", "parts", 0, "text")
