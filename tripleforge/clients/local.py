"""Clients that need no network: by rule, and with answers given beforehand."""

from __future__ import annotations

import json
import re

from .base import ClientConfig, LLMClientError, register_client

_RULE = re.compile(r"\b([A-Z][a-z]+) (of|by|the|in|on|for|is|was|and|that) ([a-z]+)", re.ASCII)
_COMPONENT = re.compile(r"^Component \d+: (.*)$", re.M)


@register_client("rule")
class RuleClient:
    """Extracts a fixed pattern; bridges components from the least name of each to that of the first."""

    def __init__(self, config: ClientConfig) -> None:
        self.config = config

    def extract(self, record_id: str, text: str, prompt: str) -> str:
        found = [{"head": h, "relation": r, "tail": t, "inference": "contextual" if r in ("and", "that") else "explicit", "justification": f"{h} {r} {t}"} for h, r, t in _RULE.findall(text)]
        return json.dumps(found, ensure_ascii=False)

    def augment(self, record_id: str, text: str, prompt: str, iteration: int) -> str:
        heads = [json.loads(x)["name"] for x in _COMPONENT.findall(prompt)]
        return json.dumps([{"head": h, "relation": "part_of_context", "tail": heads[0]} for h in heads[1:]], ensure_ascii=False)


@register_client("replay")
class ReplayClient:
    """Answers from options: {record_id: answer or list of answers by iteration}; a missing one is an error."""

    def __init__(self, config: ClientConfig) -> None:
        self.answers = config.options

    def _answer(self, record_id: str, number: int) -> str:
        found = self.answers.get(record_id)
        if isinstance(found, list):
            found = found[number] if number < len(found) else None
        if found is None:
            raise LLMClientError(f"no answer for {record_id}, {number}")
        return found

    def extract(self, record_id: str, text: str, prompt: str) -> str:
        return self._answer(record_id, 0)

    def augment(self, record_id: str, text: str, prompt: str, iteration: int) -> str:
        return self._answer(record_id, iteration)
