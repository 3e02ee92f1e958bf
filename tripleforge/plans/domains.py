"""Knowledge domains: prompts, schemas and worked examples."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

from ..operators.constraints import Constraints, collect_constraints, example_triples


class DomainResourceError(Exception):
    """A domain that lacks what is asked of it: the resource's path and the domain's name, if they are known."""

    def __init__(self, message: str, resource_path: str | None = None, domain_name: str | None = None) -> None:
        super().__init__(message if resource_path is None else f"{message} ({resource_path})")
        self.resource_path, self.domain_name = resource_path, domain_name


EXTRACT = "List the facts of the text as a JSON array of objects with head, relation, tail, inference (explicit or contextual) and justification.\n\n{{schema_constraints}}\n\nRecord:\n{{record_json}}\n"
CONNECT = "The graph of this text has parts that no fact joins. Add facts that the text supports and that join them, as a JSON array of objects with head, relation and tail.\n\n{{schema_constraints}}\n\nRecord:\n{{record_json}}\n"
RESOLVE = "Some of these entities are the same thing under different names. Answer with a JSON array of objects with canonical and variants.\n\nRecord:\n{{record_json}}\n"


@dataclass(frozen=True)
class Domain:
    name: str
    constrained: bool = False
    entity_types: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    prompts: dict[str, str] = field(default_factory=lambda: {"extraction": EXTRACT, "connectivity": CONNECT, "entity_resolution": RESOLVE})
    example_relations: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Worked examples by what they are of, in the form of the files of a domain's folder.
    examples: dict[str, tuple[dict, ...]] = field(default_factory=dict)

    def prompt(self, what: str) -> str:
        if what not in self.prompts:
            raise DomainResourceError(f"{self.name} has no prompt for {what}; there are {', '.join(sorted(self.prompts))}", domain_name=self.name)
        return self.prompts.get(f"{what}_constrained", self.prompts[what]) if self.constrained else self.prompts[what]

    def full_prompt(self, what: str) -> str:
        """The prompt with its worked examples ahead, each a text and the answer to it."""
        shown = [(e.get("text") or e.get("input") or "", example_triples(e)) for e in self.examples.get(what, ())]
        lines = [f"Example:\n{text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)}\nAnswer:\n{json.dumps(answer, ensure_ascii=False)}\n" for text, answer in shown]
        return "\n".join([*lines, self.prompt(what)])

    def strategies(self) -> list[str]:
        return sorted(x for x in self.prompts if not x.startswith("extraction") and not x.endswith("_constrained"))

    def constraints(self, what: str) -> Constraints:
        """In constrained mode the schema's labels and the relations of the examples of what."""
        examples = [{"output": [{"relation": r}]} for r in self.example_relations.get(what, ())] + list(self.examples.get(what, ()))
        return collect_constraints(self.constrained, self.entity_types, self.relation_types, examples)


# The labels of the built-in domains.
_DOMAINS: dict[str, Domain] = {
    "default": Domain("default", example_relations={"extraction": ("founded_by",), "connectivity": ("is_referred_as",)}),
    "legal": Domain(
        "legal",
        entity_types=("Legal party", "Organization", "Legal instrument", "Obligation", "Event", "Date", "Monetary amount", "Location", "Legal concept"),
        relation_types=("is_type_of", "part_of", "belongs_to", "filed_against", "represented_by", "governed_by", "breached", "enforced", "occurred_on", "preceded", "followed", "caused", "resulted_in", "led_to", "owned_by", "possessed_by", "involved_in", "party_to", "signed_by"),
        example_relations={
            "extraction": ("represents", "is_party_as", "filed", "affirmed decision of", "held", "is citizen of", "convicted of", "sought extradition of", "alleged", "ruled in favor of"),
            "connectivity": ("relates_to", "subject_of"),
        },
    ),
}


def _text(path: str) -> str:
    if not os.path.isfile(path):
        raise DomainResourceError("no such resource", path)
    with open(path, encoding="utf-8") as file:
        return file.read().strip()


def _json(path: str) -> Any:
    try:
        return json.loads(_text(path))
    except json.JSONDecodeError as e:
        raise DomainResourceError(f"invalid JSON: {e}", path) from e


def _examples(path: str) -> tuple[dict, ...]:
    found = _json(path) if os.path.exists(path) else []
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise DomainResourceError("examples are an array of objects", path)
    return tuple(found)


def read_domain(folder: str, name: str | None = None, prompt: str | None = None, examples: str | None = None, schema: str | None = None) -> Domain:
    """A domain from a folder on the driver; prompt, examples and schema name files that take the place of those of extraction and of the schema.

    extraction/ has prompt_open.md, prompt_constrained.md and examples.json; augmentation/ has a folder for each
    strategy with prompt.md and examples.json; schema.json has entity_types and relation_types. Examples and
    schema may be absent, and so may one of the two prompts of extraction.
    """
    name = name or os.path.basename(os.path.normpath(folder))
    at = lambda *parts: os.path.join(folder, *parts)
    prompts, shown = {}, {"extraction": _examples(examples or at("extraction", "examples.json"))}
    modes = {"extraction": prompt or at("extraction", "prompt_open.md"), "extraction_constrained": prompt or at("extraction", "prompt_constrained.md")}
    prompts |= {mode: _text(path) for mode, path in modes.items() if os.path.exists(path)}
    if not prompts:
        raise DomainResourceError("no such resource", modes["extraction"], name)
    prompts.setdefault("extraction", prompts.get("extraction_constrained", ""))
    for strategy in sorted(os.listdir(at("augmentation"))) if os.path.isdir(at("augmentation")) else []:
        if os.path.isdir(at("augmentation", strategy)):
            prompts[strategy] = _text(at("augmentation", strategy, "prompt.md"))
            shown[strategy] = _examples(at("augmentation", strategy, "examples.json"))
    path = schema or at("schema.json")
    labels = _json(path) if schema or os.path.exists(path) else {}
    return Domain(name, False, tuple(labels.get("entity_types") or ()), tuple(labels.get("relation_types") or ()), prompts, {}, shown)


def register_domain(domain: Domain) -> None:
    """Registers a domain, which takes the place of one of the same name."""
    _DOMAINS[domain.name] = domain


def list_domains() -> list[str]:
    return sorted(_DOMAINS)


def get_domain(name: str, mode: str = "open") -> Domain:
    if name not in _DOMAINS:
        raise DomainResourceError(f"unknown domain {name!r}; there are {', '.join(list_domains())}")
    return replace(_DOMAINS[name], constrained=mode == "constrained")
