"""Knowledge graphs from text at scale, as DataFrame transformations.

The names of __all__ are read from their modules when they are first asked for.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

_WHERE = {
    "extract_triples": ("plans.augment", "extract"),
    "augment_triples": ("plans.augment", "augment"),
    "ClientConfig": ("clients", "ClientConfig"),
    "create_client": ("clients", "create_client"),
    "register_client": ("clients", "register_client"),
    "Domain": ("plans.domains", "Domain"),
    "get_domain": ("plans.domains", "get_domain"),
    "read_domain": ("plans.domains", "read_domain"),
    "load_records": ("sources.readers", "load_records"),
    "read_table": ("sources.readers", "read_table"),
    "read_triples": ("sources.readers", "read_triples"),
    "to_graph": ("operators.graph", "graph"),
    "to_graphml": ("sources.writers", "graphml"),
    "network_pages": ("sources.writers", "network_pages"),
    "text_pages": ("sources.writers", "text_pages"),
    "run_pipeline": ("plans.pipeline", "run_config"),
}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(name)
    module, own = _WHERE[name]
    return getattr(import_module(f".{module}", __name__), own)
