"""Pipelines: named steps over the tables of a set of records."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clients import ClientConfig
from ..operators import graph
from ..operators import triples as T
from ..sources import readers, writers
from . import augment as A
from .domains import Domain, get_domain, read_domain, register_domain


@dataclass(frozen=True)
class State:
    """The tables of a run; errors has (record_id, step, message), and records with an error take no part in later steps."""

    records: DataFrame
    triples: DataFrame
    errors: DataFrame
    artifacts: dict[str, Any] = field(default_factory=dict)
    #: Whether the extract step has run, so that a record without triples has none to be found.
    extracted: bool = False


Step = Callable[..., State]
_STEPS: dict[str, Step] = {}


def register_step(name: str):
    """Registers a step; a name that is taken is an error."""

    def put(f: Step) -> Step:
        if name in _STEPS:
            raise ValueError(f"there is a step {name!r} already")
        _STEPS[name] = f
        return f

    return put


def list_steps() -> list[str]:
    return sorted(_STEPS)


@dataclass(frozen=True)
class Settings:
    client: ClientConfig = ClientConfig()
    domain: Domain = field(default_factory=lambda: get_domain("default"))
    output: str | None = None


@register_step("extract")
def extract_step(state: State, settings: Settings, **_: Any) -> State:
    found, errors = A.extract(state.records, settings.client, settings.domain)
    return replace(state, triples=T.append(state.triples, found), errors=state.errors.unionByName(errors), extracted=True)


@register_step("augment")
def augment_step(state: State, settings: Settings, strategy: str = "connectivity", **options: Any) -> State:
    """Refines the triples; records that have none yet, and no error, are extracted first."""
    bare = state.records.join(state.triples.select("record_id").distinct(), "record_id", "left_anti")
    if not state.extracted and not bare.isEmpty():
        found, errors = A.extract(bare, settings.client, settings.domain)
        state = replace(state, triples=T.append(state.triples, found), errors=state.errors.unionByName(errors), records=state.records.join(errors.select("record_id"), "record_id", "left_anti"))
    triples, log = A.augment(state.records, state.triples, settings.client, settings.domain, strategy, **options)
    return replace(state, triples=triples, artifacts=state.artifacts | {strategy: log})


@register_step("export-json")
def export_step(state: State, settings: Settings, **_: Any) -> State:
    table = writers.triples_json(state.triples, state.records)
    if settings.output:
        writers.write_files(table, f"{settings.output}/json", ".json")
    return replace(state, artifacts=state.artifacts | {"json": table})


@register_step("convert")
def convert_step(state: State, settings: Settings, **_: Any) -> State:
    nodes, edges = graph.graph(state.triples)
    table = writers.graphml(nodes, edges)
    if settings.output:
        writers.write_files(table, f"{settings.output}/graphml", ".graphml")
    return replace(state, artifacts=state.artifacts | {"nodes": nodes, "edges": edges, "graphml": table})


@register_step("visualize-network")
def network_step(state: State, settings: Settings, dark_mode: bool = False, layout: str = "spring", **_: Any) -> State:
    """A page for each record with triples; nodes carry their community."""
    nodes, edges = graph.graph(state.triples)
    table = graph.view(nodes, edges)
    if settings.output:
        writers.write_files(writers.network_pages(table, dark_mode, layout), f"{settings.output}/network", ".html")
    return replace(state, artifacts=state.artifacts | {"elements": table})


@register_step("visualize-extraction")
def extraction_view_step(state: State, settings: Settings, group_by: str = "entity_type", dark_mode: bool = False, **_: Any) -> State:
    """A page for each record, also for those without spans."""
    spans = T.entity_spans(state.triples, state.records, group_by)
    if settings.output:
        writers.write_files(writers.text_pages(state.records, state.triples, spans, dark_mode), f"{settings.output}/text", ".html")
    return replace(state, artifacts=state.artifacts | {"spans": spans})


def start(records: DataFrame) -> State:
    spark = records.sparkSession
    return State(records, spark.createDataFrame([], "record_id string, seq int, head string, relation string, tail string, inference string, justification string"), spark.createDataFrame([], "record_id string, step string, message string"))


def run(state: State, steps: list[str | dict[str, dict]], settings: Settings) -> State:
    """The state after all steps: names, or maps of one name to its options."""
    for step in steps:
        name, options = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name not in _STEPS:
            raise ValueError(f"unknown step {name!r}; there are {', '.join(list_steps())}")
        failed = state.errors.select("record_id").distinct()
        live = replace(state, records=state.records.join(failed, "record_id", "left_anti"))
        done = _STEPS[name](live, settings, **(options or {}))
        state = replace(done, records=state.records)
    return state


def summary(state: State) -> DataFrame:
    """(n_records, n_failed, n_triples) of a run."""
    n = state.records.agg(F.count("*").alias("n_records"))
    bad = state.errors.agg(F.countDistinct("record_id").alias("n_failed"))
    t = state.triples.agg(F.count("*").alias("n_triples"))
    return n.join(bad).join(t)


def first_errors(state: State) -> DataFrame:
    """(record_id, step, message): each failed record's first error, in the order of its run, as records stop at it."""
    return state.errors.groupBy("record_id").agg(F.min(F.struct("step", "message")).alias("e")).select("record_id", "e.step", "e.message")


def write_metadata(state: State, settings: Settings, seconds: float, path: str) -> dict[str, Any]:
    """Writes a run's client, domain, counts and duration as a JSON file of one row's size on the driver; the key of a client is left out."""
    row = summary(state).first()
    client = {k: v for k, v in asdict(settings.client).items() if k not in ("api_key", "options")}
    said = {"client": client, "domain": settings.domain.name, "mode": "constrained" if settings.domain.constrained else "open", "seconds": round(seconds, 3), **row.asDict()}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(said, file, ensure_ascii=False, indent=2)
    return said


#: The folder of the pipeline files that come with the library.
CONFIGS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "configs")


def list_pipelines(folder: str = CONFIGS) -> list[tuple[str, str]]:
    """(name, description) of a folder's pipeline files in the order of their names; a file that is no pipeline has its own name and no description."""
    out = []
    for name in sorted(x for x in os.listdir(folder) if x.endswith((".yaml", ".yml"))):
        try:
            raw = load_config(os.path.join(folder, name))
        except Exception:  # noqa: BLE001 - a listing shows what it can
            raw = {}
        out.append((str(raw.get("name") or os.path.splitext(name)[0]), str(raw.get("description") or "")))
    return out


def load_config(path: str) -> dict[str, Any]:
    """A pipeline file: YAML with steps."""
    import yaml

    with open(path, encoding="utf-8") as file:
        raw = yaml.safe_load(file)
    if not isinstance(raw, dict) or not raw.get("steps"):
        raise ValueError(f"{path}: a pipeline is a map with steps")
    return raw


def run_config(spark: SparkSession, raw: dict[str, Any], **overrides: Any) -> State:
    """Runs a pipeline file; overrides take the place of what it says at the top level."""
    raw = raw | {k: v for k, v in overrides.items() if v is not None}
    source = raw.get("input") or {}
    if not source.get("file"):
        raise ValueError("a pipeline needs an input file")
    rows = readers.read_table(spark, source["file"])
    records = readers.load_records(rows, source.get("text_field", "text"), source.get("id_field", "id"), source.get("record_ids"), source.get("limit"))
    if raw.get("domain_folder"):
        register_domain(read_domain(raw["domain_folder"], raw.get("domain"), prompt=raw.get("prompt")))
    domain = get_domain(raw.get("domain", "default"), raw.get("mode", "open"))
    if raw.get("prompt") and not raw.get("domain_folder"):
        with open(raw["prompt"], encoding="utf-8") as file:
            domain = replace(domain, prompts={k: v for k, v in domain.prompts.items() if k != "extraction_constrained"} | {"extraction": file.read().strip()})
    settings = Settings(A.to_config(raw.get("client") or {}), domain, raw.get("output_dir"))
    state = start(records)
    if raw.get("triples"):
        saved = readers.read_triples(spark, raw["triples"]).join(records.select("record_id"), "record_id", "left_semi")
        state = replace(state, triples=T.normalize(saved).checkpoint())
    began = time.monotonic()
    state = run(state, raw["steps"], settings)
    if settings.output:
        write_metadata(state, settings, time.monotonic() - began, f"{settings.output}/run.json")
    return state
