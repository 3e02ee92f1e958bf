"""Model calls over records, and the strategies that refine their graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..clients import ClientConfig, LLMClientError, create_client
from ..functions.text import item_field, label_key, render_prompt, response_value, sanitize_control, strip, value_items
from ..operators import graph
from ..operators import triples as T
from ..operators.constraints import judge
from .domains import Domain

FIELDS = ("head", "relation", "tail", "inference", "justification")
_SENTENCE_END = re.compile(r"[.!?。！？]\s+|\n+")
_SPACE = re.compile(r"\s+")


def call_model(prompts: DataFrame, config: ClientConfig, kind: str, iteration: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(record_id, response, error) of prompts (record_id, text, prompt), and the integer columns keep of prompts: one call each, checkpointed, so that no call is made again."""

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = create_client(config)

        def one(row: tuple[str, str, str]) -> tuple[str, str | None, str | None]:
            record_id, text, prompt = row
            try:
                return record_id, client.extract(record_id, text, prompt) if kind == "extract" else client.augment(record_id, text, prompt, iteration), None
            except LLMClientError as e:
                return record_id, None, str(e)[:500]

        with ThreadPoolExecutor(config.max_workers or 1) as pool:
            for batch in batches:
                rows = list(zip(batch["record_id"], batch["text"], batch["prompt"], strict=True))
                step = config.batch_length or len(rows) or 1
                out = [x for at in range(0, len(rows), step) for x in pool.map(one, rows[at : at + step])]
                done = pd.DataFrame(out, columns=["record_id", "response", "error"])
                yield done.assign(**{c: batch[c].to_numpy() for c in keep})

    kept = "".join(f", {c} int" for c in keep)
    return prompts.select("record_id", "text", "prompt", *keep).mapInPandas(called, f"record_id string, response string, error string{kept}").checkpoint()


def parse_triples(responses: DataFrame, *keep: str, any_key: bool = False) -> DataFrame:
    """(record_id, seq, triple fields) of the objects in responses, and the columns keep; answers that are no JSON give none. any_key: see value_items."""
    values = responses.select("record_id", *keep, response_value(sanitize_control(F.col("response"))).alias("value"))
    items = values.select("record_id", *keep, F.posexplode(value_items(F.col("value"), any_key)).alias("seq", "item")).where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    return items.select("record_id", *keep, "seq", *[item_field(F.col("item"), c).alias(c) for c in FIELDS])


def chunks(text: str, size: int) -> list[str]:
    """A text in pieces of at most size characters that make it up: each ends after its last sentence or line, else after its last white space, where it has one."""
    out, at = [], 0
    while len(text) - at > size:
        piece = text[at : at + size]
        ends = [m.end() for m in _SENTENCE_END.finditer(piece)] or [m.end() for m in _SPACE.finditer(piece)] or [size]
        out.append(piece[: ends[-1]])
        at += ends[-1]
    return [*out, text[at:]]


def extract(records: DataFrame, config: ClientConfig, domain: Domain) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of a model's extraction, normalised and within the domain's constraints.

    Each text goes in chunks of max_char_buffer characters, extraction_passes times; of a triple that a later
    pass finds again the first is kept. A record with a failed call, or
    with an answer that holds no JSON, has one error and no triples. The rule
    client reads whole texts, and always the same in them: it gets one call.
    """
    limits = domain.constraints("extraction")
    whole = config.client_type == "rule"
    size = config.max_char_buffer
    cut = F.udf(lambda text: chunks(text or "", size), "array<string>")
    pieces = records.select("record_id", F.lit(0).alias("chunk"), "text") if whole else records.select("record_id", F.posexplode(cut("text")).alias("chunk", "text"))
    pieces = pieces.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(0 if whole else config.extraction_passes - 1))))
    prompt = render_prompt(domain.full_prompt("extraction"), F.to_json(F.struct("record_id", "text")), limits.guidance())
    answers = call_model(pieces.select("record_id", "text", "pass", "chunk", prompt.alias("prompt")), config, "extract", keep=("pass", "chunk"))
    unread = F.when(F.col("error").isNull() & response_value(sanitize_control(F.col("response"))).isNull(), F.concat(F.lit("no JSON in the answer: "), F.substring(F.coalesce("response", F.lit("")), 1, 400)))
    bad = answers.withColumn("error", F.coalesce("error", unread)).where("error IS NOT NULL")
    good = answers.join(bad.select("record_id"), "record_id", "left_anti")
    parsed = parse_triples(good, "pass", "chunk", any_key=config.client_type == "gemini")
    found = T.normalize(parsed)
    if not whole:
        first = F.min("pass").over(Window.partitionBy("record_id", "head", "relation", "tail"))
        place = F.row_number().over(Window.partitionBy("record_id").orderBy("pass", "chunk", "seq")) - 1
        found = found.withColumn("_first", first).where(F.col("pass") == F.col("_first")).withColumn("seq", place.cast("int"))
    found = judge(found.drop("pass", "chunk", "_first"), limits).where(F.size("reasons") == 0)
    message = F.min_by("error", F.struct("pass", "chunk"))
    return found.select("record_id", "seq", *FIELDS), bad.groupBy("record_id").agg(message.alias("message")).select("record_id", F.lit("extract").alias("step"), "message")


def component_heads(triples: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(record_id, component, n): each record's components by their least name, and how many the record has; found: the components, if they are there."""
    found = graph.components(graph.raw_edges(triples)) if found is None else found
    each = found.select("record_id", "component").distinct()
    return each.join(each.groupBy("record_id").agg(F.count("*").alias("n")), "record_id")


def bridge_by_rule(triples: DataFrame, max_disconnected: int = 1) -> DataFrame:
    """The rule client's bridges: from the least name of every component but the first to that of the first."""
    heads = component_heads(triples).where(F.col("n") > max_disconnected)
    firsts = heads.groupBy("record_id").agg(F.min("component").alias("tail"))
    return heads.join(firsts, "record_id").where("component <> tail").select("record_id", F.col("component").alias("head"), F.lit("part_of_context").alias("relation"), "tail", F.lit("contextual").alias("inference"))


def connectivity(records: DataFrame, triples: DataFrame, config: ClientConfig, domain: Domain, max_disconnected: int = 3, max_iterations: int = 2, dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples, iterations): model-made bridges until a record has at most max_disconnected components.

    Only records above the limit are asked, with all their triples and each component's first entities and
    triples, a component a line. Bridges are contextual whatever the model says. A failed call keeps
    what came before and ends the record's iterations; iterations has (record_id, iteration, components, error).
    Triples are checkpointed, and components sought again only where the iteration before has asked for bridges:
    all other records are as they were.
    """
    limits = domain.constraints("connectivity")
    triples = triples.checkpoint()
    left = triples
    log: DataFrame | None = None
    for iteration in range(max_iterations):
        found = graph.components(graph.raw_edges(left)).checkpoint()
        heads = component_heads(left, found).where(F.col("n") > max_disconnected).checkpoint()
        if heads.isEmpty():
            break
        asked_for = heads.select("record_id").distinct()
        mine = left.join(asked_for, "record_id", "left_semi")
        parts = graph.component_summary(mine, found).join(heads, ["record_id", "component"]).select("record_id", "n", F.struct(F.col("component").alias("name"), "n_entities", "entities", "n_triples", "triples").alias("part"))
        numbered = parts.groupBy("record_id", "n").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        current = mine.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("seq", *FIELDS))).alias("current")).select("record_id", F.transform("current", lambda t: F.struct(*[t[c].alias(c) for c in FIELDS])).alias("current_triples"))
        lines = F.array_join(F.transform("parts", lambda x, i: F.concat(F.lit("Component "), (i + 1).cast("string"), F.lit(": "), F.to_json(x))), "\n")
        prompt = F.concat(render_prompt(domain.full_prompt("connectivity"), F.to_json(F.struct("record_id", "text", "current_triples")), limits.guidance()), F.lit("\n"), lines)
        asked = records.select("record_id", "text").join(numbered, "record_id").join(current, "record_id").select("record_id", "text", "n", prompt.alias("prompt"))
        answers = call_model(asked, config, "augment", iteration)
        new = T.normalize(parse_triples(answers).withColumn("inference", F.lit("contextual")))
        new = judge(new, limits).where(F.size("reasons") == 0).select("record_id", "seq", *FIELDS)
        triples = T.append(triples, new).checkpoint()
        left = triples.join(answers.where("error IS NULL").select("record_id"), "record_id", "left_semi")
        row = asked.select("record_id", "n").join(answers, "record_id").select("record_id", F.lit(iteration).alias("iteration"), F.col("n").alias("components"), "error")
        log = row if log is None else log.union(row)
    if log is None:
        log = triples.sparkSession.createDataFrame([], "record_id string, iteration int, components bigint, error string")
    return (T.deduplicate(triples) if dedupe else triples), log


def entity_resolution(records: DataFrame, triples: DataFrame, config: ClientConfig, domain: Domain) -> tuple[DataFrame, DataFrame]:
    """(triples, mapping): names that are one thing brought to one; the rule client's groups are those of equal label keys, a model gets each entity's first triples."""
    if config.client_type == "rule":
        return T.resolve_by_rule(triples, label_key)
    edges = T.entity_edges(triples.withColumns({c: strip(F.col(c)) for c in ("head", "tail")}))
    used = T.entities(triples).join(edges, ["record_id", "entity"], "left").select("record_id", F.struct(F.col("entity").alias("name"), "edges").alias("entity"))
    names = used.groupBy("record_id").agg(F.array_sort(F.collect_list("entity")).alias("entities")).where(F.size("entities") > 1)
    excerpt = T.source_excerpt(records)
    asked = names.join(excerpt, "record_id").select("record_id", F.col("excerpt").alias("text"), render_prompt(domain.full_prompt("entity_resolution"), F.to_json(F.struct("excerpt", "entities")), "").alias("prompt"))
    answers = call_model(asked, config, "augment")
    values = answers.select("record_id", response_value(F.col("response")).alias("value"))
    items = values.select("record_id", F.posexplode(value_items(F.col("value"))).alias("seq", "item"))
    groups = items.select("record_id", "seq", F.try_variant_get("item", "$.canonical", "string").alias("canonical"), F.try_variant_get("item", "$.variants", "array<string>").alias("variants"))
    mapping = T.invert_groups(groups)
    return T.apply_mapping(triples, mapping), mapping


STRATEGIES: dict[str, Callable] = {"connectivity": connectivity, "entity_resolution": entity_resolution}


def register_strategy(name: str):
    """Registers a strategy (records, triples, config, domain, **options) -> (triples, log)."""

    def put(f: Callable) -> Callable:
        STRATEGIES[name] = f
        return f

    return put


def augment(records: DataFrame, triples: DataFrame, config: ClientConfig, domain: Domain, strategy: str = "connectivity", **options) -> tuple[DataFrame, DataFrame]:
    """A strategy's (triples, log) over given triples.

    Triples that are given count only within the domain's constraints for extraction.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    limits = domain.constraints("extraction")
    if limits.enforce:
        triples = judge(triples, limits).where(F.size("reasons") == 0).select(*triples.columns)
    return STRATEGIES[strategy](records, triples, config, domain, **options)


def to_config(settings: dict) -> ClientConfig:
    """A client's configuration from a pipeline file's client section."""
    names = {"type": "client_type", "model": "model_id", "workers": "max_workers"}
    return ClientConfig(**{names.get(k, k): json.loads(v) if k == "options" and isinstance(v, str) else v for k, v in settings.items()})
