"""Schema constraints: allowed relations and entity types, and what they reject."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key, strip

#: Relations whose head or tail names a type.
TYPE_RELATIONS = ("is_type", "is_type_of", "type_of", "instance_of", "entity_type", "category_of")
#: The fields of a raw triple that may hold type labels, in order.
TYPE_FIELDS = ("head_type", "tail_type", "entity_type", "source_type", "target_type")


def key(label: str) -> str:
    """label_key for a Python string."""
    return re.sub(r"[^a-z0-9]+", "_", label.strip().lower()).strip("_")


def distinct_labels(labels: Sequence[str]) -> tuple[str, ...]:
    """labels without those whose key is empty or came before."""
    seen: dict[str, str] = {}
    for label in labels:
        if key(label):
            seen.setdefault(key(label), label)
    return tuple(seen.values())


@dataclass(frozen=True)
class Constraints:
    enforce: bool = False
    entity_types: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    relations: frozenset[str] = field(init=False)
    types: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "relations", frozenset(map(key, self.relation_types)))
        object.__setattr__(self, "types", frozenset(map(key, self.entity_types)))

    def guidance(self) -> str:
        """Text for a prompt; empty unless the constraints are enforced."""
        if not self.enforce:
            return ""
        parts = [f"{name}:\n" + "\n".join(f"- {x}" for x in labels) for name, labels in (("Entity types to use", self.entity_types), ("Relations to use", self.relation_types)) if labels]
        return "\n\n".join(parts)


def example_triples(example: dict) -> list[dict]:
    """The triples of a worked example: the attributes of its extractions, then its output."""
    found = [x.get("attributes") for x in example.get("extractions") or []] + list(example.get("output") or [])
    return [x for x in found if isinstance(x, dict)]


def collect_constraints(constrained: bool, entity_types: Sequence[str], relation_types: Sequence[str], examples: Sequence[dict] = ()) -> Constraints:
    """A domain's constraints: in constrained mode its schema's labels and the relations of its examples; in open mode, or without any label, none."""
    if not constrained:
        return Constraints()
    used = [t["relation"] for e in examples for t in example_triples(e) if isinstance(t.get("relation"), str)]
    types, relations = distinct_labels(entity_types), distinct_labels([*relation_types, *used])
    return Constraints(bool(types or relations), types, relations)


def relation_allowed(c: Constraints) -> Column:
    return label_key(F.col("relation")).isin(*sorted(c.relations)) if c.relations else F.lit(True)


def type_labels(columns: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """The stripped, non-empty labels of the type fields: arrays of strings, or strings, which are one label each."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.concat(F.col(x), none) if kinds is None or kinds.get(x, "").startswith("array") else F.when(F.col(x).isNotNull(), F.array(F.col(x))), none) for x in TYPE_FIELDS if x in columns]
    if not parts:
        return F.array().cast("array<string>")
    return F.filter(F.transform(F.flatten(F.array(*parts)), strip), lambda x: x != "")


def types_allowed(c: Constraints, columns: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """Whether a triple's entity types are allowed: true, false, or null where nothing tells."""
    if not c.types:
        return F.lit(True)
    known = sorted(c.types)
    labels = type_labels(columns, kinds)
    fits = lambda x: label_key(x).isin(*known)
    return F.when(F.size(labels) > 0, F.forall(labels, fits)).when(label_key(F.col("relation")).isin(*TYPE_RELATIONS), fits(F.col("head")) | fits(F.col("tail")))


def judge(triples: DataFrame, c: Constraints) -> DataFrame:
    """triples with relation_ok, type_ok (null: skipped) and reasons; accepted ones have no reasons."""
    judged = triples.withColumn("relation_ok", relation_allowed(c) if c.enforce else F.lit(True)).withColumn("type_ok", types_allowed(c, triples.columns, dict(triples.dtypes)) if c.enforce else F.lit(True))
    reasons = F.filter(F.array(F.when(~F.col("relation_ok"), "relation_type"), F.when(~F.col("type_ok"), "entity_type")), lambda x: x.isNotNull())
    return judged.withColumn("reasons", reasons)


def summary(judged: DataFrame) -> DataFrame:
    """Per record: accepted and rejected triples, rejections for each reason, and triples whose types were skipped."""
    return judged.groupBy("record_id").agg(
        F.count_if(F.size("reasons") == 0).alias("n_accepted"),
        F.count_if(F.size("reasons") > 0).alias("n_rejected"),
        F.count_if(~F.col("relation_ok")).alias("n_bad_relation"),
        F.count_if(F.coalesce(~F.col("type_ok"), F.lit(False))).alias("n_bad_type"),
        F.count_if(F.col("type_ok").isNull()).alias("n_skipped"),
    )


def warn_of_rejects(stage: str, judged: DataFrame) -> int:
    """How many triples the constraints reject, with a Python warning if there are any: counts, not rows, come to the driver."""
    n = judged.where(F.size("reasons") > 0).count()
    if n:
        warnings.warn(f"{stage}: the schema rejects {n} triples", stacklevel=2)
    return n


def rejected_samples(judged: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy("seq")
    bad = judged.where(F.size("reasons") > 0).withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= most)
    return bad.select("record_id", "sample", "head", "relation", "tail", F.array_join("reasons", ",").alias("reasons"))
