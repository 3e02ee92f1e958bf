"""Triples: extraction by rule, normalisation, de-duplication, entities and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, find, strip, triple_string

#: The rule client's pattern: a capitalised word, a connecting word, a word.
RULE = r"\b([A-Z][a-z]+) (of|by|the|in|on|for|is|was|and|that) ([a-z]+)"
CONTEXTUAL = ("and", "that")


def extract_by_rule(records: DataFrame) -> DataFrame:
    """(record_id, seq, head, relation, tail, inference, justification) of every match of RULE; justification is the match."""
    found = records.select("record_id", F.posexplode(F.regexp_extract_all("text", F.lit(RULE), F.lit(0))).alias("seq", "match"))
    part = lambda i: F.split_part("match", F.lit(" "), F.lit(i))
    inference = F.when(part(2).isin(*CONTEXTUAL), "contextual").otherwise("explicit")
    return found.select("record_id", "seq", part(1).alias("head"), part(2).alias("relation"), part(3).alias("tail"), inference.alias("inference"), F.col("match").alias("justification"))


def normalize(triples: DataFrame) -> DataFrame:
    """Triples with stripped, non-empty parts and a known inference (null: explicit); all others are left out."""
    parts = {c: strip(F.col(c)) for c in ("head", "relation", "tail")}
    clean = triples.withColumns(parts | {"inference": F.coalesce("inference", F.lit("explicit"))})
    return clean.where((F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != "") & F.col("inference").isin("explicit", "contextual"))


def deduplicate(triples: DataFrame) -> DataFrame:
    """The first triple of each key: head and tail in lower case, relation in lower case and stripped."""
    w = Window.partitionBy("record_id", F.lower("head"), F.lower(strip(F.col("relation"))), F.lower("tail")).orderBy("seq")
    return triples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append(triples: DataFrame, more: DataFrame) -> DataFrame:
    """triples and more, which come after them; nothing is de-duplicated."""
    last = triples.groupBy("record_id").agg((F.max("seq") + 1).alias("_from"))
    moved = more.join(last, "record_id", "left").withColumn("seq", (F.col("seq") + F.coalesce("_from", F.lit(0))).cast("int")).drop("_from")
    return triples.unionByName(moved, allowMissingColumns=True)


def mentions(triples: DataFrame) -> DataFrame:
    """(record_id, seq, pos, entity, ...): each triple's head (pos 0) and tail (pos 1)."""
    return triples.select("*", F.posexplode(F.array("head", "tail")).alias("pos", "entity"))


def entities(triples: DataFrame) -> DataFrame:
    """The distinct stripped heads and tails of each record."""
    return mentions(triples).select("record_id", strip(F.col("entity")).alias("entity")).where("entity <> ''").distinct()


def strings(triples: DataFrame) -> DataFrame:
    return triples.select("record_id", "seq", triple_string(F.col("head"), F.col("relation"), F.col("tail")).alias("triple"))


def entity_edges(triples: DataFrame, most: int = 8) -> DataFrame:
    """(record_id, entity, edges): the first triples that an entity is part of, a self loop once."""
    each = triples.select("record_id", "seq", triple_string(F.col("head"), F.col("relation"), F.col("tail")).alias("triple"), F.explode(F.array_distinct(F.array("head", "tail"))).alias("entity"))
    w = Window.partitionBy("record_id", "entity").orderBy("seq")
    first = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return first.groupBy("record_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "triple"))), lambda r: r["triple"]).alias("edges"))


def entity_context(triples: DataFrame, most: int = 8) -> DataFrame:
    """(record_id, entity, context): the edges of an entity as one string."""
    return entity_edges(triples, most).select("record_id", "entity", F.array_join("edges", "; ").alias("context"))


def duplicate_rate(triples: DataFrame) -> DataFrame:
    counts = triples.groupBy("record_id", "head", "relation", "tail").agg(F.count("*").alias("n"))
    return counts.groupBy("record_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique")).withColumn("duplicate_rate", 1 - F.col("n_unique") / F.col("total"))


def invert_groups(groups: DataFrame) -> DataFrame:
    """(record_id, variant_key, canonical) from groups (record_id, seq, canonical, variants): the last group that names a variant counts; a variant equal to its canonical name is none."""
    each = groups.select("record_id", "seq", strip(F.col("canonical")).alias("canonical"), F.explode("variants").alias("v"))
    each = each.select("record_id", "seq", "canonical", strip(F.col("v")).alias("v")).where("canonical <> '' AND v <> '' AND v <> canonical")
    return each.groupBy("record_id", F.lower("v").alias("variant_key")).agg(F.max_by("canonical", F.struct("seq", "canonical")).alias("canonical"))


def apply_mapping(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples with mapped heads and tails, each mapped once, then de-duplicated."""
    for column in ("head", "tail"):
        names = mapping.select("record_id", F.col("variant_key").alias("_key"), F.col("canonical").alias("_to"))
        joined = triples.withColumn("_key", F.lower(strip(F.col(column)))).join(names, ["record_id", "_key"], "left")
        triples = joined.withColumn(column, F.coalesce("_to", column)).drop("_key", "_to")
    return deduplicate(triples)


def resolution_stats(before: DataFrame, mapping: DataFrame, after: DataFrame) -> DataFrame:
    """Per record: variants mapped, canonical names, triples before, after and removed."""
    b = before.groupBy("record_id").agg(F.count("*").alias("n_before"))
    m = mapping.groupBy("record_id").agg(F.count("*").alias("n_variants"), F.countDistinct("canonical").alias("n_canonical"))
    a = after.groupBy("record_id").agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return b.join(m, "record_id", "left").join(a, "record_id", "left").select("record_id", zero("n_variants"), zero("n_canonical"), "n_before", zero("n_after"), (F.col("n_before") - F.coalesce("n_after", F.lit(0))).alias("n_removed"))


def rule_groups(triples: DataFrame, key) -> DataFrame:
    """Groups of entities with one key: the canonical name is the longest, then the least; a record's groups are in the order of their keys."""
    some = entities(triples).withColumn("k", key(F.col("entity"))).where("k <> ''")
    each = some.groupBy("record_id", "k").agg(F.max_by("entity", F.struct(F.length("entity"), F.lit(0))).alias("longest"), F.max(F.length("entity")).alias("length"), F.array_sort(F.collect_set("entity")).alias("names")).where(F.size("names") > 1)
    canonical = F.array_min(F.filter("names", lambda x: F.length(x) == F.col("length")))
    return each.select("record_id", (F.row_number().over(Window.partitionBy("record_id").orderBy("k")) - 1).alias("seq"), canonical.alias("canonical"), F.filter("names", lambda x: x != canonical).alias("variants"))


def resolve_by_rule(triples: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """(resolved triples, mapping) with the rule client's groups; a record with one entity or none is unchanged."""
    mapping = invert_groups(rule_groups(triples, key))
    return apply_mapping(triples, mapping), mapping


def entity_spans(triples: DataFrame, records: DataFrame, group_by: str = "entity_type") -> DataFrame:
    """(record_id, idx, entity, start, end, class, description): each entity where it first stands in the text, its class from its first use that is found."""
    used = mentions(triples).join(records.select("record_id", "text"), "record_id")
    used = used.withColumn("start", find(F.col("text"), F.col("entity"))).where("start >= 0")
    w = Window.partitionBy("record_id", F.lower("entity")).orderBy("seq", "pos")
    first = used.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    role = F.when(F.col("pos") == 0, "Head").otherwise("Tail")
    if group_by == "relation":
        kind = F.concat("relation", F.when(F.col("pos") == 0, " (source)").otherwise(" (target)"))
    else:
        kind = F.concat(role, F.lit(" Entity"), F.when(F.col("inference") == "contextual", " (Augmented)").otherwise(""))
    about = F.concat(role, F.lit(" of relation: '"), "relation", F.lit("' | Inference: "), "inference")
    order = Window.partitionBy("record_id").orderBy("seq", "pos")
    return first.select("record_id", (F.row_number().over(order) - 1).alias("idx"), "entity", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("entity")).cast("int").alias("end"), kind.alias("class"), about.alias("description"))


def source_excerpt(records: DataFrame, n: int = 4000) -> DataFrame:
    return records.select("record_id", excerpt(F.col("text"), n).alias("excerpt"))


def is_augmented(inference: Column) -> Column:
    return F.coalesce(F.contains(F.lower(inference), F.lit("contextual")), F.lit(False))
