"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words

#: A source's keys fall into CELLS ranges, and each of them into CELLS again, so that no sum or sort needs a whole source.
CELLS = 128


def default_quality(text: Column, size: Column) -> Column:
    """A document's weight: 0.5, and 0.5 more each for 20 words or more and for words of 3 to 10 characters on average."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.when(size >= 20, 0.5).otherwise(0.0) + F.when(mean.between(3, 10), 0.5).otherwise(0.0)


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from a hash of seed and doc_id: the smallest keys are a weighted sample without replacement."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / F.lit(float(2**53))
    return -F.log(u) / weight


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """totals (source, source_size) with target: weights go round the sources by code point, null last; what goes beyond most times a source's size is shared anew by weight.

    Sharing again until no target is above its limit ends where every target is the lesser of its limit and
    weight * level for one level. In the order of limit / weight the sources at their limit come first, so
    prefix sums find that level at once. One row a source, and so small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(order) - 1
    by_ratio = Window.orderBy("ratio", "position")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    placed = totals.withColumn("position", n).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("limit", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    summed = placed.withColumn("whole", share * F.sum("source_size").over(every)).withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    summed = summed.withColumn("level", (F.col("whole") - F.col("full")) / F.col("open"))
    level = F.coalesce(F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "position"))).over(every), F.max("ratio").over(every))
    return summed.withColumn("level", level).select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.col("level")).alias("target"))


def _boundary(cells: DataFrame, plan: DataFrame, cell: str) -> DataFrame:
    """Of each source the cell in which its prefix sum reaches need, with before, the sum of the cells ahead of it."""
    w = Window.partitionBy("source_key").orderBy(cell)
    run = cells.join(plan, "source_key").withColumn("to", F.sum("words").over(w)).withColumn("before", F.col("to") - F.col("words"))
    return run.where((F.col("before") < F.col("need")) & (F.col("to") >= F.col("need")))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7, quality: Column | None = None) -> DataFrame:
    """One row a source: source, source_size, target, epochs, and where its fractional part ends: last_key, last_id, last_words."""
    size = n_words(F.col("text"))
    weight = default_quality(F.col("text"), F.col("size")) if quality is None else quality
    sized = docs.select("doc_id", "source", "text", size.alias("size")).select("doc_id", F.struct("source").alias("source_key"), "size", exponential_key(F.col("doc_id"), F.coalesce(weight, F.lit(0.5)), seed).alias("key"))
    spread = (F.lit(1.0) - F.exp(-F.col("key"))) * (CELLS * CELLS)
    sized = sized.withColumn("cell", F.least(F.floor(spread), F.lit(CELLS * CELLS - 1)).cast("int"))
    sized = materialize(sized.select("doc_id", "source_key", "size", "key", (F.col("cell") / CELLS).cast("int").alias("c1"), (F.col("cell") % CELLS).cast("int").alias("c2")), "mix")
    # one pass for the sums of sources and of their cells: the cells are sums of the finest level
    fine = sized.groupBy("source_key", "c1").agg(F.sum("size").alias("words"))
    fine = materialize(fine, "mix")
    totals = fine.groupBy("source_key").agg(F.sum("words").alias("source_size")).select(F.col("source_key.source").alias("source"), "source_size")
    targets = source_targets(totals, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("need", F.greatest(F.lit(0), F.least(F.col("source_size"), F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))))
    plan = materialize(plan.withColumn("source_key", F.struct("source")), "mix")
    open_ = plan.where("need > 0").select("source_key", "need")
    first = _boundary(fine, open_, "c1").select("source_key", "c1", (F.col("need") - F.col("before")).alias("need"))
    first = materialize(first, "mix")
    inside = sized.join(first, ["source_key", "c1"])
    second = _boundary(inside.groupBy("source_key", "c2").agg(F.sum("size").alias("words")), first.select("source_key", "need"), "c2")
    second = second.select("source_key", "c2", (F.col("need") - F.col("before")).alias("need"))
    rows = sized.join(first.drop("need"), ["source_key", "c1"]).join(second, ["source_key", "c2"])
    rows = rows.groupBy("source_key", "need", "key", "doc_id").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    w = Window.partitionBy("source_key").orderBy("key", F.col("doc_id").asc_nulls_first())
    last = rows.withColumn("to", F.sum("words").over(w)).withColumn("before", F.col("to") - F.col("words")).where((F.col("before") < F.col("need")) & (F.col("to") >= F.col("need")))
    last = last.select("source_key", F.col("key").alias("last_key"), F.col("doc_id").alias("last_id"), F.floor((F.col("need") - F.col("before")) / F.col("copies")).cast("long").alias("last_words"))
    return materialize(plan.join(last, "source_key", "left").drop("source_key", "need"), "mix")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7, quality: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, epochs, part and taken: how often the mix takes each whole document, and how many words of it once more.

    Every source's target is a weighted share of all words (source_targets). The mix takes whole epochs of a
    source first; the rest goes to the documents with the smallest exponential keys, scaled by quality, up to
    the budget, and of the last document as many words as are left. Prefix sums run over ranges of keys within
    a source and then within the range in which the budget ends: a source that holds most rows is never
    sorted in one task. The same rows and seed give the same mix.

    A null or empty text has size 0 and is taken 0 times; null sources are one source, last in order; rows
    with the same doc_id and key at the end of the budget share what is left of it; an empty table gives an
    empty result. Columns of docs that have a result's name are replaced.
    """
    plan = plan_mix(docs, weights, share, most, seed, quality)
    made = ("size", "source_size", "target", "epochs", "part", "taken")
    left = docs.drop(*made).withColumn("size", n_words(F.col("text")))
    weight = default_quality(F.col("text"), F.col("size")) if quality is None else quality
    left = left.withColumn("_key", exponential_key(F.col("doc_id"), F.coalesce(weight, F.lit(0.5)), seed))
    joined = left.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    ahead = (F.col("_key") < F.col("last_key")) | ((F.col("_key") == F.col("last_key")) & F.coalesce(F.struct(F.col("doc_id")) < F.struct(F.col("last_id")), F.lit(False)))
    at = (F.col("_key") == F.col("last_key")) & F.col("doc_id").eqNullSafe(F.col("last_id"))
    part = F.when(at, F.least(F.col("size"), F.col("last_words"))).when(ahead, F.col("size")).otherwise(0).cast("long")
    return joined.withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("_key", "_source", "last_key", "last_id", "last_words")


def mixed_documents(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The documents of the mix, with columns: each as many times as it is taken whole, then once more with the first words of the last, partial time."""
    mixed = mix_sources(docs, **options)
    part = F.col("part").cast("int")
    # no counted group in a pattern: Java walks it recursively, which overflows the stack on long texts
    gaps, words = F.split("text", WORD), F.regexp_extract_all("text", F.lit(f"({WORD})"))
    cut = F.array_join(F.zip_with(F.slice(gaps, 1, part), F.slice(words, 1, part), lambda gap, word: F.concat(gap, word)), "")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = mixed.where("size > 0").withColumn("_partial", F.explode(copies))
    text = F.when(F.col("_partial") & (F.col("part") < F.col("size")), cut).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
