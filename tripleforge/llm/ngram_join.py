"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a grouped prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .atoms import word_hashes
from .common import bounded, connected_components, discard, give_back, materialize

#: Slots of the sketch of shingle counts (a power of two), and the rows that carry it.
SLOT_BITS, CHUNKS = 21, 32
#: Partial sketches that one task adds up at most.
MERGE = 16
#: Bytes of text of which the shingles are held at once; a longer text is alone.
BATCH_BYTES = 1 << 20
#: Bits of the filter of texts to compare.
FILTER_BITS = 1 << 22
#: Rows of a key that one task compares with all rows of the key; a key of more rows is hot, and HEADS further heads of it are compared first.
BLOCK_ROWS, HEADS = 512, 6
#: Keys of a set ahead of each that tell whether a pair has met before.
EARLIER = 4
#: The columns of a set's 256 parities: whether an odd number of its shingles fall in each class of hashes.
ODD = ("o1", "o2", "o3", "o4")
#: Classes of the finer parities, in column wide.
WIDE = 1_024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; of fewer words, the whole sequence as one."""
    h, counts = word_hashes(texts)
    rolled = np.full(len(h), np.uint64(k), dtype=np.uint64)
    for j in range(min(k, len(h))):
        rolled[: len(h) - j] = _mixed(rolled[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
    out = []
    starts = np.cumsum(counts) - counts
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(rolled[start : start + n - k + 1]))
        elif n:
            short = np.array([n + 0x5A17], dtype=np.uint64)
            for word in h[start : start + n]:
                short = _mixed(short * np.uint64(0x9E3779B97F4A7C15) + word)
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """For each slot of a shingle's hash the logarithm of the number of documents' shingles that fall there, over all documents.

    Its size does not depend on the input. Tasks count; their partial sketches are added up MERGE at a time.
    """
    size = 1 << SLOT_BITS
    part = size // CHUNKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        task = 0
        for batch in batches:
            task = batch.column(1)[0].as_py() if batch.num_rows else task
            for some in bounded(batch, 0, BATCH_BYTES):
                np.add.at(total, (np.concatenate(shingle_sets(some.column(0), k)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        if total.any():
            rows = [zstandard.compress(total[i * part : (i + 1) * part].tobytes(), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task] * CHUNKS, pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "task", "data"])
        give_back()

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(d), dtype=np.int64) for d in group["data"])
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "task": [group["task"].iloc[0] // MERGE], "data": [zstandard.compress(total.tobytes(), 1)]})

    kind = "chunk int, task int, data binary"
    read = docs.select("text", F.spark_partition_id().alias("task"))
    tasks = read.rdd.getNumPartitions()
    parts = read.mapInArrow(counted, kind)
    while tasks > 1:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / MERGE)).applyInPandas(added, kind)
        tasks = -(-tasks // MERGE)
    out = np.zeros(size, dtype=np.int64)
    for row in parts.collect():
        out[row.chunk * part : (row.chunk + 1) * part] = np.frombuffer(zstandard.decompress(row.data), dtype=np.int64)
    return np.minimum(255, np.floor(6 * np.log2(out + 1.0))).astype(np.uint8)


def prefixes(docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """(doc_id, n, s1, s2, p1, p2, o1 to o4, wide, prefix): the size, hash and parities of each document's set, and its prefix with its hash.

    Shingles are in the order of their slot's count, then of their hash; any two sets that are alike enough
    share one among the first n - ceil(percent * n / 100) + 1.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for some in bounded(batch, 1, BATCH_BYTES):
                rows: list[list] = [[] for _ in range(11)]
                for x in shingle_sets(some.column(1), k):
                    n = len(x)
                    order = counts[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | x >> np.uint64(8)
                    length = n - (percent * n + 99) // 100 + 1 if n else 0
                    prefix = np.sort(order)[:length] if length < 8 or n < 64 else np.sort(np.partition(order, length - 1)[:length])
                    whole, part = xxhash.xxh3_128_digest(x.tobytes()), xxhash.xxh3_128_digest(prefix.tobytes())
                    s, p = np.frombuffer(whole, dtype=np.int64), np.frombuffer(part, dtype=np.int64)
                    odd = np.bincount((x & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1
                    wide = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    few = np.packbits((odd.reshape(-1, 256).sum(axis=0) & 1).astype(np.uint8)).view(np.int64)
                    for column, value in zip(rows, (n, *s.tolist(), *p.tolist(), *few.tolist(), wide, prefix.view(np.int64)), strict=True):
                        column.append(value)
                arrays = [pa.array(rows[0], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[1:9]], *[pa.array(c, pa.list_(pa.int64())) for c in rows[9:]]]
                yield pa.RecordBatch.from_arrays([some.column(0), *arrays], names=["doc_id", "n", "s1", "s2", "p1", "p2", *ODD, "wide", "prefix"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, n int, s1 long, s2 long, p1 long, p2 long, o1 long, o2 long, o3 long, o4 long, wide array<long>, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc, shingles) of the wanted documents (doc), and of a few others: a bitmap of hashes, of fixed size, passes over most other texts."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    marks = wanted.select((slot + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for row in marks.collect():
        bits[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    marked = spark.sparkContext.broadcast(np.unpackbits(np.frombuffer(bytes(bits), dtype=np.uint8), bitorder="little").view(np.bool_))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(marked.value[batch.column(2).to_numpy()]))
            for part in bounded(some, 1, BATCH_BYTES):
                sets = [x.view(np.int64) for x in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "shingles"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL").withColumn("slot", slot)
    return texts.mapInArrow(made, "doc long, shingles array<long>")


def _alike(percent: int, same, n_a, n_b):
    return same * 100 >= percent * (n_a + n_b - same)


def _possible(percent: int, a: str, b: str):
    """Whether two sets that first share the shingles at these places can still be alike: by their sizes, and by what is left after the places."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    left = F.least(n_a - F.col(f"{a}pos"), n_b - F.col(f"{b}pos"))
    return _alike(percent, left, n_a, n_b)


def _near(percent: int, a: str, b: str):
    """Whether the parities let two sets be alike: as many shingles as parities differ stand in one set only."""
    differ = sum((F.bit_count(F.col(f"{a}{o}").bitwiseXOR(F.col(f"{b}{o}"))) for o in ODD), F.lit(0))
    return differ * (100 + percent) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _near_wide(percent: int):
    """As _near, from the parities in WIDE classes."""
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (100 + percent) <= (100 - percent) * (F.col("a_n") + F.col("b_n"))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, wide: bool = False) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike: by their parities first, in more classes where there are many pairs, and then compared whole."""
    columns = ("n", "wide") if wide else ("n", *ODD)
    a, b = (reps.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]) for x in "ab")
    near = _near_wide(percent) if wide else _near(percent, "a_", "b_")
    pairs = materialize(pairs.join(a, "a").join(b, "b").where(near).select("a", "b").distinct(), "ngram")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = materialize(sets_of(docs, wanted, k), "ngram")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(_alike(percent, same, F.size("x"), F.size("y"))).select("a", "b")


def join_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the size of its set of k-word shingles, and the smallest doc_id that links reach.

    Two documents link when their sets' intersection is at least percent of their union. Equal sets are one
    first. Sets of one size with identical prefixes are one group; groups that share a shingle of their
    prefixes are compared by size and by the shingle's places, and pairs that remain are expanded to their
    members and compared whole. Of the groups that share a shingle the smallest is compared with all others
    first; after that only pairs that are not yet in one component are compared, so that a large group of
    copies costs one comparison each. Shingles are in the order of a sketch of their counts over all
    documents, rarest first, so passages that many documents share are hardly ever in a prefix; the order
    changes what is compared, never what links.

    Texts that are null or without words have an empty set and link with nothing; a set of fewer than k words
    is the whole sequence; rows that repeat a doc_id are one document for components; a row without a doc_id
    has the component of its copies, if any. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(count_sketch(docs, k))
    found = materialize(prefixes(docs, k, percent, sketch), "ngram")
    reps = materialize(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("doc_id").alias("rep"), *[F.first(o).alias(o) for o in (*ODD, "wide")]), "ngram")
    groups = materialize(reps.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), "ngram")
    # a group's prefix is that of its first document; rows of one doc_id with other texts are told apart by the hash
    heads = groups.select(F.col("gid").alias("doc_id"), "n", "p1", "p2")
    rows = found.join(heads, ["doc_id", "n", "p1", "p2"], "left_semi").select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "key"))
    twice = rows.groupBy("key").agg(F.count("*").alias("lists")).where("lists > 1").select("key")
    rows = materialize(rows.join(twice, "key", "left_semi"), "ngram")
    one = F.struct("n", "gid", "pos")
    heads = rows.groupBy("key").agg(F.min(one).alias("least"), F.max(one).alias("most")).where("least.gid <> most.gid").select("key", F.col("least.n").alias("h_n"), F.col("least.gid").alias("h_gid"), F.col("least.pos").alias("h_pos"))
    shared = rows.join(heads, "key")
    many = groups.where("members > 1").select("n", "p1", "p2", "gid")
    inside = materialize(reps.join(many, ["n", "p1", "p2"]).select("gid", "rep", "n"), "ngram")

    # members of groups: most groups are their only member
    more = inside.where("gid <> rep").select("gid", "rep")

    def expanded(pairs: DataFrame) -> DataFrame:
        left = pairs.select("g", "h").join(more.toDF("g", "m"), "g", "left").select(F.explode(F.array_distinct(F.array("g", F.coalesce("m", "g")))).alias("a"), "h").distinct()
        return left.join(more.toDF("h", "m"), "h", "left").select("a", F.explode(F.array_distinct(F.array("h", F.coalesce("m", "h")))).alias("b")).distinct()

    near = shared.where((F.col("gid") != F.col("h_gid")) & _possible(percent, "", "h_")).select(F.col("h_gid").alias("g"), F.col("gid").alias("h")).distinct()
    first = materialize(expanded(near).union(inside.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))).distinct(), "ngram")
    links = materialize(verified(first, reps, docs, k, percent), "ngram")
    reached = materialize(connected_components(links), "ngram")

    # what is left: pairs that share a shingle of their prefixes and are not in one component yet
    listed = shared.select("key", "pos", "n", "gid").join(more, "gid", "left").select("key", "pos", "n", F.explode(F.array_distinct(F.array("gid", F.coalesce("rep", "gid")))).alias("rep"))
    listed = listed.union(inside.select(F.xxhash64(F.lit("group"), "gid").alias("key"), F.lit(0).alias("pos"), "n", "rep"))

    def still_open(rows: DataFrame) -> DataFrame:
        """The rows of keys that stand in several components, with their component."""
        rows = rows.drop("component").join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return rows.join(keys, "key", "left_semi")

    # most keys are done with by now, so the parities come to what is left only, and the last few keys ahead of each
    earlier = Window.partitionBy("rep", "n").orderBy("pos", "key").rowsBetween(-EARLIER, -1)
    listed = still_open(listed).join(reps.select("rep", "n", *ODD), ["rep", "n"]).withColumn("ahead", F.collect_list("key").over(earlier))
    listed = materialize(listed, "ngram")
    columns = ("pos", "n", "rep", "component", *ODD, "ahead")

    def sides(rows: DataFrame) -> tuple[DataFrame, ...]:
        return tuple(rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "xy")

    # the smaller set first; a pair that shares one of the last keys ahead has met there
    meet = ~F.arrays_overlap("x_ahead", "y_ahead") & (F.struct("x_n", "x_rep") < F.struct("y_n", "y_rep")) & (F.col("x_component") != F.col("y_component")) & _possible(percent, "x_", "y_") & _near(percent, "x_", "y_")
    def pairs_of(rows: DataFrame) -> DataFrame:
        x, y = sides(rows)
        return x.join(y, "key").where(meet).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))

    hot = materialize(listed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK_ROWS).select("key"), "ngram")
    done = [hot, listed]
    if hot.isEmpty():
        found_pairs = pairs_of(listed)
    else:  # further heads of each hot key, by hashes, against its rows of other components; the rows of other keys stay as they are
        rows_hot = materialize(listed.join(hot, "key", "left_semi"), "ngram")
        heads = F.array(*[F.min_by(F.struct(*columns), F.xxhash64(F.lit(i), "rep")) for i in range(HEADS)])
        head = rows_hot.groupBy("key").agg(heads.alias("h")).select("key", F.explode("h").alias("h")).select("key", *[F.col(f"h.{c}").alias(f"h_{c}") for c in columns])
        tried = rows_hot.join(head, "key").where((F.col("component") != F.col("h_component")) & _possible(percent, "", "h_") & _near(percent, "", "h_"))
        links = materialize(links.union(verified(tried.select(F.col("h_rep").alias("a"), F.col("rep").alias("b")).distinct(), reps, docs, k, percent)), "ngram")
        reached = materialize(connected_components(links), "ngram")
        left_hot = materialize(still_open(rows_hot), "ngram")
        # rows of a hot key in blocks, each of which meets all rows of the key, so that no task has all pairs of a key
        blocks = left_hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        x, y = (side.join(blocks, "key") for side in sides(left_hot))
        x, y = x.withColumn("block", F.pmod(F.xxhash64("x_rep"), F.col("blocks")).cast("int")).drop("blocks"), y.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        found_hot = x.join(y, ["key", "block"]).where(meet).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
        found_pairs = pairs_of(listed.join(hot, "key", "left_anti")).union(found_hot)
        done += [rows_hot, left_hot]
    rest = found_pairs.distinct()
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "ngram")
    links = materialize(links.union(verified(rest, reps, docs, k, percent, wide=True)), "ngram")
    reached = connected_components(links).withColumnRenamed("node", "rep")
    for table in (*done, rest, rows, inside, groups, first, links):  # the result reads found, reps and reached
        discard(table)

    named = reps.select("n", "s1", "s2", "rep").join(reached, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = found.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    alone = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))


def keep_first(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, null last, and then the smallest hash of its text.

    A document is a doc_id with a text: rows that share a doc_id and have unlike texts all stay, and so do rows
    without a doc_id that are no copy of one that stays. Of rows with the same doc_id and text, null ones too,
    one stays, the least by a hash of all columns.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    joined = join_documents(keyed.select(F.col("_row").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = joined.join(keyed.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(F.min_by("_row", least).alias("_row")).select("_row")
    w = Window.partitionBy("_row").orderBy(F.xxhash64(*docs.columns))
    return keyed.join(kept, "_row", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*docs.columns)
