"""Byte-level BPE by ranks, encoded with Spark's higher-order functions and decoded by putting pieces together."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .atoms import AtomTable, hashes, joined, starts, text_bytes
from .common import bounded, give_back, materialized, tidy

#: Matches of the pattern whose ids are folded once for the whole corpus and looked up at most; the others are folded where they stand.
KEPT_WORDS = 3 << 18
#: Bytes of a kept match at most; together with KEPT_WORDS this bounds what is broadcast.
KEPT_BYTES = 48
#: Bytes of text that a worker takes at once, and bytes of a match from which on a heap finds the next merge.
BATCH_BYTES, LONG = 1 << 18, 1_024
#: Bytes of a literal that go to the driver's JVM at once.
PIECE_BYTES = 1 << 18
#: Characters that are cut into words at once where they are counted.
COUNTED_CHARS = 1 << 20
#: The rank of a pair that does not merge; ranks are below.
NONE = 1 << 17
#: Beside the first and last token, and in place of a word whose ids are not known yet.
EDGE = 65_535
HOLE = EDGE.to_bytes(2, "little")
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public split pattern, with white space spelt out as Unicode has it.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class RankTable:
    """All pairs of tokens that merge, as a perfect hash in two literal arrays: one probe finds a pair's rank.

    A slot holds pair << 17 | rank; a pair's slot is its second hash, changed by the displacement that its
    first hash names.
    """

    BITS, GROUP_BITS = 20, 17
    EMPTY = 1 << 62
    FIRST, SECOND = 1_540_483_477, 2_057_263_201  # odd, below 2^31: products with 32 bits stay below 2^63

    def __init__(self, tokens: list[bytes]) -> None:
        rank = {t: i for i, t in enumerate(tokens)}
        pairs = {}
        for merged, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = merged
        keys = np.array(list(pairs), dtype=np.int64)
        first, second = self._hash(keys, self.FIRST, self.GROUP_BITS), self._hash(keys, self.SECOND, self.BITS)
        order = np.argsort(first, kind="stable")
        counts = np.bincount(first, minlength=1 << self.GROUP_BITS)
        starts = np.cumsum(counts) - counts
        self.slots = np.full(1 << self.BITS, self.EMPTY, dtype=np.int64)
        self.displace = np.zeros(1 << self.GROUP_BITS, dtype=np.int64)
        for group in np.argsort(-counts, kind="stable"):
            if not counts[group]:
                break
            mine = order[starts[group] : starts[group] + counts[group]]
            places = second[mine]
            if len(np.unique(places)) < len(places):
                raise ValueError("two pairs of a group share their second hash")
            d = 0
            while (self.slots[places ^ d] != self.EMPTY).any():
                d += 1
            self.displace[group] = d
            self.slots[places ^ d] = [int(keys[i]) << 17 | pairs[int(keys[i])] for i in mine]

    @staticmethod
    def _hash(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return (keys * factor >> 24) & ((1 << bits) - 1)


def let(value: Column, body, kind: str = "array<bigint>") -> Column:
    """body of value, an array of the given type, with value worked out once.

    A fold of one element: a transform of one would ask its whole body for its type each time.
    """
    return F.aggregate(F.array(value), F.array().cast(kind), lambda _, x: body(x))


def constants(spark: SparkSession, **values: tuple[object, str]) -> dict[str, Column]:
    """Each value as a literal of its nested type, in Spark's compact binary form.

    The literals that Python can make hold an object for each element, which every task would take seconds to
    read; one made of a row as Spark keeps it is read as one block of bytes.
    """
    rows = spark.createDataFrame([tuple(json.dumps(v, separators=(",", ":")) for v, _ in values.values())], ", ".join(f"{k} string" for k in values))
    made = rows.select(*[F.from_json(k, kind).alias(k) for k, (_, kind) in values.items()])._jdf
    row, jvm = made.queryExecution().executedPlan().executeCollect()[0], spark._jvm
    out = {}
    for i, name in enumerate(values):
        literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(i), made.schema().apply(i).dataType())
        out[name] = Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))
    return out


def longs(spark: SparkSession, values: np.ndarray) -> Column:
    """values as a literal array<bigint> in Spark's compact binary form.

    Its block (size, null bits, values) goes to the driver's JVM in pieces, straight to its place: no text, row or
    second copy of it is made there, and no job runs.
    """
    jvm = spark._jvm
    block = np.concatenate([[len(values)], np.zeros(-(-len(values) // 64)), values], dtype=np.int64, casting="unsafe")
    place, data = spark.sparkContext._gateway.new_array(jvm.long, len(block)), block.tobytes()
    platform = jvm.org.apache.spark.unsafe.Platform
    first, to = platform.BYTE_ARRAY_OFFSET, platform.LONG_ARRAY_OFFSET
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES]
        platform.copyMemory(piece, first, place, to + at, len(piece))
    array = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData()
    array.pointTo(place, to, len(data))
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>"))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


class ByteBpe:
    """A rank file's encoding and decoding as column expressions.

    The expressions take the literals as t, a struct column that `fold_all` puts round them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        tokens = read_ranks(path)
        if len(tokens) >= EDGE:
            raise ValueError("ranks of at most 65,534 tokens fit")
        self.tokens = tokens
        table = RankTable(tokens)
        rank = {t: i for i, t in enumerate(tokens)}
        self.table = {"slots": longs(spark, table.slots), "displace": longs(spark, table.displace), "bytes": longs(spark, np.array([rank[bytes([i])] for i in range(256)]))}

    def ranks_of(self, t: Column, pairs: Column) -> Column:
        """The rank of each pair's merge, or NONE."""

        def rank(k: Column) -> Column:
            group = F.shiftright(k * RankTable.FIRST, 24).bitwiseAND((1 << RankTable.GROUP_BITS) - 1)
            place = F.shiftright(k * RankTable.SECOND, 24).bitwiseAND((1 << RankTable.BITS) - 1)
            slot = F.get(t["slots"], place.bitwiseXOR(F.get(t["displace"], group.cast("int"))).cast("int"))
            return F.least(slot.bitwiseXOR(F.shiftleft(k, 17)), F.lit(NONE).cast("bigint"))  # of another pair's slot more than NONE is left

        return F.transform(pairs, rank)

    def fold(self, t: Column, word: Column) -> Column:
        """The ids of one match: its bytes, and then as often as a pair has a rank the leftmost pair of the lowest rank merged.

        A token stands as rank << 40 | place << 17 | id: the rank of its merge with the next one, where it began,
        and its id; so the least of all is the next to merge. A match of n bytes, below 2^23, takes at most n
        steps over n tokens; longer ones than LONG are left to merge_long.
        """
        place, own = ((1 << 23) - 1) << 17, (1 << 17) - 1
        edge = F.lit(EDGE).cast("bigint")
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        start = F.concat(F.array(edge), F.transform(F.split(latin, ""), lambda c: F.get(t["bytes"], F.ascii(c))), F.array(edge))

        def begun(ids: Column) -> Column:
            pairs = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: F.shiftleft(a, 16).bitwiseOR(F.coalesce(b, edge)))
            ranked = F.zip_with(ids, self.ranks_of(t, pairs), lambda i, r: F.shiftleft(r, 40).bitwiseOR(i))
            return F.transform(ranked, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("bigint"), 17)))

        def merged(state: Column, low: Column) -> Column:
            def at(p: Column) -> Column:
                before, new = F.get(state, p - 2), F.shiftright(low, 40)
                pairs = F.array(F.shiftleft(before.bitwiseAND(own), 16).bitwiseOR(new), F.shiftleft(new, 16).bitwiseOR(F.get(state, p + 1).bitwiseAND(own)))
                beside = F.zip_with(self.ranks_of(t, pairs), F.array(before.bitwiseAND(place | own), low.bitwiseAND(place).bitwiseOR(new)), lambda r, x: F.shiftleft(r, 40).bitwiseOR(x))
                return F.flatten(F.array(F.slice(state, F.lit(1), p - 2), beside, F.slice(state, p + 2, F.size(state))))

            # counted, for array_position leaves its loop by an exception, which takes longer than all else here
            here = low.bitwiseAND(place)
            return let(F.size(F.filter(state, lambda x: x.bitwiseAND(place) < here)) + 1, at)

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(state), lambda low: F.when(low >= NONE << 40, state).otherwise(merged(state, low)))

        def folded(ids: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.size(ids) - 2), begun(ids), step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(own)))

        return let(start, folded)

    def fold_all(self, matches: Column) -> Column:
        """The ids of each of an array of matches."""
        literals = F.struct(*[v.alias(k) for k, v in self.table.items()])
        return let(literals, lambda t: F.transform(matches, lambda x: self.fold(t, x)), "array<array<bigint>>")


def merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a match of any length, as fold gives them: a heap finds the leftmost pair of the lowest rank, so n bytes take n log n steps."""
    n = len(data)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] < 0 or j >= n or end[j] != stop:  # one of the pair has been merged with another since
            continue
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(data[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


def match_counts(docs: DataFrame) -> DataFrame:
    """(match, n): about how often each match of the pattern stands in all whole texts; those of over KEPT_BYTES bytes are left out.

    Texts are cut at spaces and counted as words, and only distinct words are cut into matches. What a
    count says of a match decides whether its ids are worked out ahead, and nothing else.
    """
    parts = docs.select("text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(COUNTED_CHARS))).alias("at"))
    words = parts.select(F.explode(F.split(F.substring("text", F.col("at") + 1, F.lit(COUNTED_CHARS)), " ")).alias("word")).where(F.octet_length("word").between(1, KEPT_BYTES)).groupBy("word").agg(F.count("*").alias("n"))
    matches = words.select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), "word"), F.lit(PATTERN), F.lit(0))).alias("match"), "n")
    return matches.where(F.octet_length("match") <= KEPT_BYTES).groupBy("match").agg(F.sum("n").alias("n"))


def table_of(matches: list[pa.Table]) -> AtomTable:
    """The table of matches with their ids; takes the one Arrow table out of the list, so that it is freed as soon as it is read."""
    out = AtomTable(np.uint16)
    words, ids = (matches[0].column(c).chunks for c in range(2))
    matches.clear()
    data, lengths = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.uint32)]
    while words:
        some, bounds = text_bytes(words.pop(0).cast(pa.binary()))
        data.append(some)
        lengths.append(np.diff(bounds).astype(np.uint32))
    coded, counts = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.uint32)]
    while ids:
        some = ids.pop(0)
        coded.append(some.flatten().to_numpy().astype(np.uint16))
        counts.append(np.diff(some.offsets.to_numpy()).astype(np.uint32))
    out.add(np.concatenate(data), np.concatenate(lengths), np.concatenate(coded), np.concatenate(counts))
    return out


def kept_matches(docs: DataFrame, bpe: ByteBpe, words: int = KEPT_WORDS) -> AtomTable:
    """The most frequent matches of all documents with their ids, at most words of them.

    All matches of a count are kept or none, so that the choice needs no order of all matches: counts are put
    into classes, of which there are a thousand at most, and the highest classes that fit are taken.
    """
    grade = F.floor(F.log2("n") * 16)
    with materialized(match_counts(docs).select("match", grade.alias("grade")), "bpe") as counts:
        sizes = {r.grade: r["count"] for r in counts.groupBy("grade").count().collect()}
        total, least = 0, None
        for g in sorted(sizes, reverse=True):
            if (total := total + sizes[g]) > words:
                break
            least = g
        top = counts.where(F.lit(False) if least is None else F.col("grade") >= least).select("match")
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = F.get(bpe.fold_all(F.array("match")), F.lit(0))
        return table_of([top.repartition(tasks, "match").select("match", ids.cast("array<int>").alias("ids")).toArrow()])


class Lookup:
    """Looks up the ids of whole texts; a hole stands for each match that is not kept, which is listed."""

    def __init__(self, kept: AtomTable, tokens: list[bytes]) -> None:
        self.kept = kept
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.matches = regex.compile(PATTERN).findall

    def texts(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its ids as 16-bit integers, and its matches that are not kept."""
        data, bounds = text_bytes(column)
        at = starts(data, bounds)
        n = np.diff(np.append(at, len(data)))
        rows = self.kept.find(data, at, n, hashes(data, at, n))
        rare: list[str] = []
        others, holes = [], []
        missed = np.flatnonzero(rows < 0)
        for a, m in zip(at[missed].tolist(), n[missed].tolist(), strict=True):
            others.append(self.cut(data[a : a + m].tobytes().decode(), rare))
            holes.append(len(rare))
        ids, each = joined(self.kept, rows, others)
        first = np.searchsorted(at, bounds)  # of each text its first atom
        id_at = np.concatenate([[0], np.cumsum(each)])[first]
        rare_at = np.concatenate([[0], holes])[np.searchsorted(missed, first)]
        coded = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((2 * id_at).astype(np.int32)), pa.py_buffer(ids)])
        return coded, pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(rare, pa.string()))

    def cut(self, text: str, rare: list[str]) -> bytes:
        """The ids of an atom that is not kept as it is."""
        found = self.matches(text)
        if len(found) == 1:
            return self.hole(text, rare)
        words = [m.encode() for m in found]
        data, n = np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words])
        at = np.cumsum(n) - n
        rows = self.kept.find(data, at, n, hashes(data, at, n))
        return joined(self.kept, rows, [self.hole(found[i], rare) for i in np.flatnonzero(rows < 0)])[0].tobytes()

    def hole(self, match: str, rare: list[str]) -> bytes:
        if len(match) > LONG // 4 and len(data := match.encode()) > LONG:
            return np.array(merge_long(data, self.ranks), dtype="<u2").tobytes()
        rare.append(match)
        return HOLE


def _filled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch whose last two columns are _ids and _rare, and where each row's begin and end."""
    coded, rare = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    rows = coded.to_pylist()
    flat = np.frombuffer(b"".join(rows), dtype="<u2")
    words = rare.flatten()
    holes = flat == EDGE
    n = np.ones(len(flat), dtype=np.int64)
    n[holes] = np.diff(words.offsets.to_numpy())
    ids = np.repeat(flat, n).astype("<u4")
    ids[np.repeat(holes, n)] = words.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids, ends[np.concatenate([[0], np.cumsum([len(r) // 2 for r in rows])]).astype(np.int64)]


def _encoded(docs: DataFrame, columns: Sequence[str], path: str, words: int) -> DataFrame:
    """columns of docs with ids and id_bytes of its text; the text goes to the workers once, and with columns only if it is one of them."""
    spark = docs.sparkSession
    bpe = ByteBpe(spark, path)
    shared = spark.sparkContext.broadcast((kept_matches(docs, bpe, words), bpe.tokens))
    give_back()
    tidy(spark)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*shared.value)  # quick to make, and gone with the task: idle workers hold nothing
        for batch in batches:
            for some in bounded(batch, 0, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *lookup.texts(some.column(0))], names=[*some.schema.names[1:], "_ids", "_rare"])
        del lookup
        give_back()

    fields = [T.StructField("_ids", T.BinaryType()), T.StructField("_rare", T.ArrayType(T.StringType()))]
    kept = [docs.schema[c] for c in columns]
    found = docs.select(F.col("text").alias("_text"), *columns).mapInArrow(looked_up, T.StructType([*kept, *fields]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in bounded(batch, batch.num_columns - 2, BATCH_BYTES):
                ids, at = _filled(some)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4")))
                raw = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], lists, raw], names=[*some.schema.names[:-2], "ids", "id_bytes"])
        give_back()

    folded = found.withColumn("_rare", bpe.fold_all(F.col("_rare")))
    return folded.mapInArrow(made, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("id_bytes", T.BinaryType())]))


def encode_documents(docs: DataFrame, path: str, words: int = KEPT_WORDS) -> DataFrame:
    """docs with ids, an array of the whole text's token ids, and id_bytes, the same as little-endian unsigned 32-bit integers.

    A text is cut where the pattern must begin a match, and the atoms at their other matches. The ids of the corpus's most frequent distinct matches are folded once and
    looked up; other matches, as good as all of which stand once or twice in a task, are folded for each
    document. Nothing is shuffled but the counts of words.

    A null or empty text has no ids; an empty table gives an empty result; rows that repeat, and rows with the
    same doc_id, are encoded each for itself; columns ids, id_bytes, _text, _ids and _rare of docs are
    replaced, all others stay. Texts and matches may have any length: a match of n bytes takes n steps over at
    most n pieces up to LONG bytes, and n log n beyond.
    """
    docs = docs.drop("ids", "id_bytes", "_text", "_ids", "_rare")
    return _encoded(docs, docs.columns, path, words)


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """coded with decoded, the bytes that its ids stand for; null ids give null, ids that are no token are left out."""
    pieces = constants(coded.sparkSession, pieces=([t.decode("latin-1") for t in read_ranks(path)], "array<string>"))["pieces"]
    each = F.transform("ids", lambda i: F.get(pieces, i))
    return coded.withColumn("decoded", F.encode(F.array_join(each, ""), "ISO-8859-1"))  # a character of Latin-1 stands for each byte


def round_trip(docs: DataFrame, path: str, words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, id_bytes, decoded) of every row of docs: its ids, and the bytes that come back from them.

    Nulls, empty and long texts, repeats and other columns are taken as encode_documents takes them: a null or
    empty text has 0 tokens and empty bytes.
    """
    coded = decode_ids(_encoded(docs, ["doc_id"], path, words), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "id_bytes", "decoded")
