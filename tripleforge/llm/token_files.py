"""Token ids written to wavelet files in the order of document ids, and read back."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .atoms import LONGEST, AtomTable, hashes, joined, spread, starts, text_bytes
from .common import bounded, materialize
from .wavelet import TokenFile, WaveletMatrix

#: Bytes of UTF-8 text of a file's documents; a longer document has a file of its own.
FILE_BYTES = 8 << 20
#: Atoms of which a Python worker keeps the ids at most; when there are more, the three fifths used last remain.
KEPT_ATOMS = 1_000_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 4 << 20
_STATE: dict = {}


class Encoder:
    """Encodes texts with a byte-level tokenizer file, each atom once.

    A text is cut where a byte-level pattern must begin a match, and each atom is encoded alone; atoms and
    their ids are kept up to a bound. A text that holds an added token, as <|endoftext|>, is encoded as it
    is, and so gets that token's own id.
    """

    def __init__(self, path: str, end_id: int, dtype: type, kept: int = KEPT_ATOMS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype, self.end = dtype, end_id
        self.table, self.used, self.clock = AtomTable(dtype), np.zeros(0, dtype=np.int64), 0
        self.kept, self.left = kept, max(1, kept * 3 // 5)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with the end id, one after the other, and how many each text has."""
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        data, bounds = text_bytes(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        at = starts(data, bounds)
        n = np.diff(np.append(at, len(data)))
        hash_ = hashes(data, at, n)
        rows = self.table.find(data, at, n, hash_)
        missed = np.flatnonzero(rows < 0)
        if len(missed):
            _, first = np.unique(hash_[missed], return_index=True)
            fresh = missed[first]
            rows = self._learn(data, at[fresh], n[fresh], rows)
            rows[missed] = self.table.find(data, at[missed], n[missed], hash_[missed])
            missed = missed[rows[missed] < 0]
        self.clock += 1
        self.used[rows[rows >= 0]] = self.clock
        others = self._ids([data[a : a + m].tobytes().decode() for a, m in zip(at[missed].tolist(), n[missed].tolist(), strict=True)])
        ids, each = joined(self.table, rows, [np.array(x, dtype=self.dtype).tobytes() for x in others])
        id_at = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(at, bounds)]
        plain = np.diff(id_at)
        marked = self._ids([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
        sizes = plain + 1
        sizes[whole] = [len(x) + 1 for x in marked]
        out = np.full(int(sizes.sum()), self.end, dtype=self.dtype)
        begin = np.cumsum(sizes) - sizes
        out[spread(begin, plain)] = ids
        for where, x in zip(begin[whole].tolist(), marked, strict=True):
            out[where : where + len(x)] = x
        if len(self.table) > self.kept:
            last = np.argpartition(self.used, -self.left)[-self.left :]
            last.sort()
            self.table, self.used = self.table.subset(last), self.used[last]
        return out, sizes

    def _learn(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Adds atoms to the table, and tells where rows of the table before now stand."""
        short = n <= LONGEST
        at, n = at[short], n[short]
        before = len(self.table)
        words = data[spread(at, n)]
        raw, ends = words.tobytes(), np.cumsum(n).tolist()
        ids: list[int] = []
        counts: list[int] = []
        for first in range(0, len(at), 20_000):
            for x in self._ids([raw[e - m : e].decode() for e, m in zip(ends[first : first + 20_000], n[first : first + 20_000].tolist(), strict=True)]):
                ids += x
                counts.append(len(x))
        order = self.table.add(words, n, np.array(ids, dtype=self.dtype), np.array(counts, dtype=np.int64))
        self.used = np.concatenate([self.used, np.full(len(at), self.clock)])[order]
        moved = np.empty(len(order) + 1, dtype=np.int64)
        moved[order] = np.arange(len(order))
        moved[-1] = -1
        return moved[np.where(rows < before, rows, -1)]


def _encoder(path: str, end_id: int, dtype: type) -> Encoder:
    key = (path, end_id, dtype)
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Encoder(*key)
    return _STATE[key]


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, width: int = 16, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Files of docs' ids as a written table: part and number (in the order of doc_id), tokens, and data, a whole token file.

    Documents are dealt to ranges of doc_id and sorted there; each range is cut into files of about
    file_bytes of text. A file holds its documents' ids and bounds and the wavelet matrix of their tokens with
    its rank directory, so nothing else is needed to read it.

    A null or empty text has the end id only; a null doc_id comes first; rows that repeat a doc_id stand next
    to each other, by text; a document longer than file_bytes has a file of its own; an empty table gives no
    file. Only doc_id and text are read, so other columns' names do not matter. tokenizer is the path of a
    byte-level tokenizers file that every executor has.
    """
    dtype = np.uint16 if width <= 16 else np.uint32

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id, dtype)
        keys: list = []
        data: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, number, part = 0, 0, 0

        def file() -> pa.RecordBatch:
            tokens = np.concatenate(data)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            raw = TokenFile(keys, bounds, WaveletMatrix.of(tokens, width)).write()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([raw], pa.binary())], names=["part", "number", "tokens", "data"])

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for some in bounded(batch, 1, min(file_bytes, BATCH_BYTES)):
                n_bytes = pc.sum(pc.binary_length(some.column(1))).as_py() or 0
                if keys and size + n_bytes > file_bytes:
                    yield file()
                    keys, data, counts, size, number = [], [], [], 0, number + 1
                ids, sizes = encoder.encode(some.column(1))
                keys += some.column(0).to_pylist()
                data.append(ids)
                counts.append(sizes)
                size += n_bytes
        if keys:
            yield file()

    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = docs.select("doc_id", "text").repartitionByRange(int(n), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return materialize(dealt.mapInArrow(written, "part int, number int, tokens bigint, data binary"), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, number) of every document, from the files alone: start counts the ids of all documents before it.

    An empty table of files gives no document; a document of no text has its end id; null ids come back as null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = TokenFile.read(data.as_py())
                at = file.bounds
                wide = memoryview(file.matrix.ids().astype("<u4")).cast("B")
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(file.doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64()), pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32())], names=["doc_id", "inside", "n_tokens", "ids_crc32", "part", "number"])

    # one row a file, then one a range: both small beside the ids
    parts = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts_ = files.select("part", "number", "tokens").join(parts, F.col("part") == F.col("p")).select("part", "number", (F.col("part_start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("file_start"))
    docs = files.select("part", "number", "data").mapInArrow(read, "doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, part int, number int")
    out = docs.join(starts_, ["part", "number"])
    return out.select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "number")


def find_token(files: DataFrame, value: int, first: int = 10) -> DataFrame:
    """(part, number, occurrences, positions): how often an id occurs in each file, and where its first occurrences are, by rank and select alone.

    An id that is in no file, or too large for the files, has 0 occurrences in each; an empty table gives an empty result.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                matrix = TokenFile.read(data.as_py()).matrix
                n = matrix.count(value)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([number.as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([[matrix.locate(value, k) for k in range(min(n, first))]], pa.list_(pa.int64()))], names=["part", "number", "occurrences", "positions"])

    return files.select("part", "number", "data").mapInArrow(found, "part int, number int, occurrences bigint, positions array<bigint>")


def document_ids(files: DataFrame, doc_id: int | None) -> DataFrame:
    """(doc_id, part, number, ids) of the documents with an id, read from the files by access alone; none where no file has it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = TokenFile.read(data.as_py())
                lists = [file.document(i) for i, d in enumerate(file.doc_ids) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(lists), pa.int64()), pa.array([part.as_py()] * len(lists), pa.int32()), pa.array([number.as_py()] * len(lists), pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "part", "number", "ids"])

    return files.select("part", "number", "data").mapInArrow(found, "doc_id bigint, part int, number int, ids array<bigint>")
