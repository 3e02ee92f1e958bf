"""Language identification by a byte-level convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, give_back

#: Bytes of texts that are taken at once; a longer text is alone.
BATCH_BYTES = 1 << 20
#: Bytes of a window; of a text's windows only the last may be shorter.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Training rows of one language at most, and characters of each.
ROWS_PER_LANGUAGE = 768
SALTS = 32
TRAIN_CHARS = 512
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character of text is a letter, in any script."""
    if not text:
        return False
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """data cut into rows of size bytes, the last filled with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, size)


class ByteCnn:
    """Embedded bytes, filters of several widths, the maximum over positions, softmax."""

    def __init__(self, labels: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), "c": np.zeros(len(labels), dtype=np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.tables: list | None = None

    def train(self, rows: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on cross entropy, in an order fixed by seed."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                pick = order[at : at + batch]
                grads = self._grads(rows[pick], y[pick])
                t += 1
                step = rate * (0.15 if epoch >= epochs - 4 else 1.0)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.tables = None

    def _grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, size = x.shape
        emb = self.p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            conv = sum(emb[:, k : size - w + 1 + k] @ self.p[f"f{w}"][k] for k in range(w)) + self.p[f"b{w}"]
            at = conv.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        z = hidden @ self.p["o"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        grads = {"o": hidden.T @ prob, "c": prob.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        back = (prob @ self.p["o"].T) * (raw > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"b{w}"] = g.sum(axis=0)
            f = np.empty_like(self.p[f"f{w}"])
            for k in range(w):
                seen = x[rows, where[i] + k]  # (n, filters): the byte under each filter's maximum
                f[k] = np.einsum("nfe,nf->ef", self.p["e"][seen], g)
                np.add.at(grads["e"], seen, g[..., None] * self.p[f"f{w}"][k].T[None])
            grads[f"f{w}"] = f
        return grads

    def _tables(self) -> list:
        """For each width, of each pair of bytes (and a last single byte) what it adds to each filter."""
        if self.tables is None:
            one = {(w, k): self.p["e"] @ self.p[f"f{w}"][k] for w in WIDTHS for k in range(w)}
            self.tables = []
            for w in WIDTHS:
                parts = []
                for k in range(0, w - 1, 2):
                    parts.append((k, np.ascontiguousarray((one[w, k + 1][:, None, :] + one[w, k][None, :, :]).reshape(65536, FILTERS))))  # index: low byte first
                if w % 2:
                    parts.append((w - 1, one[w, w - 1]))
                self.tables.append((w, parts))
        return self.tables

    def predict(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Probabilities of each row of bytes."""
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), block):
            rows = x[at : at + block]
            n, size = rows.shape
            pair = rows[:, :-1].astype(np.uint16) | rows[:, 1:].astype(np.uint16) << 8
            pooled = []
            for w, parts in self._tables():
                m = size - w + 1
                conv = None
                for k, table in parts:
                    index = pair[:, k : k + m] if len(table) > 256 else rows[:, k : k + m]
                    got = np.take(table, index.ravel(), axis=0)
                    conv = got if conv is None else np.add(conv, got, out=conv)
                pooled.append(conv.reshape(n, m, FILTERS).max(axis=1) + self.p[f"b{w}"])
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["o"] + self.p["c"]
            z -= z.max(axis=1, keepdims=True)
            prob = np.exp(z)
            out[at : at + block] = prob / prob.sum(axis=1, keepdims=True)
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(label number, score) of each text: its windows' probabilities, weighted by their bytes."""
        cut = [windows(t) for t in texts]
        counts = np.array([len(c) for c in cut])
        prob = self.predict(np.concatenate(cut))
        weight = np.full(len(prob), WINDOW, dtype=np.float64)
        ends = np.cumsum(counts)
        weight[ends - 1] = [max(1, len(t) - (c - 1) * WINDOW) for t, c in zip(texts, counts.tolist(), strict=True)]
        sums = np.add.reduceat(prob * weight[:, None], ends - counts, axis=0)
        sums /= sums.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        return best, sums[np.arange(len(best)), best]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2; a null id is kept from it too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> ByteCnn | None:
    """A network trained on at most rows_per_language passages of each language, or None without labelled rows.

    Rows with a text and a lang that are not held out are drawn in the order of a hash of their id, in salted
    groups, so that no task ranks a whole language; of each a passage of TRAIN_CHARS characters is read,
    from a place that the hash gives.
    """
    h = F.xxhash64("doc_id", F.lit(11))
    start = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1) + 1
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", h.alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(SALTS)).alias("salt"), F.substring("text", start.cast("int"), F.lit(TRAIN_CHARS)).alias("passage"))
    w = Window.partitionBy("lang", "salt").orderBy("h", "passage")
    sample = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, rows_per_language // SALTS)).select("lang", "passage", "h")
    got = sorted((r for r in sample.collect() if has_letter(r.passage)), key=lambda r: (r.h, r.lang, r.passage))
    if not got:
        return None
    labels = sorted({r.lang for r in got})
    model = ByteCnn(labels)
    x = [windows(r.passage.encode())[:2] for r in got]
    y = np.concatenate([[labels.index(r.lang)] * len(c) for r, c in zip(got, x, strict=True)])
    model.train(np.concatenate(x), y)
    give_back()
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """docs' columns with lang_pred and score, from the whole text and nothing else.

    A text that is null or has no letter is `und`, with score 0; so is any without a model. All windows of a
    text count, by their bytes. An empty table gives an empty result; columns of docs with a result's name
    are replaced. The model, of fixed size, goes to the tasks with the function.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in bounded(whole, at, BATCH_BYTES)):
            texts = batch.column(at).to_pylist()
            labels, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for first in range(0, len(some), 64):
                part = some[first : first + 64]
                best, score = model.texts([texts[i].encode() for i in part])
                for i, b, s in zip(part, best.tolist(), score.tolist(), strict=True):
                    labels[i], scores[i] = model.labels[b], float(min(1.0, max(0.0, s)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(identified, f"{fields}, lang_pred string, score double")
