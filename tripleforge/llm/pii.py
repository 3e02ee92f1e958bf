"""Personal data: patterns, and a skip-chain conditional random field that labels what they miss."""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, give_back

#: The contract's kinds, which have base spans, and secrets, which are all of our own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
#: Labels of the field: none, then the kinds.
LABELS = ("none", *KINDS)
NONE = 0

# The contract's patterns, with possessive runs and starts that match the same and never go back over a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_EDGE = ".,;:!?\"'()[]{}<>"
# How keys of well-known services begin and go on, and names that a secret is given to. A value holds a digit and no = or :, so that a run of names is read once.
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])")
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|(?:api|access|private)[_-]?key)[\"']?[\x20]?[=:][\x20]?[\"']?((?=[a-z_./+-]*[0-9])[a-z0-9_./+-]{8,})")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not i & 1 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: from each @ back over its local part, no further than the last span, and on over its domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns, in order; kind counts KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            n = m.end() - m.start()
            if n >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of keys and of the values that are given to the names of secrets, in order, none overlapping."""
    found = {m.span() for m in _KEYS.finditer(text)} | ({m.span(1) for m in _NAMED.finditer(text)} if "=" in text or ":" in text else set())
    out: list[tuple[int, int, int]] = []
    for start, end in sorted(found):
        if not out or start >= out[-1][2]:
            out.append((start, SECRET, end))
    return out


@dataclass
class Tokens:
    """The tokens of a text that hold a digit or an @; no other can have a label."""

    spans: list[tuple[int, int]]
    words: list[str]
    labels: list[int]  # by the patterns: -1 where they say nothing


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> Tokens:
    out = Tokens([], [], [])
    at = 0
    for m in _TOKEN.finditer(text):
        word = m.group()
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in _EDGE and text[end - 1] != ")":
            end -= 1
        if end == start:
            continue
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        label = next((k + 1 for s, k, e in spans[at : at + 4] if s < end and e > start), -1)
        out.spans.append((start, end))
        out.words.append(word[: end - start])
        out.labels.append(label)
    return out


#: The features of a token's shape, as in `shape`, of itself and of its neighbours.
N_SHAPE = 22


def shape(word: str) -> list[int]:
    """Numbers of the features that hold for a token, each below N_SHAPE."""
    digits = sum("0" <= c <= "9" for c in word)
    out = [0 if digits == 0 else 1 if digits < 3 else 2 if digits < 5 else 3 if digits < 9 else 4 if digits < 12 else 5 if digits < 20 else 6]
    if "@" in word:
        out.append(7)
    if word[0] == "+":
        out.append(8)
    if word[0] == "(" and word[-1] == ")":
        out.append(9)
    dots = word.count(".")
    out.append(10 if dots == 0 else 11 if dots == 3 else 12)
    if "-" in word:
        out.append(13)
    letters = any(c.isalpha() for c in word)
    out.append(14 if letters else 15)
    if 12 <= digits <= 19 and not letters:
        out.append(16 if luhn(_digits(word)) else 17)
    if digits == len(word):
        out.append(18)
    if digits and digits + word.count("-") == len(word) and "-" in word:
        out.append(19)
    if digits and letters and len(word) >= 16:
        out.append(20)
    if "=" in word or ":" in word:
        out.append(21)
    return out


def features(tokens: Tokens, near: int = 3) -> list[list[int]]:
    """Each token's feature numbers: its own shape, and that of the tokens beside it where at most near characters stand between."""
    own = [shape(w) for w in tokens.words]
    out = []
    for i, mine in enumerate(own):
        some = list(mine)
        if i and tokens.spans[i][0] - tokens.spans[i - 1][1] <= near:
            some += [N_SHAPE + f for f in own[i - 1]]
        if i + 1 < len(own) and tokens.spans[i + 1][0] - tokens.spans[i][1] <= near:
            some += [2 * N_SHAPE + f for f in own[i + 1]]
        out.append([*some, 3 * N_SHAPE])
    return out


N_FEATURES = 3 * N_SHAPE + 1


def keys_of(word: str) -> list[str]:
    """What makes two tokens similar: the same letters and digits, in all of them or after the last = or :, or the same last seven digits."""
    plain = "".join(c for c in word.lower() if c.isalnum())
    out = ["=" + plain] if len(plain) >= 4 else []
    value = "".join(c for c in re.split("[=:]", word.lower())[-1] if c.isalnum())
    if len(value) >= 8 and value != plain:
        out.append("=" + value)
    digits = _digits(word)
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    return out


class SkipChainField:
    """Log-linear weights of labels given features, of neighbouring labels, and of equal labels of similar tokens."""

    def __init__(self, skip: float = 2.0) -> None:
        self.unary = np.zeros((N_FEATURES, len(LABELS)))
        self.chain = np.zeros((len(LABELS), len(LABELS)))
        self.skip = skip

    def fit(self, texts: list[str], epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> SkipChainField:
        """Weights from texts labelled by the patterns: multinomial regression of labels on features, log odds of neighbours."""
        rows: list[list[int]] = []
        labels: list[int] = []
        pairs = np.full((len(LABELS), len(LABELS)), 1.0)
        for text in texts:
            tokens = tokens_of(text, sorted(base_spans(text) + secret_spans(text)))
            mine = [max(0, x) for x in tokens.labels]
            rows += features(tokens)
            labels += mine
            for a, b, (_, end), (start, _) in zip(mine, mine[1:], tokens.spans, tokens.spans[1:], strict=False):
                if start - end <= 3:
                    pairs[a, b] += 1
        if rows:
            x = np.zeros((len(rows), N_FEATURES))
            for i, some in enumerate(rows):
                x[i, some] = 1
            y = np.eye(len(LABELS))[labels]
            speed = np.zeros_like(self.unary)
            for _ in range(epochs):
                z = x @ self.unary
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                speed = 0.9 * speed - rate * (x.T @ (p - y) / len(x) + l2 * self.unary)
                self.unary += speed
            odds = np.log(pairs / pairs.sum()) - np.log(pairs.sum(axis=1, keepdims=True) / pairs.sum()) - np.log(pairs.sum(axis=0, keepdims=True) / pairs.sum())
            self.chain = np.clip(odds, -2, 2)
        return self

    def marginals(self, nodes: list[list[int]], fixed: np.ndarray, chain: np.ndarray, skip: np.ndarray, near: np.ndarray | None = None, group: np.ndarray | None = None, tolerance: float = 1e-4, damping: float = 0.3) -> np.ndarray:
        """Each node's label probabilities by loopy message passing, all messages of a group at once until none changes by more than tolerance.

        fixed: a known label or -1; chain, skip: pairs of node numbers; near: further log weights of nodes and labels;
        group: numbers of the texts that nodes belong to, each of which ends for itself. Swings are damped more and
        more; a group that still swings after that is reported in a warning.
        """
        n, k = len(nodes), len(LABELS)
        local = np.array([self.unary[f].sum(axis=0) for f in nodes]).reshape(n, k)
        if near is not None:
            local = local + near
        known = np.flatnonzero(fixed >= 0)
        local[known] = -50.0
        local[known, fixed[known]] = 50.0
        same = np.eye(k) * self.skip
        group = np.zeros(n, dtype=np.int64) if group is None else group
        src = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]]).astype(np.int64)
        dst = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]]).astype(np.int64)
        half = len(chain) + len(skip)
        kind = np.repeat([0, 1, 2, 1], [len(chain), len(skip), len(chain), len(skip)])
        potentials = np.stack([self.chain, same, self.chain.T])
        messages = np.zeros((2 * half, k))
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        belief = local.copy()
        live, step, rounds = np.arange(2 * half), 1 - damping, 0
        while len(live):
            new = potentials[kind[live]] + (belief[src[live]] - messages[back[live]])[:, :, None]
            top = new.max(axis=1)
            new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages[live]).max(axis=1)
            messages[live] += step * (new - messages[live])
            mine = np.unique(dst[live])
            belief[mine] = local[mine]
            np.add.at(belief, dst[live], messages[live])
            moving = np.zeros(group.max() + 1, dtype=bool)
            moving[group[dst[live[change > tolerance]]]] = True
            live = live[moving[group[dst[live]]]]
            rounds += 1
            if rounds % 200 == 0:
                step /= 2
                if step < 0.01 and len(live):
                    warnings.warn(f"messages of {moving.sum()} texts still change by up to {change.max():.2g}", RuntimeWarning, stacklevel=2)
                    break
        belief = belief - belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)

    def label(self, texts: list[str], least: float = 0.5) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """For each text its base spans and all spans: those of secrets, and neighbouring tokens of one label, where the patterns say nothing, as one more span."""
        base = [base_spans(t) for t in texts]
        known = [sorted(b + secret_spans(t)) for t, b in zip(texts, base, strict=True)]
        all_tokens = [tokens_of(t, k) for t, k in zip(texts, known, strict=True)]
        nodes: list[list[int]] = []
        fixed: list[int] = []
        chain: list[tuple[int, int]] = []
        skip: list[tuple[int, int]] = []
        near: list[list[float]] = []
        group: list[int] = []
        firsts = []
        for number, tokens in enumerate(all_tokens):
            first = len(nodes)
            firsts.append(first)
            if not tokens.words or min(tokens.labels) >= 0:
                continue
            nodes += features(tokens)
            fixed += tokens.labels
            alike: dict[str, list[int]] = {}
            for i, word in enumerate(tokens.words):
                if i and tokens.spans[i][0] - tokens.spans[i - 1][1] <= 3:
                    chain.append((first + i - 1, first + i))
                for key in keys_of(word):
                    alike.setdefault(key, []).append(i)
            evidence = np.zeros((len(tokens.words), len(LABELS)))
            hubs = 0
            for members in alike.values():
                found = [tokens.labels[i] for i in members if tokens.labels[i] >= 0]
                open_ = [i for i in members if tokens.labels[i] < 0]
                if found and open_:  # a link to those that the patterns know, by their labels' shares, however many there are
                    evidence[open_] += self.skip * np.bincount(found, minlength=len(LABELS)) / len(found)
                if len(open_) > 1:  # a node more that all others are linked to: linear, and two links between any two
                    hub = first + len(tokens.words) + hubs
                    hubs += 1
                    skip += [(first + i, hub) for i in open_]
            near += evidence.tolist() + [[0.0] * len(LABELS)] * hubs
            nodes += [[]] * hubs
            fixed += [-1] * hubs
            group += [number] * (len(tokens.words) + hubs)
        out = []
        p = self.marginals(nodes, np.array(fixed), np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2), np.array(near), np.array(group)) if nodes else np.zeros((0, len(LABELS)))
        best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
        for tokens, spans, sure, first in zip(all_tokens, base, known, firsts, strict=True):
            more: list[list[int]] = []
            if tokens.words and min(tokens.labels) < 0:
                for i, (start, end) in enumerate(tokens.spans):
                    kind = int(best[first + i])
                    if tokens.labels[i] >= 0 or kind == NONE or p[first + i, kind] < least:
                        continue
                    beside = more and more[-1][3] == i - 1 and more[-1][1] == kind - 1 and start - more[-1][2] <= 3
                    if beside and kind - 1 in (2, 3):
                        more[-1][2:] = [end, i]
                    else:
                        more.append([start, kind - 1, end, i])
            out.append((spans, sorted(sure + [tuple(m[:3]) for m in more])))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Bytes of texts that are labelled at once; a longer text is alone.
BATCH_BYTES = 1 << 20
#: Passages that train a field at most, the characters of each, and the groups in which they are drawn.
TRAIN_ROWS, TRAIN_CHARS, SALTS = 1_024, 1_024, 64


def fit_field(docs: DataFrame, rows: int = TRAIN_ROWS) -> SkipChainField:
    """A field trained on at most rows passages of documents with a digit or an @, the first by a hash of their ids in each of SALTS groups."""
    start = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - TRAIN_CHARS // 4)
    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", F.lit(17)).alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(SALTS)).alias("salt"), F.substring("text", start, F.lit(TRAIN_CHARS)).alias("text"))
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("salt").orderBy("h", "text"))).where(F.col("n") <= max(1, rows // SALTS))
    field = SkipChainField().fit([r.text for r in sorted(first.select("h", "text").collect())])
    give_back()
    return field


def find_pii(docs: DataFrame, field: SkipChainField, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs' columns with n_email, n_ip, n_card, n_phone (base spans of each kind), n_secret, n_spans (all spans of any kind), base_sha256, spans, starts, kinds and ends.

    The base spans are those of the contract's patterns over the whole text. Secrets are spans of our own: keys
    of known forms and values given to names such as password. The field adds spans of tokens
    that the patterns leave alone, from their shape, their neighbours, and similar tokens anywhere in the
    same document. Offsets count code points, ends are exclusive. A null text is as an empty one: no spans,
    and the hash of an empty string. Repeated rows give repeated results; an empty table gives an empty
    result; columns of docs with a result's name are replaced. A document's work is linear in its length.
    """
    made = ("n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_spans", "base_sha256", "spans", "starts", "kinds", "ends")
    docs = docs.drop(*made)
    at = docs.columns.index("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in bounded(whole, at, batch_bytes)):
            results = field.label([t or "" for t in batch.column(at).to_pylist()])
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in results] for kind in range(len(BASE_KINDS))]
            counts += [[sum(k == SECRET for _, k, _ in spans) for _, spans in results], [len(spans) for _, spans in results]]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in results], pa.string()),
                    pa.array([joined(spans) for _, spans in results], pa.string()),
                    pa.array([[s for s, _, _ in spans] for _, spans in results], pa.list_(pa.int32())),
                    pa.array([[KINDS[k] for _, k, _ in spans] for _, spans in results], pa.list_(pa.string())),
                    pa.array([[e for _, _, e in spans] for _, spans in results], pa.list_(pa.int32())),
                ],
                names=[*batch.schema.names, *made],
            )
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(found, f"{fields}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_secret bigint, n_spans bigint, base_sha256 string, spans string, starts array<int>, kinds array<string>, ends array<int>")


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each span replaced by its kind in angle brackets; spans that overlap are replaced by the first one's."""
    if text is None or not spans:
        return text
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind]}>"]
        last = max(last, end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """docs with the personal data of text replaced by kind, and n_chars, where docs has it, set to the new length; every document stays.

    A null text stays null with a null n_chars, an empty one empty; a long text is masked whole; rows that
    repeat are masked alike; all other columns stay as they are; an empty table gives an empty result.
    """
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in bounded(whole, at, BATCH_BYTES)):
            texts = batch.column(at).to_pylist()
            new = [mask(t, spans) for t, (_, spans) in zip(texts, field.label([t or "" for t in texts]), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        give_back()

    docs = docs if size is None else docs.withColumn("n_chars", F.col("n_chars").cast("bigint"))
    return docs.mapInArrow(masked, docs.schema)
