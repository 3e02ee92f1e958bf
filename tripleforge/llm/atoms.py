"""Texts cut where a byte-level pattern begins a match, and looked up in flat tables, a whole batch at a time.

An atom begins where a match of the pattern must begin, and so is one match or, beside characters that are
not told apart here, a few. Everything is done on the bytes of a batch with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Kinds of bytes: OTHER is what is not told apart, parts of characters outside ASCII mostly.
OTHER, LETTER, DIGIT, MARK, QUOTE, SPACE, BREAK = range(7)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are worked on at once; longer atoms than LONGEST are in no table.
WINDOW, LONGEST = 1 << 18, 256
_POWERS = np.cumprod(np.full(LONGEST + 1, _FACTOR, dtype=np.uint64))


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, dtype=np.uint8)
    kind[128:] = OTHER
    for i in range(128):
        c = chr(i)
        if c.isascii() and c.isalpha():
            kind[i] = LETTER
        elif c in "0123456789":
            kind[i] = DIGIT
        elif c in "\t\n\x0b\f\r":
            kind[i] = BREAK
    kind[32], kind[39] = SPACE, QUOTE
    return kind


_KIND = _kinds()
_AFTER, _HERE = np.zeros(64, dtype=bool), np.zeros(64, dtype=bool)
for _a in (LETTER, DIGIT, MARK, QUOTE):
    for _b in (SPACE, BREAK):
        _AFTER[_a * 8 + _b] = True  # white space after anything else
        _HERE[_b * 8 + _a] = True  # the last white space before anything else
    _AFTER[BREAK * 8 + _a] = True  # only a space belongs to what follows
    for _b in (LETTER, DIGIT, MARK, QUOTE):
        same = _a == _b or {_a, _b} == {MARK, QUOTE}
        _AFTER[_a * 8 + _b] |= not same and (_a, _b) != (QUOTE, LETTER)  # a quote may begin 's and the like


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What a byte of a word counts: white space nothing, a capital letter as a small one.
_LOWER = np.array([0 if _BLANK[i] else i + 1 + 32 * (65 <= i <= 90) for i in range(256)], dtype=np.uint64)


def starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places where atoms begin; bounds are the places where texts begin, and the end."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    pairs = kind[:-1] * 8 + kind[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    pairs[inner - 1] = 0
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = _AFTER[pairs]
    begins[:-1] |= _HERE[pairs]
    begins[bounds[bounds < len(data)]] = True
    return np.flatnonzero(begins)


def hashes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each atom's bytes, from its place and length; the atoms are next to each other."""
    out = np.empty(len(at), dtype=np.uint64)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(at, at.dtype.type(at[first] + WINDOW))))
        lo, hi = int(at[first]), int(at[last - 1]) + int(n[last - 1])
        begin = (at[first:last] - lo).astype(np.int32)
        inside = np.arange(hi - lo, dtype=np.int32) - np.repeat(begin, n[first:last])
        terms = _POWERS[np.minimum(inside, LONGEST)] * (data[lo:hi].astype(np.uint64) + np.uint64(1))
        out[first:last] = np.add.reduceat(terms, begin)
        first = last
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a column of texts, A to Z as a to z, and the number of words of each text.

    A word is a run of anything but ASCII white space; a null text has none.
    """
    data, bounds = text_bytes(column)
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = bounds[bounds < len(data)]
    begins[inner] = ~blank[inner]
    at = np.flatnonzero(begins)
    ends = ~blank
    ends[:-1] &= blank[1:]
    last = inner[inner > 0] - 1
    ends[last] = ~blank[last]
    n = np.flatnonzero(ends) + 1 - at
    counts = np.diff(np.searchsorted(at, bounds))
    out = np.empty(len(at), dtype=np.uint64)
    first = 0
    while first < len(at):
        to = max(first + 1, int(np.searchsorted(at, at[first] + WINDOW)))
        lo = int(at[first])
        hi = int(at[to - 1] + min(n[to - 1], LONGEST))
        begin = (at[first:to] - lo).astype(np.int32)
        sizes = np.diff(np.append(begin, hi - lo))
        inside = np.arange(hi - lo, dtype=np.int32) - np.repeat(begin, sizes)
        out[first:to] = np.add.reduceat(_POWERS[np.minimum(inside, LONGEST)] * _LOWER[data[lo:hi]], begin)
        first = to
    for i in np.flatnonzero(n > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + n[i]].tobytes().lower())
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29)), counts


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ..., at + n - 1 of each pair, one after the other."""
    ends = np.cumsum(n, dtype=np.int64)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class AtomTable:
    """Token ids of atoms in flat arrays sorted by the atoms' hashes, below 4 GB of bytes and ids."""

    def __init__(self, dtype: type) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.data, self.data_at, self.data_n = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        self._index()

    def __len__(self) -> int:
        return len(self.hash)

    def _index(self) -> None:
        self.bits = max(1, len(self.hash).bit_length())
        sizes = np.bincount((self.hash >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.deepest = int(sizes.max())

    def add(self, data: np.ndarray, n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> np.ndarray:
        """Adds atoms that are not there yet: their bytes and ids one after the other, and how many of both each has.

        Returns the table's new order: of each atom its number among the old ones with the new ones after them.
        """
        at = (np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        hash_ = hashes(data, at, n)
        if len(self.hash):
            hash_ = np.concatenate([self.hash, hash_])
        order = np.argsort(hash_, kind="stable").astype(np.uint32)
        self.hash = hash_[order]
        del hash_
        self.data_at = np.concatenate([self.data_at, at + np.uint32(len(self.data))])[order]
        self.data_n = np.concatenate([self.data_n, n.astype(np.uint32)])[order]
        self.data = np.concatenate([self.data, data])
        self.ids_at = np.concatenate([self.ids_at, (np.cumsum(ids_n, dtype=np.int64) - ids_n + len(self.ids)).astype(np.uint32)])[order]
        self.ids_n = np.concatenate([self.ids_n, ids_n.astype(np.uint32)])[order]
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self._index()
        return order

    def subset(self, rows: np.ndarray) -> AtomTable:
        """A table of the atoms of these numbers, which rise."""
        out = AtomTable(self.ids.dtype.type)
        out.hash = self.hash[rows]
        out.data, out.data_n = self.data[spread(self.data_at[rows], self.data_n[rows])], self.data_n[rows]
        out.ids, out.ids_n = self.ids[spread(self.ids_at[rows], self.ids_n[rows])], self.ids_n[rows]
        out.data_at = (np.cumsum(out.data_n, dtype=np.int64) - out.data_n).astype(np.uint32)
        out.ids_at = (np.cumsum(out.ids_n, dtype=np.int64) - out.ids_n).astype(np.uint32)
        out._index()
        return out

    def find(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The number of each atom in the table, or -1; the bytes are compared, so equal hashes do not mislead."""
        out = np.full(len(at), -1, dtype=np.int64)
        if not len(self.hash):
            return out
        bucket = (hash_ >> np.uint64(64 - self.bits)).astype(np.int64)
        low, high = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        todo = np.flatnonzero(low < high)
        for _ in range(self.deepest):
            here = low[todo]
            equal = self.hash[here] == hash_[todo]
            out[todo[equal]] = here[equal]
            todo = todo[~equal]
            low[todo] += 1
            todo = todo[low[todo] < high[todo]]
            if not len(todo):
                break
        for first in range(0, len(at), WINDOW // 8):
            found = first + np.flatnonzero(out[first : first + WINDOW // 8] >= 0)
            rows = out[found]
            same = (self.data_n[rows] == n[found]) & (n[found] <= LONGEST)
            out[found[~same]] = -1
            found, rows = found[same], rows[same]
            m = n[found]
            unlike = data[spread(at[found], m)] != self.data[spread(self.data_at[rows], m)]
            if unlike.any():
                out[found[np.add.reduceat(unlike, np.cumsum(m) - m) > 0]] = -1
        return out


def joined(table: AtomTable, rows: np.ndarray, others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all atoms one after the other, from the table or, where rows is -1, from others in turn, and how many each atom has."""
    there = rows >= 0
    n = np.empty(len(rows), dtype=np.int64)
    n[there] = table.ids_n[rows[there]]
    size = table.ids.dtype.itemsize
    n[~there] = [len(x) // size for x in others]
    out = np.empty(n.sum(), dtype=table.ids.dtype)
    mine = np.repeat(there, n)
    out[mine] = table.ids[spread(table.ids_at[rows[there]], n[there])]
    out[~mine] = np.frombuffer(b"".join(others), dtype=table.ids.dtype)
    return out, n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of strings, and where each begins, with the end; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[bounds[0] : bounds[-1]] if len(column) else whole[:0], bounds - bounds[0]
