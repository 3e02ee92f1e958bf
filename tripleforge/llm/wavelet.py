"""Token ids in binary shards: one compressed wavelet matrix each, with rank and select, and its documents."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"TFWM0002"
#: Bits of a block of the rank directory, and bytes of a plane that are compressed together.
BLOCK, FRAME = 512, 1 << 16


class BitPlane:
    """A bit vector as compressed frames, with the number of ones ahead of each block; a frame is opened when it is needed."""

    def __init__(self, frames: list[bytes], ahead: np.ndarray, n: int) -> None:
        self.frames, self.ahead, self.n = frames, ahead, n
        self.opened: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype=np.uint8))
        #: How many frames have been opened so far.
        self.reads = 0

    @classmethod
    def of(cls, packed: np.ndarray, n: int) -> BitPlane:
        squeeze = zstandard.ZstdCompressor(level=1)
        raw = packed.tobytes()
        return cls([squeeze.compress(raw[at : at + FRAME]) for at in range(0, len(raw), FRAME)], cls.directory(packed), n)

    @staticmethod
    def directory(packed: np.ndarray) -> np.ndarray:
        per = BLOCK // 8
        ones = np.zeros(max(per, -(-len(packed) // per) * per), dtype=np.uint8)
        ones[: len(packed)] = np.bitwise_count(packed)
        return np.concatenate([[0], np.cumsum(ones.reshape(-1, per).sum(axis=1, dtype=np.int64))])

    def _bytes(self, block: int) -> np.ndarray:
        """The bytes of a block."""
        frame, inside = divmod(block * (BLOCK // 8), FRAME)
        if self.opened[0] != frame:
            self.opened = frame, np.frombuffer(zstandard.decompress(self.frames[frame], max_output_size=FRAME), dtype=np.uint8)
            self.reads += 1
        return self.opened[1][inside : inside + BLOCK // 8]

    def get(self, i: int) -> int:
        inside = i % BLOCK
        return int(self._bytes(i // BLOCK)[inside >> 3] >> (7 - (inside & 7))) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        block, inside = divmod(i, BLOCK)
        count = int(self.ahead[block])
        if inside:
            data = self._bytes(block)
            whole = inside >> 3
            count += int(np.bitwise_count(data[:whole]).sum())
            count += int(data[whole] >> (8 - (inside & 7))).bit_count() if inside & 7 else 0
        return count

    def select(self, bit: int, k: int) -> int:
        """Position of the kth (from 0) one or zero."""
        counts = self.ahead if bit else np.minimum(np.arange(len(self.ahead)) * BLOCK, self.n) - self.ahead
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(block))[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def bits(self) -> np.ndarray:
        data = b"".join(zstandard.decompress(f, max_output_size=FRAME) for f in self.frames)
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=self.n).view(np.bool_)


class WaveletMatrix:
    """Ids as bit planes, highest first; each plane holds its zeros' ids before its ones' in the next."""

    def __init__(self, n: int, planes: list[BitPlane]) -> None:
        self.n, self.planes = n, planes
        self.zeros = [p.n - int(p.ahead[-1]) for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes = []
        now = np.ascontiguousarray(ids)
        for level in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            planes.append(BitPlane.of(np.packbits(bit), len(now)))
            if level:
                now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
        return cls(len(ids), planes)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i)
            ones = plane.rank1(i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _narrow(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.rank1(start), plane.rank1(end)
            start, end = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of value in positions start to end."""
        if value < 0 or value >> len(self.planes):
            return 0
        a, b = self._narrow(value, start, self.n if end is None else end)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """Position of the kth (from 0) occurrence of value; -1 if there are fewer."""
        if value < 0 or value >> len(self.planes) or k < 0:
            return -1
        a, b = self._narrow(value, 0, self.n)
        if k >= b - a:
            return -1
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].select(bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' partitions undone from the lowest."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, dtype=dtype)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = plane.bits()
            before = np.empty(self.n, dtype=dtype)
            before[np.flatnonzero(~bit)] = now[:zeros]
            before[np.flatnonzero(bit)] = now[zeros:] | dtype(1 << level)
            now = before
        return now


class TokenFile:
    """A shard: its documents' ids (None for a null one) and bounds, and the wavelet matrix of all their tokens."""

    def __init__(self, doc_ids: list[int | None], bounds: np.ndarray, matrix: WaveletMatrix) -> None:
        self.doc_ids, self.bounds, self.matrix = doc_ids, bounds, matrix

    def write(self) -> bytes:
        """The file: magic; tokens, width and documents; the documents; each plane's rank directory, frame sizes and frames; a checksum.

        All sections are told by their length, numbers are little-endian, and sections but frame sizes are zstd frames.
        """
        squeeze = zstandard.ZstdCompressor(level=1).compress
        null = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        keys = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        parts = [MAGIC, struct.pack("<QIQ", self.matrix.n, len(self.matrix.planes), len(self.doc_ids))]

        def section(data: bytes) -> None:
            parts.extend((struct.pack("<Q", len(data)), data))

        section(squeeze(null.tobytes() + keys.tobytes() + self.bounds.astype("<i8").tobytes()))
        for plane in self.matrix.planes:
            section(squeeze(np.diff(plane.ahead).astype("<u2").tobytes()))
            section(np.array([len(f) for f in plane.frames], dtype="<u4").tobytes())
            section(b"".join(plane.frames))
        body = b"".join(parts)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def read(cls, data: bytes) -> TokenFile:
        """The file of these bytes; the planes' frames stay compressed until they are needed."""
        if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("not a token file, or a damaged one")
        n, width, docs = struct.unpack_from("<QIQ", data, 8)
        at = 28

        def section() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return data[at - size : at]

        raw = zstandard.decompress(section(), max_output_size=17 * docs + 8)
        keys = np.frombuffer(raw, dtype="<i8", count=docs, offset=docs).tolist()
        bounds = np.frombuffer(raw, dtype="<i8", offset=9 * docs)
        planes = []
        for _ in range(width):
            ones = np.frombuffer(zstandard.decompress(section(), max_output_size=2 * (n // BLOCK + 2)), dtype="<u2")
            sizes = np.frombuffer(section(), dtype="<u4")
            frames, ends = section(), np.cumsum(sizes, dtype=np.int64)
            planes.append(BitPlane([frames[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]), n))
        return cls([None if x else k for x, k in zip(raw[:docs], keys, strict=True)], bounds, WaveletMatrix(n, planes))

    def document(self, i: int) -> list[int]:
        """The ids of the ith document, by access alone."""
        return [self.matrix.access(k) for k in range(int(self.bounds[i]), int(self.bounds[i + 1]))]
