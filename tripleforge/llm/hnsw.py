"""A hierarchical navigable small-world graph in numpy, built and searched in batches."""

from __future__ import annotations

import io

import numpy as np


class Hnsw:
    """Unit vectors in layers of neighbour lists; a point's layers are drawn from its number's hash."""

    def __init__(self, dimension: int, neighbours: int = 12, beam: int = 48) -> None:
        self.m, self.beam = neighbours, beam
        self.vectors = np.zeros((0, dimension), dtype=np.float32)
        self.layers: list[np.ndarray] = []  # per layer (points, neighbours), -1 where there is none
        self.entry = 0

    def __len__(self) -> int:
        return len(self.vectors)

    @staticmethod
    def _tops(numbers: np.ndarray, m: int) -> np.ndarray:
        u = ((numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
        return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int)

    def search(self, queries: np.ndarray, beam: int, layer: int = 0, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of each query's beam, best first; -1 and -2 fill what is not found."""
        if not len(self):
            return np.full((len(queries), 1), -1), np.full((len(queries), 1), -2.0, dtype=np.float32)
        if entries is None:
            entries = np.full((len(queries), 1), self.entry)
            for above in range(len(self.layers) - 1, layer, -1):
                entries = self.search(queries, 4, above, entries)[0]
        q, n = len(queries), len(self)
        links = self.layers[layer]
        seen = np.zeros((q, n + 1), dtype=bool)
        seen[:, n] = True  # where -1 points
        rows = np.arange(q)[:, None]
        seen[rows, entries] = True
        ids = np.full((q, beam), -1)
        sims = np.full((q, beam), -2.0, dtype=np.float32)
        width = min(beam, entries.shape[1])
        ids[:, :width] = entries[:, :width]
        sims[:, :width] = np.where(entries[:, :width] >= 0, np.einsum("qkd,qd->qk", self.vectors[entries[:, :width]], queries), -2.0)
        done = ids < 0
        live = np.arange(q)
        step = max(1, min(4, beam // 4))
        while len(live):
            # the best points of each beam that have not been opened yet
            rank = np.where(done[live], -3.0, sims[live])
            pick = np.argpartition(-rank, step - 1, axis=1)[:, :step] if beam > step else np.argsort(-rank, axis=1)[:, :step]
            open_ = np.take_along_axis(rank, pick, axis=1) > -3.0
            keep = open_.any(axis=1)
            live, pick, open_ = live[keep], pick[keep], open_[keep]
            if not len(live):
                break
            at = live[:, None]
            done[at, pick] = True
            near = np.where(open_[:, :, None], links[ids[at, pick]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[at, near]] = -1
            seen[at, near] = True
            new = np.einsum("qkd,qd->qk", self.vectors[near], queries[live])
            new[near < 0] = -2.0
            merged_ids = np.concatenate([ids[live], near], axis=1)
            merged = np.concatenate([sims[live], new], axis=1)
            flags = np.concatenate([done[live], near < 0], axis=1)
            best = np.argpartition(-merged, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (merged_ids, merged, flags))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def add(self, points: np.ndarray) -> None:
        """Adds points, which should be few beside those there are: each links to the best of its beam and of the points added with it."""
        first, n = len(self), len(points)
        numbers = np.arange(first, first + n)
        tops = self._tops(numbers, self.m)
        old_layers = len(self.layers)
        found = [self.search(points, self.beam, layer) if layer < old_layers else None for layer in range(min(old_layers, int(tops.max()) + 1))]
        self.vectors = np.concatenate([self.vectors, points])
        among = points @ points.T
        np.fill_diagonal(among, -2.0)
        for layer in range(max(old_layers, int(tops.max()) + 1)):
            size = self.m * (2 if layer == 0 else 1)
            if layer == len(self.layers):
                self.layers.append(np.full((first, size), -1))
            links = np.concatenate([self.layers[layer], np.full((n, size), -1)])
            mine = np.flatnonzero(tops >= layer)
            if len(mine):
                ids = np.broadcast_to(numbers[mine], (len(mine), len(mine)))
                sims = among[np.ix_(mine, mine)]
                if layer < len(found):
                    ids = np.concatenate([ids, found[layer][0][mine]], axis=1)
                    sims = np.concatenate([sims, found[layer][1][mine]], axis=1)
                k = min(size, ids.shape[1])
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                chosen, close = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
                chosen = np.where(close > -2.0, chosen, -1)
                links[numbers[mine], :k] = chosen
                self._link_back(links, np.repeat(numbers[mine], k), chosen.ravel(), size)
            self.layers[layer] = links
        if int(tops.max()) + 1 > old_layers:
            self.entry = int(numbers[tops.argmax()])

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray, size: int) -> None:
        """Adds source to its target's list, which keeps its closest points, half of its places for the closest new ones."""
        source, target = source[target >= 0], target[target >= 0]
        touched = np.unique(target)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        counts = np.bincount(np.searchsorted(touched, target), minlength=len(touched))
        at = np.arange(len(target)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = np.full((len(touched), size + int(counts.max(initial=0))), -1)
        wide[:, :size] = links[touched]
        wide[np.repeat(np.arange(len(touched)), counts), size + at] = source
        wide = np.sort(wide, axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for part in range(0, len(touched), 2_048):
            some = wide[part : part + 2_048]
            sims = np.einsum("tkd,td->tk", self.vectors[some], self.vectors[touched[part : part + 2_048]])
            sims[some < 0] = -2.0
            best = np.argsort(-sims, axis=1, kind="stable")[:, :size]
            links[touched[part : part + 2_048]] = np.take_along_axis(some, best, axis=1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, head=np.array([self.m, self.beam, self.entry]), **{f"layer{i}": x.astype(np.int32) for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Hnsw:
        with np.load(io.BytesIO(data)) as read:
            out = cls(read["vectors"].shape[1], int(read["head"][0]), int(read["head"][1]))
            out.vectors, out.entry = read["vectors"], int(read["head"][2])
            out.layers = [read[f"layer{i}"].astype(np.int64) for i in range(sum(k.startswith("layer") for k in read.files))]
        return out
