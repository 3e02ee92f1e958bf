"""Near-duplicate embeddings: small-world graphs per shard, searched for every vector's neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .hnsw import Hnsw

SHARD_ROWS, LEAST_SHARDS, QUERY_ROWS, BLOCK_ROWS = 65_536, 8, 32_768, 1_024
BATCH = 256
#: Share of an audit's links that the beam must find, and queries of an audit.
RECALL, AUDIT = 0.98, 96


def unit_rows(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, dtype="<f8") for x in column]) if len(column) else np.zeros((0, 1))
    return rows


def build_shard(vectors: np.ndarray, cover: float) -> tuple[Hnsw, np.ndarray, np.ndarray]:
    """(graph, leader of each row, leaders): a row whose cosine with a leader that the graph finds is at least cover joins it; others become leaders and are added.

    With cover the cosine of half the link angle all rows of one leader link with each other.
    """
    n = len(vectors)
    graph = Hnsw(vectors.shape[1])
    leader_of = np.full(n, -1)
    leaders: list[int] = []
    single = vectors.astype(np.float32)
    at, size = 0, 1
    while at < n:
        block = np.arange(at, min(n, at + size))
        at, size = at + size, min(BATCH, size * 2)
        if leaders:
            ids, _ = graph.search(single[block], 16)
            known = np.array(leaders)
            best = np.where(ids[:, 0] >= 0, known[ids[:, 0]], -1)
            sims = np.einsum("id,id->i", vectors[block], vectors[best])
            covered = (best >= 0) & (sims >= cover)
            leader_of[block[covered]] = best[covered]
            block = block[~covered]
        fresh: list[int] = []
        among = vectors[block] @ vectors[block].T
        for i in range(len(block)):
            near = [j for j in fresh if among[i, j] >= cover]
            if near:
                leader_of[block[i]] = block[near[0]]
            else:
                fresh.append(i)
                leader_of[block[i]] = block[i]
        if fresh:
            graph.add(single[block[fresh]])
            leaders += block[fresh].tolist()
    return graph, leader_of, np.array(leaders, dtype=np.int64)


def within(graph: Hnsw, queries: np.ndarray, least: np.ndarray, beam: int) -> list[np.ndarray]:
    """For each query the points whose cosine is at least least; a beam that is full of such points is widened."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)
    rest = np.arange(len(queries))
    while len(rest):
        again = []
        for part in range(0, len(rest), BATCH):
            some = rest[part : part + BATCH]
            ids, sims = graph.search(queries[some], beam)
            good = (sims >= least[some, None]) & (ids >= 0)
            for i, row in enumerate(some):
                out[row] = ids[i, good[i]]
            if beam < len(graph):
                again += some[good.all(axis=1)].tolist()
        rest, beam = np.array(again, dtype=np.int64), min(len(graph), beam * 4)
    return out


def audited_beam(graph: Hnsw, queries: np.ndarray, least: np.ndarray, beam: int = 32) -> int:
    """A beam with which a sample of queries finds RECALL of what brute force finds."""
    pick = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    truth = [np.flatnonzero(row >= bound) for row, bound in zip(queries[pick] @ graph.vectors.T, least[pick], strict=True)]
    total = sum(map(len, truth))
    while beam < len(graph):
        got = within(graph, queries[pick], least[pick], beam)
        if sum(len(np.intersect1d(a, b)) for a, b in zip(truth, got, strict=True)) >= RECALL * total:
            break
        beam = min(len(graph), beam * 2)
    return beam


def dedup_embeddings(vectors: DataFrame, least: float = 0.9, id_column: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other rows have a cosine of least or more with it, and the smallest id that links reach.

    Rows are dealt to shards by a hash. Each shard's graph holds leaders; a row within half the link angle of
    a leader joins its ball instead, and so links with all of the ball: groups of copies of any size are a
    few balls, and their links are counted, not listed. Every ball's centre queries every shard's graph with
    beams that widen until an audit against brute force finds RECALL of the neighbours and no beam is full.
    Of two balls, the angle of the centres and the radii tell that all or none of the pairs link; else the
    pairs are compared in blocks, in double precision. Components are those of balls.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths; rows that repeat an id are vectors of their own; an empty table gives an
    empty result. Other columns are not read.
    """
    angle = float(np.arccos(least))
    cover = float(np.cos(angle / 2 - 1e-6))
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    nonzero = F.exists("_x", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(column).cast("array<double>").alias("_x"))
    rows = rows.withColumn("valid", F.coalesce(finite & nonzero, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "_id", F.when(F.col("valid"), F.col("_x")).alias("_x"))
    rows = materialize(rows, "hnsw")
    valid = rows.where("_x IS NOT NULL")
    shards = max(LEAST_SHARDS, -(-valid.count() // shard_rows))
    dealt = valid.select("row", "_id", "_x", F.size("_x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def built(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["_x"].tolist(), dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys, ids = group["row"].to_numpy(), group["_id"].to_numpy()
        graph, leader_of, leaders = build_shard(x, cover)
        number = {int(leader): i for i, leader in enumerate(leaders)}
        ball = np.array([number[int(i)] for i in leader_of])
        centres = np.zeros((len(leaders), x.shape[1]))
        np.add.at(centres, ball, x)
        counts = np.bincount(ball, minlength=len(leaders))
        centres[counts == 1] = x[leaders[counts == 1]]
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, centres / np.maximum(norms, 1e-9), x[leaders])
        off = np.arccos(np.clip(np.einsum("id,id->i", x, centres[ball]), -1, 1))
        radius = np.zeros(len(leaders))
        np.maximum.at(radius, ball, np.where(counts[ball] == 1, 0.0, off + 1e-7))
        graph.vectors = centres.astype(np.float32)
        order = np.argsort(ball, kind="stable")
        place = np.empty(len(x), dtype=np.int64)
        place[order] = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        dim, shard = int(group["dim"].iloc[0]), int(group["shard"].iloc[0])
        smallest = np.full(len(leaders), np.iinfo(np.int64).max)
        np.minimum.at(smallest, ball, pd.Series(ids).fillna(np.iinfo(np.int64).max).to_numpy().astype(np.int64))
        members = pd.DataFrame({"kind": "m", "row": keys, "ball": keys[leaders][ball], "block": place // BLOCK_ROWS, "n": 0, "radius": 0.0, "data": [r.tobytes() for r in x]})
        balls = pd.DataFrame({"kind": "b", "row": smallest, "ball": keys[leaders], "block": 0, "n": counts, "radius": radius, "data": [c.tobytes() for c in centres]})
        index = pd.DataFrame({"kind": ["i"], "row": [0], "ball": [0], "block": [0], "n": [len(leaders)], "radius": [float(radius.max())], "data": [graph.dump()]})
        return pd.concat([members, balls, index]).assign(dim=dim, shard=shard)

    made = materialize(dealt.groupBy("dim", "shard").applyInPandas(built, "dim int, shard long, kind string, row long, ball long, block long, n long, radius double, data binary"), "hnsw")
    members, balls, index = (made.where(F.col("kind") == k) for k in "mbi")
    blocks = max(1, -(-balls.count() // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asking = balls.select("dim", each(shards).alias("shard"), F.pmod(F.xxhash64("ball"), F.lit(blocks)).alias("part"), "ball", "radius", "data", F.lit(0).alias("side"))
    held = balls.select("dim", "shard", each(blocks).alias("part"), "ball", "radius", "data", F.lit(1).alias("side"))
    graphs = index.select("dim", "shard", each(blocks).alias("part"), "ball", "radius", "data", F.lit(2).alias("side"))

    def searched(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "whole": pd.Series(dtype=bool)})
        stored = shard[shard["side"] == 2]
        if not len(queries) or not len(stored):
            return empty
        graph = Hnsw.load(stored["data"].iloc[0])
        own = shard[shard["side"] == 1]
        # the graph's points stand in the order in which leaders were added; balls are found by their centres' bytes
        numbers = {np.frombuffer(d, dtype="<f8").astype(np.float32).tobytes(): [] for d in own["data"]}
        for i, d in enumerate(own["data"]):
            numbers[np.frombuffer(d, dtype="<f8").astype(np.float32).tobytes()].append(i)
        place = np.array([numbers[v.tobytes()].pop() for v in graph.vectors])
        centres, radii, keys = unit_rows(own["data"])[place], own["radius"].to_numpy()[place], own["ball"].to_numpy()[place]
        x, r, names = unit_rows(queries["data"]), queries["radius"].to_numpy(), queries["ball"].to_numpy()
        reach = np.cos(np.minimum(np.pi, angle + r + radii.max() + 1e-4)).astype(np.float32)
        single = x.astype(np.float32)
        beam = audited_beam(graph, single, reach)
        out = []
        for i, near in enumerate(within(graph, single, reach, beam)):
            near = near[keys[near] != names[i]]
            if not len(near):
                continue
            cosine = centres[near] @ x[i]
            between = np.arccos(np.clip(cosine, -1, 1))
            spread = r[i] + radii[near]
            alone = spread == 0
            whole = np.where(alone, cosine >= least, between + spread <= angle - 1e-9)
            maybe = np.where(alone, whole, between - spread <= angle + 1e-9)
            out += [(min(int(k), int(names[i])), max(int(k), int(names[i])), bool(w)) for k, w, m in zip(keys[near], whole, maybe, strict=True) if m]
        return pd.DataFrame(out, columns=["a", "b", "whole"]) if out else empty

    right = held.union(graphs)
    found = asking.groupBy("dim", "shard", "part").cogroup(right.groupBy("dim", "shard", "part")).applyInPandas(searched, "a long, b long, whole boolean")
    pairs = materialize(found.groupBy("a", "b").agg(F.max("whole").alias("whole")), "hnsw")

    sizes = balls.select("ball", "n", F.col("row").alias("smallest"))
    last_block = F.floor((F.col("n") - 1) / BLOCK_ROWS).cast("long")
    part_of = sizes.select("ball", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"))
    mixed = pairs.where("NOT whole").select("a", "b")
    mixed = mixed.join(part_of.toDF("a", "block_a"), "a").join(part_of.toDF("b", "block_b"), "b")
    some = members.select("ball", "block", "row", "data")
    left = mixed.join(some.toDF("a", "block_a", "row", "data"), ["a", "block_a"]).withColumn("side", F.lit(0))
    other = mixed.join(some.toDF("b", "block_b", "row", "data"), ["b", "block_b"]).withColumn("side", F.lit(1))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        linked = unit_rows(a["data"]) @ unit_rows(b["data"]).T >= least
        out = pd.DataFrame({"row": np.concatenate([a["row"], b["row"]]), "links": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])})
        out = out[out["links"] > 0].assign(a=group["a"].iloc[0], b=group["b"].iloc[0])
        return out

    columns = ["a", "b", "block_a", "block_b", "row", "data", "side"]
    counted = materialize(left.select(columns).union(other.select(columns)).groupBy("a", "b", "block_a", "block_b").applyInPandas(compared, "row long, links long, a long, b long"), "hnsw")

    edges = pairs.where("whole").select("a", "b").union(counted.select("a", "b")).distinct()
    reached = connected_components(edges)
    small = sizes.join(reached.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least_id = small.groupBy("component").agg(F.min("smallest").alias("component_id"))
    both = pairs.where("whole").select(F.col("a").alias("ball"), F.col("b").alias("other")).union(pairs.where("whole").select("b", "a"))
    more = both.join(sizes.select(F.col("ball").alias("other"), "n"), "other").groupBy("ball").agg(F.sum("n").alias("more"))
    by_ball = small.join(least_id, "component").join(more, "ball", "left").select("ball", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("base"))
    by_row = counted.groupBy("row").agg(F.sum("links").alias("links"))
    linked = members.select("row", "ball").join(by_ball, "ball").join(by_row, "row", "left").select("row", "component_id", (F.col("base") + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("row", "_id").join(linked, "row", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
