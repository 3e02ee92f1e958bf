"""Exact top-k search by the Fagin threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard, and queries of a block, that one task holds at most on average.
SHARD_ROWS = 65_536
QUERY_ROWS = 4_096
LEAST_SHARDS = 12


class SortedLists:
    """Every dimension's values in order, with their rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)  # (dimension, depth)
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1)

    def top(self, own: int, query: np.ndarray, k: int, first: int = 24) -> list[tuple[int, int]]:
        """The k (score, id) with the highest scores, ties to smaller ids, without rows whose id is own.

        Each list is read from the end where its products with the query are largest, in steps that double.
        Every row that comes up for the first time gets its whole score; the sum of the products at the
        depth reached bounds all rows not yet seen, and reading ends when it is below the kth score.
        """
        n = len(self.ids)
        dims = np.flatnonzero(query)
        weights = query[dims].astype(np.float64)
        up = weights > 0
        seen = np.zeros(n, dtype=bool)
        best = np.empty(0, dtype=np.int64)
        scores = np.empty(0)
        at, step = 0, first
        if not len(dims):
            at = n
        while True:
            if at >= n:
                fresh = np.flatnonzero(~seen)
            else:
                to = min(n, at + step)
                hit = np.zeros(n, dtype=bool)
                hit[self.order[dims[up], n - to : n - at].ravel()] = True
                hit[self.order[dims[~up], at:to].ravel()] = True
                fresh = np.flatnonzero(hit & ~seen)
                at, step = to, step * 2
            seen[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            if len(fresh):
                new = self.rows[fresh] @ query
                if len(best) >= k:
                    good = new >= scores[k - 1]
                    fresh, new = fresh[good], new[good]
                best, scores = np.concatenate([best, fresh]), np.concatenate([scores, new])
                if len(best) > 4 * k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    best, scores = best[scores >= kth], scores[scores >= kth]
                keep = np.lexsort((best, -scores))[:k]  # rows stand in the order of their ids
                best, scores = best[keep], scores[keep]
            if at >= n:
                if seen.all():
                    break
                continue
            bound = float((weights[up] * self.values[dims[up], n - at]).sum() + (weights[~up] * self.values[dims[~up], at - 1]).sum())
            if len(best) == k and bound < scores[k - 1]:
                break
        return [(int(s), int(self.ids[i])) for s, i in zip(scores, best, strict=True)]


def quantized(vectors: DataFrame, scale: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): floor(scale * component) of every vector whose components are all there and finite; others are left out, as are null ids and empty vectors."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.col(id_column).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(column) > 0)
    return vectors.where(whole).select(F.col(id_column).cast("long").alias("id"), F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("x"))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): of each query row the k rows with the highest integer inner products.

    queries is a condition on vectors. Rows are dealt to shards, query rows to blocks; each pair of a block and a
    shard is one task, which runs the threshold algorithm for each query, and the lists of all shards are
    merged by a limited window. Scores are exact: products and sums of these integers stay below 2^53.

    Vectors that are null, empty or hold null or non-finite components take no part; one without any other
    row of its length has no result. Rows whose id is the query's own are no candidates; query rows
    that repeat are searched once, and those that share an id are one query with all their scores. Ties go to smaller ids; candidates that repeat
    in several rows with the same id count once each. An empty table gives an empty result.
    """
    base = vectors.select(F.col(id_column).alias("_id"), F.col(column).alias("_x"), F.coalesce(queries, F.lit(False)).alias("_query"))
    kept = quantized(base, scale, "_id", "_x")
    data = materialize(kept, "topk")
    asked = materialize(quantized(base.where("_query"), scale, "_id", "_x").distinct(), "topk")
    n, n_asked = data.count(), asked.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "id", "x")
    right = data.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id", "x"), F.lit(shards)).alias("shard"), "id", "x")

    def searched(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        sizes = data["x"].map(len) if len(data) else pd.Series(dtype=int)
        lists = {d: SortedLists(g["id"].to_numpy(), np.array(g["x"].tolist(), dtype=np.float64)) for d, g in data.groupby(sizes)}
        for own, x in zip(asked["id"], asked["x"], strict=True):
            if len(x) in lists:
                out += [(own, i, s) for s, i in lists[len(x)].top(own, np.asarray(x, dtype=np.float64), k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(searched, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
