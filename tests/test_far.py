"""Graphs that are deeper than any of the given tables."""

from tripleforge.operators import graph as G


def test_distances_go_as_far_as_edges_do(spark):
    edges = spark.createDataFrame([("r", f"n{i}", f"n{i + 1}") for i in range(60)] + [("r", "n60", "n0")], "record_id string, src string, dst string").coalesce(1)
    got = G.distances(edges, spark.createDataFrame([("r", "n0")], "record_id string, node string").coalesce(1))
    assert {r.node: r.hops for r in got.collect()} == {f"n{i}": i for i in range(61)}
