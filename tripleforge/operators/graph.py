"""Graphs of triples: one for each record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .triples import is_augmented, mentions

#: Edges of a record that one task joins at most; larger graphs go the distributed way.
GROUP_EDGES = 200_000
#: Rows from which on a task hands over the components of the records that it has joined.
ROWS = 10_000


def raw_edges(triples: DataFrame) -> DataFrame:
    """Distinct (record_id, src, dst), names as they are."""
    return triples.where("head <> '' AND tail <> ''").select("record_id", F.col("head").alias("src"), F.col("tail").alias("dst")).distinct()


def canonical_names(triples: DataFrame) -> DataFrame:
    """(record_id, name_key, node, node_seq): of names equal but for case the spelling that comes first, and its place."""
    each = mentions(triples).where("entity <> ''").select("record_id", F.lower("entity").alias("name_key"), "entity", F.struct("seq", "pos").alias("at"))
    first = each.groupBy("record_id", "name_key").agg(F.min_by("entity", "at").alias("node"), F.min("at").alias("at"))
    return first.select("record_id", "name_key", "node", (F.col("at.seq") * 2 + F.col("at.pos")).cast("int").alias("node_seq"))


def graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) on canonical names: one edge for each ordered pair, with the relation and inference of its last triple."""
    names = canonical_names(triples)
    left = names.select("record_id", F.col("name_key").alias("h"), F.col("node").alias("src"), F.col("node_seq").alias("src_seq"))
    right = names.select("record_id", F.col("name_key").alias("t"), F.col("node").alias("dst"))
    named = triples.where("head <> '' AND tail <> ''").withColumn("h", F.lower("head")).withColumn("t", F.lower("tail")).join(left, ["record_id", "h"]).join(right, ["record_id", "t"])
    edges = named.groupBy("record_id", "src", "dst").agg(F.max_by(F.struct("relation", "inference"), "seq").alias("last"), F.min("seq").alias("first_seq"), F.first("src_seq").alias("src_seq"))
    order = Window.partitionBy("record_id").orderBy("src_seq", "first_seq")
    edges = edges.select("record_id", "src", "dst", "last.relation", "last.inference", (F.row_number().over(order) - 1).alias("edge_seq"))
    return names.select("record_id", "node", "node_seq"), edges


def degrees(edges: DataFrame) -> DataFrame:
    """(record_id, node, degree): edges in and out, a self loop as two."""
    return edges.select("record_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("record_id", "node").agg(F.count("*").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("record_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("record_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "record_id", "left").select("record_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def origins(edges: DataFrame) -> DataFrame:
    """(record_id, node, origin): extracted with any explicit edge, else augmented."""
    each = edges.select("record_id", F.explode(F.array("src", "dst")).alias("node"), (~is_augmented(F.col("inference"))).alias("explicit"))
    return each.groupBy("record_id", "node").agg(F.when(F.bool_or("explicit"), "extracted").otherwise("augmented").alias("origin"))


def _join_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, node, component) of edges in which each record's stand together: a task holds the names of one record, and rows of several up to ROWS."""
    parent: dict[str, str] = {}
    now: str | None = None
    ids: list[str | None] = []
    nodes: list[str] = []
    roots: list[str] = []

    def root(x: str) -> str:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def end() -> None:
        ids.extend([now] * len(parent))
        nodes.extend(parent)
        roots.extend([root(x) for x in parent])
        parent.clear()

    def rows() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(x, pa.string()) for x in (ids, nodes, roots)], ["record_id", "node", "component"])
        for x in (ids, nodes, roots):
            x.clear()
        return out

    for batch in batches:
        for of, a, b in zip(*[batch.column(c).to_pylist() for c in ("record_id", "src", "dst")], strict=True):
            if of != now:
                end()
                now = of
                if len(ids) >= ROWS:
                    yield rows()
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    end()
    yield rows()


def components(edges: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(record_id, node, component): the least node that undirected edges reach.

    edges are checkpointed. A task joins the records with at most group_edges edges one after the other; larger
    records take rounds of the least label of neighbours and of the label's own label, each checkpointed where
    all executors see it, until a round changes nothing.
    """
    edges = edges.select("record_id", "src", "dst").checkpoint()
    large = edges.groupBy("record_id").agg(F.count("*").alias("_n")).where(F.col("_n") > group_edges).select("record_id")
    none = large.isEmpty()
    small = edges if none else edges.join(large, "record_id", "left_anti")
    out = small.repartition("record_id").sortWithinPartitions("record_id").mapInArrow(_join_sorted, "record_id string, node string, component string")
    if none:
        return out
    big = edges.join(large, "record_id", "left_semi")
    both = big.union(big.select("record_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = both.select("record_id", F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), ["record_id", "dst"]).groupBy("record_id", F.col("src").alias("node")).agg(F.min("component").alias("near"))
        up = labels.select("record_id", F.col("node").alias("component"), F.col("component").alias("up"))
        new = labels.join(near, ["record_id", "node"], "left").join(up, ["record_id", "component"], "left").select("record_id", "node", F.col("component").alias("old"), F.least("component", "near", "up").alias("component")).checkpoint()
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            break
    return out.union(labels)


def component_summary(triples: DataFrame, found: DataFrame, most_entities: int = 15, most_triples: int = 10) -> DataFrame:
    """Per component its sizes, first entities and first triples, with how many more there are."""
    member = mentions(triples).join(found.withColumnRenamed("node", "entity"), ["record_id", "entity"])
    at = member.groupBy("record_id", "component", "entity").agg(F.min(F.struct("seq", "pos")).alias("at"))
    names = at.groupBy("record_id", "component").agg(F.count("*").alias("n_entities"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("at", "entity"))), 1, most_entities), lambda r: r["entity"]).alias("e"))
    rows = member.select("record_id", "component", "seq", F.concat(F.lit("("), "head", F.lit(") --["), "relation", F.lit("]--> ("), "tail", F.lit(")")).alias("s")).distinct()
    lines = rows.groupBy("record_id", "component").agg(F.count("*").alias("n_triples"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("seq", "s"))), 1, most_triples), lambda r: r["s"]).alias("t"))
    more = lambda n, most: F.when(F.col(n) > most, F.concat(F.lit(" ... (+"), (F.col(n) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return names.join(lines, ["record_id", "component"]).select("record_id", "component", "n_entities", "n_triples", F.concat(F.array_join("e", ", "), more("n_entities", most_entities)).alias("entities"), F.concat(F.array_join("t", "; "), more("n_triples", most_triples)).alias("triples"))


def neighborhood(edges: DataFrame, node: str) -> DataFrame:
    """(record_id, node): a node and those that an edge joins to it."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return near.select("record_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def search(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(record_id, node, is_match): nodes that contain query in any case, and their neighbours."""
    hit = nodes.where(F.contains(F.lower("node"), F.lit(query.strip().lower()))).select("record_id", "node")
    both = edges.select("record_id", F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("record_id", "dst", "src"))
    near = both.join(hit, ["record_id", "node"], "left_semi").select("record_id", F.col("other").alias("node"))
    rows = hit.withColumn("m", F.lit(True)).union(near.withColumn("m", F.lit(False)))
    return rows.groupBy("record_id", "node").agg(F.max("m").alias("is_match"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, node, hops): the fewest directed edges from a record's source (record_id, node); only what is reached, however far."""
    seen = sources.select("record_id", "node", F.lit(0).alias("hops")).checkpoint()
    parts = max(1, seen.rdd.getNumPartitions())
    frontier, hop = seen, 0
    while True:
        hop += 1
        step = frontier.join(edges.select("record_id", F.col("src").alias("node"), "dst"), ["record_id", "node"]).select("record_id", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("record_id", "node"), ["record_id", "node"], "left_anti").withColumn("hops", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if hop % 16 == 0:  # else the union's partitions and plan grow with each hop
            seen = seen.coalesce(parts).checkpoint()


def _communities(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy modularity: the pair of joined communities whose union gains most, until none gains; ties to the least names."""
    pairs = {(min(a, b), max(a, b)) for a, b in zip(pdf["src"], pdf["dst"], strict=True) if a != b}
    nodes = sorted({*pdf["src"], *pdf["dst"]})
    m = len(pairs)
    of = {x: {x} for x in nodes}
    links: dict[str, dict[str, int]] = {x: {} for x in nodes}
    for a, b in pairs:
        links[a][b] = links[b][a] = 1
    weight = {x: len(links[x]) for x in nodes}
    while m:
        gain, a, b = max(((n / m - weight[x] * weight[y] / (2 * m * m), x, y) for x in links for y, n in links[x].items() if x < y), default=(0, "", ""), key=lambda g: (g[0], [-ord(c) for c in g[1]], [-ord(c) for c in g[2]]))
        if gain <= 0:
            break
        of[a] |= of.pop(b)
        weight[a] += weight.pop(b)
        for y, n in links.pop(b).items():
            links[y].pop(b, None)
            if y != a:
                links[a][y] = links[y][a] = links[a].get(y, 0) + n
    order = sorted(of.values(), key=lambda c: (-len(c), min(c)))
    rows = [(pdf["record_id"].iloc[0], x, i) for i, c in enumerate(order) for x in sorted(c)]
    return pd.DataFrame(rows, columns=["record_id", "node", "community"])


def communities(edges: DataFrame) -> DataFrame:
    """(record_id, node, community): greedy modularity communities of each record's undirected graph, the largest first."""
    return edges.groupBy("record_id").applyInPandas(_communities, "record_id string, node string, community int")


def community_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(record_id, low, high, n): how many edges join each two different communities of members (record_id, node, community)."""
    of = members.select("record_id", "node", "community")
    ends = edges.select("record_id", "src", "dst").join(of.toDF("record_id", "src", "a"), ["record_id", "src"]).join(of.toDF("record_id", "dst", "b"), ["record_id", "dst"]).where("a <> b")
    return ends.groupBy("record_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"))


def circle_layout(members: DataFrame, width: float = 1200.0, height: float = 800.0) -> DataFrame:
    """(record_id, node, x, y): each community's nodes on a circle, the communities on a larger one."""
    w = Window.partitionBy("record_id", "community")
    placed = members.withColumn("i", F.row_number().over(w.orderBy("node")) - 1).withColumn("n", F.count("*").over(w)).withColumn("k", F.max("community").over(Window.partitionBy("record_id")) + 1)
    around = 2 * F.pi() * F.col("community") / F.col("k")
    reach = F.when(F.col("k") == 1, 0.0).otherwise(0.55 * min(width, height) / 2)
    local, angle = F.greatest(F.lit(30.0), 22.0 * F.col("n")), 2 * F.pi() * F.col("i") / F.col("n")
    return placed.select("record_id", "node", (width / 2 + reach * F.cos(around) + local * F.cos(angle)).alias("x"), (height / 2 + reach * F.sin(around) + local * F.sin(angle)).alias("y"))


def node_elements(nodes: DataFrame, edges: DataFrame, label: int = 25, shown: int = 3, members: DataFrame | None = None) -> DataFrame:
    """A view's nodes: short and full label, degree, origin and whether the label shows; with members (record_id, node, community) also the community, 0 for nodes without one."""
    joined = nodes.join(degrees(edges), ["record_id", "node"], "left").join(origins(edges), ["record_id", "node"], "left")
    short = F.when(F.length("node") > label, F.concat(F.substring("node", 1, label), F.lit("..."))).otherwise(F.col("node"))
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    extra = []
    if members is not None:
        joined = joined.join(members.select("record_id", "node", "community"), ["record_id", "node"], "left")
        extra = [F.coalesce("community", F.lit(0)).alias("community")]
    return joined.select("record_id", F.col("node").alias("id"), short.alias("label"), F.col("node").alias("full_label"), degree.alias("degree"), F.coalesce("origin", F.lit("extracted")).alias("origin"), (degree >= shown).alias("show_label"), *extra)


def view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, elements): each record's nodes, with their communities, and edges as the JSON that a page draws."""
    n = node_elements(nodes, edges, members=communities(edges)).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "full_label", "degree", "origin", "show_label", "community"))).alias("nodes"))
    e = edge_elements(edges).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("id", "source", "target", "label", "inference", "edge_class"))).alias("edges"))
    return n.join(e, "record_id", "left").select("record_id", F.to_json(F.struct("nodes", "edges")).alias("elements"))


def edge_elements(edges: DataFrame) -> DataFrame:
    """A view's edges, numbered in their order."""
    kind = F.when(is_augmented(F.col("inference")), "augmented").otherwise("extracted")
    return edges.select("record_id", F.concat(F.lit("e"), F.col("edge_seq").cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label"), "inference", kind.alias("edge_class"))
