"""What a query does must grow with its input: each row is made once, and no record costs a call of its own."""

import random

import pytest

from tripleforge import queries as Q
from tripleforge.clients import ClientConfig
from tripleforge.operators import graph as G
from tripleforge.plans import augment as A
from tripleforge.plans.domains import get_domain

TRIPLE = "record_id string, seq int, head string, relation string, tail string, inference string, justification string"


def counted(spark, df):
    """df, and how many of its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def triples(spark, n):
    rows = [(f"r{r}", i, h, "of", t, "explicit", None) for r in range(n) for i, (h, t) in enumerate([("a", "b"), ("c", "d")][: 1 + r % 2])]
    return spark.createDataFrame(rows, TRIPLE), len(rows)


@pytest.mark.parametrize("most", [15, 1000])
def test_components_of_many_records(spark, monkeypatch, most):
    monkeypatch.setattr(G, "ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # records go over the bounds of batches
    rng = random.Random(3)
    rows = [(None if r == 5 else f"r{r}", f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for r in range(40) for _ in range(rng.randrange(1, 20))]
    rows = sorted(set(rows) - {x for x in rows if x[0] is None}, key=str) + [(None, "b", "a"), (None, "b", "c")]
    want = {(r, x): x for r, a, b in rows for x in (a, b)}
    for _ in range(20):
        for r, a, b in rows:
            want[r, a] = want[r, b] = min(want[r, a], want[r, b])
    try:
        found = G.components(spark.createDataFrame(rows, "record_id string, src string, dst string"), most)
        assert sorted(map(str, found.collect())) == sorted(f"Row(record_id={r!r}, node={x!r}, component={c!r})" for (r, x), c in want.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_make_edges_once_and_call_nothing_for_each_record(spark):
    edges, made = counted(spark, spark.createDataFrame([(f"r{i}", "b", "a") for i in range(50)], "record_id string, src string, dst string"))
    found = G.components(edges)
    assert found.count() == 100 and made.value == 50
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_connectivity_makes_triples_once_and_asks_only_where_bridges_came(spark, monkeypatch):
    table, n = triples(spark, 30)
    table, made = counted(spark, table)
    sought, plain = [], G.components
    monkeypatch.setattr(G, "components", lambda edges: sought.append(edges.select("record_id").distinct().count()) or plain(edges))
    records = table.sparkSession.createDataFrame([(f"r{i}", "text") for i in range(30)], "record_id string, text string")
    done, log = A.connectivity(records, table, ClientConfig("rule"), get_domain("default"), max_disconnected=1, max_iterations=3)
    assert done.where("inference = 'contextual'").count() == 15 and done.count() == n + 15 and log.count() == 15
    assert made.value == n and sought == [30, 15]


def test_flagship_makes_triples_once(spark, monkeypatch):
    table, n = triples(spark, 30)
    table, made = counted(spark, table)
    monkeypatch.setattr(Q, "_triples", lambda s, d: table)
    got = Q.flagship(spark, "").collect()
    assert sorted((r.n_nodes, r.n_edges, r.n_components) for r in got) == [(2, 1, 1)] * 15 + [(4, 2, 2)] * 15
    assert made.value == n
