"""Golden cases of the operators, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tripleforge import queries as Q
from tripleforge.clients import ClientConfig
from tripleforge.functions import text as X
from tripleforge.operators import constraints as C
from tripleforge.operators import graph as G
from tripleforge.operators import triples as T
from tripleforge.plans import augment as A
from tripleforge.plans import pipeline
from tripleforge.plans.domains import get_domain
from tripleforge.sources import readers

DATA = "/root/testdata/sf0.001"
TRIPLE = "record_id string, seq int, head string, relation string, tail string, inference string, justification string"


def triples(spark, *rows):
    return spark.createDataFrame([("r", i, *row, None) if len(row) == 4 else ("r", i, *row, "explicit", None) for i, row in enumerate(rows)], TRIPLE)


def test_text(spark):
    row = spark.createDataFrame([("  A ", " Is-Type Of!", "Si gma's du ty", "abcd")], "a string, b string, c string, d string")
    got = row.select(X.strip(F.col("a")), X.label_key(F.col("b")), X.clean_ocr(F.col("c")), X.find(F.col("d"), F.lit("BC"))).first()
    assert tuple(got) == ("A", "is_type_of", "Sigma's duty", 1)


def test_normalize_and_deduplicate(spark):
    got = T.normalize(triples(spark, (" A ", "r", "b"), (" ", "r", "b"), ("A", "r", "b", "guess"), ("a", "R ", "B", None)))
    assert [r.head for r in got.orderBy("seq").collect()] == ["A", "a"]
    assert T.deduplicate(got).count() == 1


def test_graph_folds_case_and_keeps_the_last_edge(spark):
    nodes, edges = G.graph(triples(spark, ("Sigma", "r", "STD"), ("SIGMA", "r2", "std"), ("A", "s", "a")))
    assert {r.node for r in nodes.collect()} == {"Sigma", "STD", "A"}
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {("Sigma", "STD", "r2"), ("A", "A", "s")}
    assert {r.node: r.degree for r in G.degrees(edges).collect()} == {"Sigma": 1, "STD": 1, "A": 2}


@pytest.mark.parametrize("most", [0, 1000])
def test_components_both_ways(spark, most):
    edges = G.raw_edges(triples(spark, ("a", "r", "b"), ("c", "r", "b"), ("c", "r", "d"), ("x", "r", "y"), ("A", "r", "z")))
    got = {r.node: r.component for r in G.components(edges, most).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "A": "A", "z": "A"}


def test_constraints(spark):
    limits = C.Constraints(True, ("Organization",), ("owns", "is_type_of"))
    judged = C.judge(triples(spark, ("A", "is type of", "Organization"), ("A", "owns", "B"), ("A", "sells", "B")), limits)
    assert [r.reasons for r in judged.orderBy("seq").collect()] == [[], [], ["relation_type"]]
    row = C.summary(judged).first()
    assert (row.n_accepted, row.n_rejected, row.n_bad_relation, row.n_bad_type, row.n_skipped) == (2, 1, 1, 0, 2)
    legal = get_domain("legal", "constrained")
    assert (len(legal.constraints("extraction").relations), len(legal.constraints("connectivity").relations)) == (29, 21)


def test_mapping_is_one_hop(spark):
    groups = spark.createDataFrame([("r", 0, "B", ["A", "B", "b"]), ("r", 1, "C", ["B"])], "record_id string, seq int, canonical string, variants array<string>")
    mapping = T.invert_groups(groups)
    assert {(r.variant_key, r.canonical) for r in mapping.collect()} == {("a", "B"), ("b", "C")}
    assert T.apply_mapping(triples(spark, ("A", "r", "D")), mapping).first().head == "B"


def test_responses(spark):
    texts = ['```json\n[{"head": "a"}]\n```', '{"triples": []}', '{"data": [{"head": "b"}, 3]}', "no json", 'x [{"head": "c"}] y']
    got = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, response string")
    assert {(r.record_id, r.head) for r in A.parse_triples(got).collect()} == {("0", "a"), ("1", None), ("2", "b"), ("4", "c")}


def test_replayed_pipeline_keeps_going_after_a_failed_record(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y")], "record_id string, text string")
    config = ClientConfig("replay", options={"a": '[{"head": "p", "relation": "q", "tail": "r"}]'})
    state = pipeline.run(pipeline.start(records), ["extract", "export-json", "convert", "visualize-network", "visualize-extraction"], pipeline.Settings(config))
    assert [r.record_id for r in state.triples.collect()] == ["a"]
    assert [r.record_id for r in state.errors.collect()] == ["b"]
    assert '<edge source="p" target="r">' in state.artifacts["graphml"].first().xml


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 7, "text": "x"}\n\n{"id": 8, "text": "y"}\n')
    (tmp_path / "b.json").write_text('{"id": 7}')
    (tmp_path / "c.csv").write_text('﻿id,text\n7,"a\nb"\n8,\n', encoding="utf-8")
    rows = readers.load_records(readers.read_table(spark, str(tmp_path / "a.jsonl")), record_ids=["7"])
    assert [(r.record_id, r.text) for r in rows.collect()] == [("7", "x")]
    with pytest.raises(readers.DataLoadError):
        readers.read_table(spark, str(tmp_path / "b.json"))
    assert [r.text for r in readers.read_table(spark, str(tmp_path / "c.csv")).orderBy("id").collect()] == ["a\nb", ""]
    (tmp_path / "d.jsonl").write_text('{"id": 7, "text": "x"}\n{bad\n')
    with pytest.raises(readers.DataLoadError):
        readers.read_table(spark, str(tmp_path / "d.jsonl"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name in Q.ORACLE_SQL:
        relation = duck.execute(Q.ORACLE_SQL[name])
        columns = [c[0] for c in relation.description]
        assert sorted(columns) == sorted(got.columns)
        want = sorted(map(repr, (tuple(r) for r in relation.fetchall())))
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == want
    else:
        assert rows


def test_graphml_round_trip(spark, tmp_path):
    (tmp_path / "r%201.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns a.xsd">
<key id="d1" for="edge" attr.name="inference" attr.type="string"/><key id="d0" for="edge" attr.name="relation" attr.type="string"/>
<graph edgedefault="directed"><node id="a"/><node id="b &amp; c"/><node id="d"/>
<edge source="a" target="b &amp; c"><data key="d0"></data></edge><edge source="b &amp; c" target="d"><data key="d1">explicit</data><data key="d0">is &lt; of</data></edge><edge source="d" target="a"/></graph></graphml>""")
    nodes, edges = readers.read_graphml(spark, str(tmp_path))
    assert [(r.record_id, r.node) for r in nodes.orderBy("node_seq").collect()] == [("r 1", "a"), ("r 1", "b & c"), ("r 1", "d")]
    assert [(r.src, r.dst, r.relation, r.inference) for r in edges.orderBy("edge_seq").collect()] == [("a", "b & c", "", None), ("b & c", "d", "is < of", "explicit"), ("d", "a", None, None)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([("r", f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "record_id string, src string, dst string")
    assert {r.component for r in G.components(edges, 0).collect()} == {"0000"}


def test_answers_without_json_are_errors(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y")], "record_id string, text string")
    config = ClientConfig("replay", options={"a": 'Here: [{"head": "h", "relation": "r", "tail": "t"}]', "b": "I cannot do that"})
    found, errors = A.extract(records, config, get_domain("default"))
    assert [(r.record_id, r.head) for r in found.collect()] == [("a", "h")]
    assert [(r.record_id, r.step, r.message) for r in errors.collect()] == [("b", "extract", "no JSON in the answer: I cannot do that")]


def test_requests_are_sent_again(monkeypatch):
    import http.client
    import io

    from tripleforge.clients import LLMClientError
    from tripleforge.clients import http as H

    sent = []

    def broken(request, timeout):
        sent.append(request)
        if len(sent) < 3:
            raise http.client.RemoteDisconnected("gone")
        return io.BytesIO(b'{"ok": 1}')

    monkeypatch.setattr(H, "PAUSE", 0)
    monkeypatch.setattr(H.urllib.request, "urlopen", broken)
    assert H.post("http://x", {}, {}, 1) == {"ok": 1} and len(sent) == 3
    sent.clear()
    monkeypatch.setattr(H.urllib.request, "urlopen", lambda request, timeout: (_ for _ in ()).throw(ConnectionResetError("reset")))
    with pytest.raises(LLMClientError):
        H.post("http://x", {}, {}, 1)


def test_triples_of_odd_file_names(spark, tmp_path):
    for name in ("a+b", "100%", "r%201", "plain"):
        (tmp_path / f"{name}.json").write_text('[{"head": "h", "relation": "r", "tail": "t"}]')
    assert {r.record_id for r in readers.read_triples(spark, str(tmp_path)).collect()} == {"a+b", "100%", "r 1", "plain"}


def test_limit_takes_the_first_by_id_or_by_file(spark, tmp_path):
    documents = tmp_path / "documents.parquet"
    rows = [(9, "a"), (None, "b"), (70, "c"), (5, "d")] + [(i, f"{i} " * 9) for i in range(400, 10, -1)]
    for ids in (rows[:4], rows[4:]):  # the second file is larger, and so Spark reads it first
        spark.createDataFrame(ids, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(documents))
    got = Q.QUERIES["limit_records"](spark, str(tmp_path)).collect()
    want = duckdb.sql(Q.ORACLE_SQL["limit_records"].replace("documents", f"'{documents}/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    lines = tmp_path / "in.jsonl"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"id": 3, "text": "x"}\n{"id": 1, "text": "y"}\n')
    (lines / "b.jsonl").write_text("".join(f'{{"id": {i}, "text": "{"z" * 99}"}}\n' for i in range(10, 60)))
    got = readers.load_records(readers.read_table(spark, str(lines)), limit=3)
    assert [r.record_id for r in got.collect()] == ["3", "1", "10"]
    assert readers.load_records(spark.range(9).withColumn("text", F.lit("x")).repartition(3), limit=4).count() == 4
