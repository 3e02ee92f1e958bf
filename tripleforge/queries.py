"""The registered queries of the library, and the same in DuckDB SQL.

Records are the documents; triples those of the rule client (FIXTURES.md, F4): head, relation and tail of
every match, by document and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clients import ClientConfig
from .functions import text as X
from .operators import constraints as C
from .operators import graph as G
from .operators import triples as T
from .plans import augment as A
from .plans import pipeline
from .plans.domains import get_domain
from .sources.readers import load_records
from .sources.writers import triples_json

#: Schema constraints of the validation queries.
LIMITS = C.Constraints(True, ("The", "Of", "And", "Is type"), ("of", "by", "in", "is"))
IDS = ("1", "2", "3", "5", "8", "13", "21")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return load_records(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"), "text", "doc_id")


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return T.normalize(T.extract_by_rule(_records(spark, d)))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.graph(_triples(spark, d))


def _components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(G.raw_edges(_triples(spark, d)))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return T.rule_groups(_upper(spark, d), X.label_key)


def _upper(spark: SparkSession, d: str) -> DataFrame:
    """Triples and, after them, the same with heads in upper case (FIXTURES.md, F5)."""
    t = _triples(spark, d)
    return T.append(t, t.withColumn("head", F.upper("head")))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return C.judge(_triples(spark, d), LIMITS)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Per document the nodes, edges and components of its graph."""
    nodes, edges = G.graph(_triples(spark, d).select(*CORE).checkpoint())
    edges = edges.select("record_id", "src", "dst").checkpoint()
    parts = G.components(edges).groupBy("record_id").agg(F.countDistinct("component").alias("n_components"))
    return G.stats(nodes, edges).join(parts, "record_id")


def _bridged(spark: SparkSession, d: str) -> DataFrame:
    records, triples = _records(spark, d), _triples(spark, d)
    done, _ = A.connectivity(records, triples, ClientConfig("rule"), get_domain("default"), max_disconnected=1, max_iterations=2)
    return done.select("record_id", "seq", "head", "relation", "tail", "inference")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    state = pipeline.run(pipeline.start(_records(spark, d)), ["extract", "convert"], pipeline.Settings())
    return pipeline.summary(state)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    t = triples_json(_triples(spark, d))
    answers = t.select("record_id", F.concat(F.lit("```json\n{\"triples\": "), "json", F.lit("}\n```")).alias("response"))
    return A.parse_triples(answers).select("record_id", "seq", "head", "relation", "tail", "inference")


def _hops(spark: SparkSession, d: str) -> DataFrame:
    edges = G.raw_edges(_triples(spark, d))
    sources = edges.groupBy("record_id").agg(F.min("src").alias("node"))
    return G.distances(edges, sources)


CORE = ["record_id", "seq", "head", "relation", "tail", "inference"]

QUERIES = {
    "flagship": flagship,
    "load_records": lambda s, d: _records(s, d).select("record_id", F.length("text").cast("long").alias("n_text"), "source"),
    "filter_record_ids": lambda s, d: load_records(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", "doc_id", IDS).select("record_id", "text"),
    "limit_records": lambda s, d: load_records(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", "doc_id", None, 25, "doc_id").select("record_id", "text"),
    "sanitize_control": lambda s, d: _records(s, d).select("record_id", X.sanitize_control(F.col("text")).alias("text")),
    "clean_ocr": lambda s, d: _records(s, d).select("record_id", X.clean_ocr(F.replace(F.col("text"), F.lit("th"), F.lit("th e tha t du ty"))).alias("text")),
    "normalize_labels": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", X.label_key(F.concat(F.lit(" "), "p_type", F.lit("-!"))).alias("label")),
    "render_prompt": lambda s, d: _records(s, d).select("record_id", X.render_prompt("Facts of {{record_json}}.\n{{schema_constraints}}", F.col("source"), "- of\n- by").alias("prompt")),
    "text_excerpt": lambda s, d: T.source_excerpt(_records(s, d), 400),
    "extract_rule": lambda s, d: T.extract_by_rule(_records(s, d)).select(*CORE, "justification"),
    "normalize_triples": lambda s, d: _triples(s, d).select(*CORE),
    "union_triples": lambda s, d: _upper(s, d).select(*CORE),
    "dedupe_triples": lambda s, d: T.deduplicate(_upper(s, d)).select(*CORE),
    "unique_entities": lambda s, d: T.entities(_triples(s, d)),
    "triple_strings": lambda s, d: T.strings(_triples(s, d)),
    "entity_context": lambda s, d: T.entity_context(_triples(s, d)),
    "duplicate_rate": lambda s, d: T.duplicate_rate(_triples(s, d)),
    "records_triples_inner": lambda s, d: _records(s, d).select("record_id", "source").join(_triples(s, d).groupBy("record_id").agg(F.count("*").alias("n")), "record_id"),
    "triples_left_join": lambda s, d: _records(s, d).select("record_id", "source").join(_triples(s, d).groupBy("record_id").agg(F.count("*").alias("n")), "record_id", "left"),
    "canonical_names": lambda s, d: G.canonical_names(_upper(s, d)),
    "raw_edges": lambda s, d: G.raw_edges(_triples(s, d)),
    "graph_nodes": lambda s, d: G.graph(_upper(s, d))[0],
    "graph_edges": lambda s, d: G.graph(_upper(s, d))[1],
    "graph_stats": lambda s, d: G.stats(*_graph(s, d)),
    "node_degree": lambda s, d: G.degrees(_graph(s, d)[1]),
    "node_origin": lambda s, d: G.origins(_graph(s, d)[1]),
    "augmented_only_nodes": lambda s, d: G.origins(_graph(s, d)[1]).where("origin = 'augmented'").select("record_id", "node"),
    "filter_by_origin": lambda s, d: G.origins(_graph(s, d)[1]).where("origin = 'extracted'").select("record_id", "node"),
    "connected_components": _components,
    "component_count": lambda s, d: _components(s, d).groupBy("record_id").agg(F.countDistinct("component").alias("n_components")),
    "component_summary": lambda s, d: G.component_summary(_triples(s, d), _components(s, d)).select("record_id", "component", "n_entities", "n_triples", "entities", "triples"),
    "neighborhood": lambda s, d: G.neighborhood(_graph(s, d)[1], "the"),
    "search_nodes": lambda s, d: G.search(*_graph(s, d), " TH "),
    "shortest_path": _hops,
    "node_elements": lambda s, d: G.node_elements(*_graph(s, d)),
    "edge_elements": lambda s, d: G.edge_elements(_graph(s, d)[1]),
    "entity_spans": lambda s, d: T.entity_spans(_triples(s, d), _records(s, d)).select("record_id", "idx", "entity", "start", "end", "class"),
    "span_classes": lambda s, d: T.entity_spans(_triples(s, d), _records(s, d), "relation").groupBy("class").agg(F.count("*").alias("n")),
    "communities": lambda s, d: G.communities(_graph(s, d)[1]),
    "circle_layout": lambda s, d: G.circle_layout(G.communities(_graph(s, d)[1])),
    "validate_relations": lambda s, d: _triples(s, d).where(C.relation_allowed(LIMITS)).select(*CORE),
    "rejected_relations": lambda s, d: _triples(s, d).where(~C.relation_allowed(LIMITS)).select(*CORE),
    "validate_entity_types": lambda s, d: _judged(s, d).select("record_id", "seq", "type_ok"),
    "schema_validation_summary": lambda s, d: C.summary(C.judge(_triples(s, d).withColumn("head_type", F.array("head")), LIMITS)),
    "rejected_samples": lambda s, d: C.rejected_samples(_judged(s, d)),
    "invert_groups": lambda s, d: T.invert_groups(_groups(s, d)),
    "apply_entity_mapping": lambda s, d: T.resolve_by_rule(_upper(s, d), X.label_key)[0].select(*CORE),
    "er_stats": lambda s, d: T.resolution_stats(_upper(s, d), T.invert_groups(_groups(s, d)), T.resolve_by_rule(_upper(s, d), X.label_key)[0]),
    "connectivity_iteration": lambda s, d: A.bridge_by_rule(_triples(s, d)),
    "connectivity_loop": _bridged,
    "entity_resolution": lambda s, d: A.entity_resolution(_records(s, d), _upper(s, d), ClientConfig("rule"), get_domain("default"))[0].select(*CORE),
    "parse_llm_json": _parsed,
    "export_json": lambda s, d: triples_json(_triples(s, d)),
    "run_summary": _summary,
}

_PATTERN = r"\b([A-Z][a-z]+) (of|by|the|in|on|for|is|was|and|that) ([a-z]+)"
_T = rf"""m AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, regexp_extract_all(text, '{_PATTERN}') AS a FROM documents),
s AS (SELECT record_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS seq, unnest(a) AS s FROM m),
t AS (SELECT record_id, seq, split_part(s, ' ', 1) AS head, split_part(s, ' ', 2) AS relation, split_part(s, ' ', 3) AS tail,
  CASE WHEN split_part(s, ' ', 2) IN ('and', 'that') THEN 'contextual' ELSE 'explicit' END AS inference, s AS justification FROM s)"""
_U = f"""{_T},
z AS (SELECT record_id, max(seq) + 1 AS f FROM t GROUP BY record_id),
u AS (SELECT record_id, seq, head, relation, tail, inference FROM t UNION ALL
  SELECT t.record_id, CAST(seq + f AS INTEGER), upper(head), relation, tail, inference FROM t JOIN z ON t.record_id = z.record_id)"""


def _graph_sql(base: str, source: str) -> str:
    return f"""{base},
e AS (SELECT record_id, seq, 0 AS pos, head AS x FROM {source} UNION ALL SELECT record_id, seq, 1, tail FROM {source}),
n AS (SELECT record_id, lower(x) AS name_key, arg_min(x, seq * 2 + pos) AS node, CAST(min(seq * 2 + pos) AS INTEGER) AS node_seq FROM e GROUP BY record_id, lower(x)),
g AS (SELECT a.record_id, h.node AS src, k.node AS dst, h.node_seq AS src_seq, a.seq, a.relation, a.inference FROM {source} a
  JOIN n h ON h.record_id = a.record_id AND h.name_key = lower(a.head) JOIN n k ON k.record_id = a.record_id AND k.name_key = lower(a.tail)),
d AS (SELECT record_id, src, dst, arg_max(relation, seq) AS relation, arg_max(inference, seq) AS inference, min(seq) AS first_seq, min(src_seq) AS src_seq FROM g GROUP BY record_id, src, dst),
edges AS (SELECT record_id, src, dst, relation, inference, CAST(row_number() OVER (PARTITION BY record_id ORDER BY src_seq, first_seq) - 1 AS INTEGER) AS edge_seq FROM d),
ends AS (SELECT record_id, src AS node, inference FROM edges UNION ALL SELECT record_id, dst, inference FROM edges),
deg AS (SELECT record_id, node, count(*) AS degree FROM ends GROUP BY record_id, node),
org AS (SELECT record_id, node, CASE WHEN bool_or(inference <> 'contextual') THEN 'extracted' ELSE 'augmented' END AS origin FROM ends GROUP BY record_id, node)"""


_GT, _GU = _graph_sql(_T, "t"), _graph_sql(_U, "u")
_CC = f"""{_T},
r0 AS (SELECT DISTINCT record_id, head AS a, tail AS b FROM t),
w AS (SELECT record_id, a, b FROM r0 UNION SELECT record_id, b, a FROM r0),
reach AS (SELECT record_id, a AS node, a AS label FROM w UNION SELECT reach.record_id, reach.node, w.b FROM reach JOIN w ON w.record_id = reach.record_id AND w.a = reach.label),
c AS (SELECT record_id, node, min(label) AS component FROM reach GROUP BY record_id, node)"""
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_OK = "relation IN ('of', 'by', 'in', 'is')"
_TYPE = f"CASE WHEN {_KEY.format('relation')} IN ('is_type', 'is_type_of', 'type_of', 'instance_of', 'entity_type', 'category_of') THEN lower(head) IN ('the', 'of', 'and') OR lower(tail) IN ('the', 'of', 'and') END"
_ER = f"""{_U},
n AS (SELECT DISTINCT record_id, head AS x FROM u UNION SELECT DISTINCT record_id, tail FROM u),
k AS (SELECT record_id, {_KEY.format('x')} AS k, list_sort(list(x)) AS names, max(length(x)) AS l FROM n GROUP BY 1, 2 HAVING count(*) > 1 AND {_KEY.format('min(x)')} <> ''),
gr AS (SELECT record_id, k, list_min(list_filter(names, lambda y: length(y) = l)) AS canonical, names FROM k),
v AS (SELECT record_id, k, canonical, unnest(names) AS v FROM gr),
mp AS (SELECT record_id, lower(v) AS variant_key, arg_max(canonical, k) AS canonical FROM v WHERE v <> canonical GROUP BY record_id, lower(v)),
ap AS (SELECT u.record_id, u.seq, coalesce(h.canonical, u.head) AS head, u.relation, coalesce(q.canonical, u.tail) AS tail, u.inference FROM u
  LEFT JOIN mp h ON h.record_id = u.record_id AND h.variant_key = lower(u.head) LEFT JOIN mp q ON q.record_id = u.record_id AND q.variant_key = lower(u.tail)),
er AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY record_id, lower(head), lower(relation), lower(tail) ORDER BY seq) = 1)"""


def _ocr() -> str:
    out = "replace(text, 'th', 'th e tha t du ty')"
    for broken, fixed in X.OCR_REPAIRS:
        out = f"replace({out}, '{broken.replace(chr(39), chr(39) * 2)}', '{fixed.replace(chr(39), chr(39) * 2)}')"
    return out


_FOUND = "CASE WHEN strpos(text, x) > 0 THEN strpos(text, x) ELSE strpos(lower(text), lower(x)) END - 1"
_SPANS = f"""{_T},
e AS (SELECT record_id, seq, 0 AS pos, head AS x, relation, inference FROM t UNION ALL SELECT record_id, seq, 1, tail, relation, inference FROM t),
f AS (SELECT e.*, CAST({_FOUND} AS INTEGER) AS start FROM e JOIN documents ON CAST(doc_id AS VARCHAR) = record_id),
o AS (SELECT * FROM f WHERE start >= 0 QUALIFY row_number() OVER (PARTITION BY record_id, lower(x) ORDER BY seq, pos) = 1)"""

ORACLE_SQL = {
    "flagship": f"WITH RECURSIVE {_GT}, w AS (SELECT record_id, src AS a, dst AS b FROM edges UNION SELECT record_id, dst, src FROM edges), reach AS (SELECT record_id, a AS node, a AS label FROM w UNION SELECT reach.record_id, reach.node, w.b FROM reach JOIN w ON w.record_id = reach.record_id AND w.a = reach.label), c AS (SELECT record_id, node, min(label) AS component FROM reach GROUP BY 1, 2), cc AS (SELECT record_id, count(DISTINCT component) AS n_components FROM c GROUP BY 1), nn AS (SELECT record_id, count(*) AS n_nodes FROM n GROUP BY 1), ee AS (SELECT record_id, count(*) AS n_edges FROM edges GROUP BY 1) SELECT * FROM nn JOIN ee USING (record_id) JOIN cc USING (record_id)",
    "load_records": "SELECT CAST(doc_id AS VARCHAR) AS record_id, length(text) AS n_text, source FROM documents",
    "filter_record_ids": f"SELECT CAST(doc_id AS VARCHAR) AS record_id, text FROM documents WHERE CAST(doc_id AS VARCHAR) IN {IDS}",
    "limit_records": "SELECT CAST(doc_id AS VARCHAR) AS record_id, text FROM documents ORDER BY doc_id LIMIT 25",
    "sanitize_control": r"SELECT CAST(doc_id AS VARCHAR) AS record_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS text FROM documents",
    "clean_ocr": f"SELECT CAST(doc_id AS VARCHAR) AS record_id, {_ocr()} AS text FROM documents",
    "normalize_labels": f"SELECT p_partkey, {_KEY.format(chr(39) + ' ' + chr(39) + ' || p_type || ' + chr(39) + '-!' + chr(39))} AS label FROM part",
    "render_prompt": "SELECT CAST(doc_id AS VARCHAR) AS record_id, 'Facts of ' || source || '.' || chr(10) || '- of' || chr(10) || '- by' AS prompt FROM documents",
    "text_excerpt": "SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS excerpt FROM documents",
    "extract_rule": f"WITH {_T} SELECT * FROM t",
    "normalize_triples": f"WITH {_T} SELECT record_id, seq, head, relation, tail, inference FROM t",
    "union_triples": f"WITH {_U} SELECT * FROM u",
    "dedupe_triples": f"WITH {_U} SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY record_id, lower(head), lower(relation), lower(tail) ORDER BY seq) = 1",
    "unique_entities": f"WITH {_T} SELECT record_id, head AS entity FROM t UNION SELECT record_id, tail FROM t",
    "triple_strings": f"WITH {_T} SELECT record_id, seq, '(' || head || ') --[' || relation || ']--> (' || tail || ')' AS triple FROM t",
    "entity_context": f"WITH {_T}, e AS (SELECT record_id, seq, head AS entity, head, relation, tail FROM t UNION SELECT record_id, seq, tail, head, relation, tail FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY record_id, entity ORDER BY seq) AS i FROM e) SELECT record_id, entity, string_agg('(' || head || ') --[' || relation || ']--> (' || tail || ')', '; ' ORDER BY i) AS context FROM r WHERE i <= 8 GROUP BY 1, 2",
    "duplicate_rate": f"WITH {_T} SELECT record_id, count(*) AS total, count(DISTINCT (head, relation, tail)) AS n_unique, 1 - count(DISTINCT (head, relation, tail)) / count(*) AS duplicate_rate FROM t GROUP BY 1",
    "records_triples_inner": f"WITH {_T}, c AS (SELECT record_id, count(*) AS n FROM t GROUP BY 1) SELECT record_id, source, n FROM documents JOIN c ON CAST(doc_id AS VARCHAR) = record_id",
    "triples_left_join": f"WITH {_T}, c AS (SELECT record_id, count(*) AS n FROM t GROUP BY 1) SELECT CAST(doc_id AS VARCHAR) AS record_id, source, n FROM documents LEFT JOIN c ON CAST(doc_id AS VARCHAR) = record_id",
    "canonical_names": f"WITH {_GU} SELECT * FROM n",
    "raw_edges": f"WITH {_T} SELECT DISTINCT record_id, head AS src, tail AS dst FROM t",
    "graph_nodes": f"WITH {_GU} SELECT record_id, node, node_seq FROM n",
    "graph_edges": f"WITH {_GU} SELECT * FROM edges",
    "graph_stats": f"WITH {_GT}, a AS (SELECT record_id, count(*) AS n_nodes FROM n GROUP BY 1), b AS (SELECT record_id, count(*) AS n_edges FROM edges GROUP BY 1) SELECT a.record_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM a LEFT JOIN b ON a.record_id = b.record_id",
    "node_degree": f"WITH {_GT} SELECT * FROM deg",
    "node_origin": f"WITH {_GT} SELECT * FROM org",
    "augmented_only_nodes": f"WITH {_GT} SELECT record_id, node FROM ends EXCEPT SELECT record_id, node FROM ends WHERE inference <> 'contextual'",
    "filter_by_origin": f"WITH {_GT} SELECT record_id, node FROM org WHERE origin = 'extracted'",
    "connected_components": f"WITH RECURSIVE {_CC} SELECT * FROM c",
    "component_summary": f"""WITH RECURSIVE {_CC},
mm AS (SELECT record_id, seq, 0 AS pos, head AS node, head, relation, tail FROM t UNION ALL SELECT record_id, seq, 1, tail, head, relation, tail FROM t),
mc AS (SELECT mm.*, component FROM mm JOIN c USING (record_id, node)),
en AS (SELECT record_id, component, node, min(seq * 2 + pos) AS place FROM mc GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY record_id, component ORDER BY place, node) AS k FROM en),
ea AS (SELECT record_id, component, count(*) AS n_entities, string_agg(node, ', ' ORDER BY k) FILTER (k <= 15) AS e FROM er GROUP BY ALL),
tn AS (SELECT DISTINCT record_id, component, seq, '(' || head || ') --[' || relation || ']--> (' || tail || ')' AS s FROM mc),
tr AS (SELECT *, row_number() OVER (PARTITION BY record_id, component ORDER BY seq, s) AS k FROM tn),
ta AS (SELECT record_id, component, count(*) AS n_triples, string_agg(s, '; ' ORDER BY k) FILTER (k <= 10) AS l FROM tr GROUP BY ALL)
SELECT record_id, component, n_entities, n_triples, e || CASE WHEN n_entities > 15 THEN ' ... (+' || (n_entities - 15) || ' more)' ELSE '' END AS entities,
  l || CASE WHEN n_triples > 10 THEN ' ... (+' || (n_triples - 10) || ' more)' ELSE '' END AS triples
FROM ea JOIN ta USING (record_id, component)""",
    "component_count": f"WITH RECURSIVE {_CC} SELECT record_id, count(DISTINCT component) AS n_components FROM c GROUP BY 1",
    "neighborhood": f"WITH {_GT} SELECT record_id, src AS node FROM edges WHERE src = 'the' OR dst = 'the' UNION SELECT record_id, dst FROM edges WHERE src = 'the' OR dst = 'the'",
    "search_nodes": f"WITH {_GT}, h AS (SELECT record_id, node FROM n WHERE contains(lower(node), 'th')), b AS (SELECT record_id, src AS x, dst AS y FROM edges UNION SELECT record_id, dst, src FROM edges), a AS (SELECT record_id, node, true AS m FROM h UNION ALL SELECT b.record_id, y, false FROM b JOIN h ON h.record_id = b.record_id AND h.node = x) SELECT record_id, node, bool_or(m) AS is_match FROM a GROUP BY 1, 2",
    "shortest_path": f"WITH RECURSIVE {_T}, e AS (SELECT DISTINCT record_id, head AS a, tail AS b FROM t), p AS (SELECT record_id, min(a) AS node, 0 AS hops FROM e GROUP BY 1 UNION SELECT p.record_id, e.b, hops + 1 FROM p JOIN e ON e.record_id = p.record_id AND e.a = p.node WHERE hops < 50) SELECT record_id, node, CAST(min(hops) AS INTEGER) AS hops FROM p GROUP BY 1, 2",
    "node_elements": f"WITH {_GT} SELECT n.record_id, n.node AS id, CASE WHEN length(n.node) > 25 THEN substring(n.node, 1, 25) || '...' ELSE n.node END AS label, n.node AS full_label, coalesce(degree, 0) AS degree, coalesce(origin, 'extracted') AS origin, coalesce(degree, 0) >= 3 AS show_label FROM n LEFT JOIN deg USING (record_id, node) LEFT JOIN org USING (record_id, node)",
    "edge_elements": f"WITH {_GT} SELECT record_id, 'e' || edge_seq AS id, src AS source, dst AS target, relation AS label, inference, CASE WHEN inference = 'contextual' THEN 'augmented' ELSE 'extracted' END AS edge_class FROM edges",
    "entity_spans": f"WITH {_SPANS} SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY seq, pos) - 1 AS INTEGER) AS idx, x AS entity, start, CAST(start + length(x) AS INTEGER) AS \"end\", CASE WHEN pos = 0 THEN 'Head' ELSE 'Tail' END || ' Entity' || CASE WHEN inference = 'contextual' THEN ' (Augmented)' ELSE '' END AS class FROM o",
    "span_classes": f"WITH {_SPANS} SELECT relation || CASE WHEN pos = 0 THEN ' (source)' ELSE ' (target)' END AS class, count(*) AS n FROM o GROUP BY 1",
    "validate_relations": f"WITH {_T} SELECT record_id, seq, head, relation, tail, inference FROM t WHERE {_OK}",
    "rejected_relations": f"WITH {_T} SELECT record_id, seq, head, relation, tail, inference FROM t WHERE NOT ({_OK})",
    "validate_entity_types": f"WITH {_T} SELECT record_id, seq, {_TYPE} AS type_ok FROM t",
    "schema_validation_summary": f"WITH {_T}, j AS (SELECT record_id, {_OK} AS r, lower(head) IN ('the', 'of', 'and', 'is_type') AS y FROM t) SELECT record_id, count(*) FILTER (r AND y) AS n_accepted, count(*) FILTER (NOT (r AND y)) AS n_rejected, count(*) FILTER (NOT r) AS n_bad_relation, count(*) FILTER (NOT y) AS n_bad_type, CAST(0 AS BIGINT) AS n_skipped FROM j GROUP BY 1",
    "rejected_samples": f"WITH {_T}, r AS (SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY seq) AS INTEGER) AS sample, head, relation, tail, 'relation_type' AS reasons FROM t WHERE NOT ({_OK})) SELECT * FROM r WHERE sample <= 5",
    "invert_groups": f"WITH {_ER} SELECT * FROM mp",
    "apply_entity_mapping": f"WITH {_ER} SELECT * FROM er",
    "entity_resolution": f"WITH {_ER} SELECT * FROM er",
    "er_stats": f"WITH {_ER}, b AS (SELECT record_id, count(*) AS n_before FROM u GROUP BY 1), a AS (SELECT record_id, count(*) AS n_after FROM er GROUP BY 1), q AS (SELECT record_id, count(*) AS n_variants, count(DISTINCT canonical) AS n_canonical FROM mp GROUP BY 1) SELECT record_id, coalesce(n_variants, 0) AS n_variants, coalesce(n_canonical, 0) AS n_canonical, n_before, coalesce(n_after, 0) AS n_after, n_before - coalesce(n_after, 0) AS n_removed FROM b LEFT JOIN q USING (record_id) LEFT JOIN a USING (record_id)",
    "connectivity_iteration": f"WITH RECURSIVE {_CC}, h AS (SELECT DISTINCT record_id, component FROM c), f AS (SELECT record_id, min(component) AS tail FROM h GROUP BY 1) SELECT h.record_id, component AS head, 'part_of_context' AS relation, tail, 'contextual' AS inference FROM h JOIN f ON f.record_id = h.record_id WHERE component <> tail",
    "connectivity_loop": f"WITH RECURSIVE {_CC}, h AS (SELECT DISTINCT record_id, component FROM c), f AS (SELECT record_id, min(component) AS tail FROM h GROUP BY 1), z AS (SELECT record_id, max(seq) AS l FROM t GROUP BY 1) SELECT record_id, seq, head, relation, tail, inference FROM t UNION ALL SELECT h.record_id, CAST(l + row_number() OVER (PARTITION BY h.record_id ORDER BY component) AS INTEGER), component, 'part_of_context', tail, 'contextual' FROM h JOIN f ON f.record_id = h.record_id JOIN z ON z.record_id = h.record_id WHERE component <> tail",
    "parse_llm_json": f"WITH {_T} SELECT record_id, seq, head, relation, tail, inference FROM t",
    "export_json": f"WITH {_T} SELECT record_id, '[' || string_agg('{{\"head\":\"' || head || '\",\"relation\":\"' || relation || '\",\"tail\":\"' || tail || '\",\"inference\":\"' || inference || '\",\"justification\":\"' || justification || '\"}}', ',' ORDER BY seq) || ']' AS json FROM t GROUP BY 1",
    "run_summary": f"WITH {_T} SELECT (SELECT count(*) FROM documents) AS n_records, CAST(0 AS BIGINT) AS n_failed, count(*) AS n_triples FROM t",
}
