"""One file a record: JSON, GraphML and HTML, written by the executors that hold the rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page import network_parts, text_head

FIELDS = ("head", "relation", "tail", "inference", "justification")


def triples_json(triples: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(record_id, json): each record's triples as a JSON array in their order, nulls kept; with records, an empty array for each of them that has no triples."""
    columns = [F.col(c) if c in triples.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]
    rows = triples.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*columns).alias("t")))).alias("rows"))
    listed = rows.select("record_id", F.to_json(F.transform("rows", lambda r: r["t"]), {"ignoreNullFields": "false"}).alias("json"))
    if records is None:
        return listed
    return records.select("record_id").distinct().join(listed, "record_id", "left").select("record_id", F.coalesce("json", F.lit("[]")).alias("json"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, xml): each record's graph as a directed GraphML document."""

    def text(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    node = F.concat(F.lit('    <node id="'), text(F.col("node")), F.lit('"/>\n'))
    data = F.concat(F.lit('<data key="relation">'), text(F.coalesce("relation", F.lit(""))), F.lit('</data><data key="inference">'), text(F.coalesce("inference", F.lit(""))), F.lit("</data>"))
    edge = F.concat(F.lit('    <edge source="'), text(F.col("src")), F.lit('" target="'), text(F.col("dst")), F.lit('">'), data, F.lit("</edge>\n"))
    joined = lambda part, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("s")))), lambda r: r["s"]), "")
    left = nodes.groupBy("record_id").agg(joined(node, "node_seq").alias("n"))
    right = edges.groupBy("record_id").agg(joined(edge, "edge_seq").alias("e"))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>\n  <key id="inference" for="edge" attr.name="inference" attr.type="string"/>\n  <graph edgedefault="directed">\n'
    return left.join(right, "record_id", "left").select("record_id", F.concat(F.lit(head), "n", F.coalesce("e", F.lit("")), F.lit("  </graph>\n</graphml>\n")).alias("xml"))


def network_pages(elements: DataFrame, dark: bool = False, layout: str = "spring") -> DataFrame:
    """(record_id, html): a page that draws each record's elements, which are JSON; built in columns."""
    title = F.col("record_id")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(raw), F.lit(safe))
    a, b, c, d = map(F.lit, network_parts(dark, layout))
    return elements.select("record_id", F.concat(a, title, b, title, c, F.replace("elements", F.lit("<"), F.lit("\\u003c")), d).alias("html"))


def text_pages(records: DataFrame, triples: DataFrame, spans: DataFrame, dark: bool = False) -> DataFrame:
    """(record_id, html): a page of each record's text with its spans marked and its counts of distinct entities and of triples; a placeholder where there is nothing to mark."""
    listed = spans.groupBy("record_id").agg(F.collect_list(F.struct("start", "end", "class", "description")).alias("spans"))
    names = triples.select("record_id", F.explode(F.array("head", "tail")).alias("name")).groupBy("record_id").agg(F.countDistinct("name").alias("entities"))
    counts = triples.groupBy("record_id").agg(F.count("*").alias("triples")).join(names, "record_id", "left")
    rows = records.select("record_id", "text").join(listed, "record_id", "left").join(counts, "record_id", "left")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [
                text_page(r.record_id, r.text or "", [(s["start"], s["end"], s["class"], s["description"] or "") for s in (r.spans if r.spans is not None else [])], int(r.entities), int(r.triples), dark)
                for r in batch.itertuples()
            ]
            yield pd.DataFrame({"record_id": batch["record_id"], "html": pages})

    return rows.na.fill(0, ["entities", "triples"]).mapInPandas(made, "record_id string, html string")


def text_page(record_id: str, text: str, spans: list[tuple[int, int, str, str]], entities: int = 0, triples: int = 0, dark: bool = False) -> str:
    """A page of a text with its entities marked: spans are (start, end, class, description); of overlapping ones the first counts."""
    head = text_head(record_id, entities, triples, dark)
    if not text or not triples:
        return f"{head}<main><p>No text or no triples.</p><p>{escape(text)}</p></main>\n"
    if not spans:
        return f"{head}<main><p>No entities found in the text.</p><p>{escape(text)}</p></main>\n"
    out, at = [], 0
    for start, end, kind, about in sorted(spans):
        if start >= at:
            out += [escape(text[at:start]), f'<mark class={quoteattr(kind)} title={quoteattr(about)} style="background:hsl({crc32(kind.encode()) % 360} 70% 80%);color:#111">{escape(text[start:end])}</mark>']
            at = end
    body = "".join(out) + escape(text[at:])
    return f"{head}<main><p>{body}</p></main>\n"


def write_files(rows: DataFrame, folder: str, ending: str) -> None:
    """Writes the second column of rows to a file for each record_id in folder, which all executors see; names are percent-encoded."""
    os.makedirs(folder, exist_ok=True)

    def written(part: Iterator) -> None:
        for name, content in part:
            target = os.path.join(folder, quote(name, safe="") + ending)
            with open(f"{target}.part", "w", encoding="utf-8") as file:
                file.write(content)
            os.replace(f"{target}.part", target)  # a repeated task leaves the same whole file

    rows.foreachPartition(written)
