"""Records and triples from JSONL, JSON, CSV, Parquet and GraphML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_ocr

TRIPLE = "struct<head:string,relation:string,tail:string,inference:string,justification:string>"
FORMATS = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".parquet": "parquet"}


class DataLoadError(Exception):
    """Data that cannot be read: where, and in which line if that is known."""

    def __init__(self, message: str, path: str, line_number: int | None = None) -> None:
        super().__init__(f"{message} ({path}{'' if line_number is None else f', line {line_number}'})")
        self.path, self.line_number = path, line_number


def detect_format(path: str) -> str:
    """The format that a path's ending names, in any case."""
    name = path.rstrip("/").lower()
    for ending, kind in FORMATS.items():
        if name.endswith(ending):
            return kind
    raise DataLoadError("unsupported format", path)


def _line_of(spark: SparkSession, path: str, bad: str) -> tuple[str, int | None]:
    """The file of path and the line in it, from 1, where bad first stands: two counts over the lines, of which none comes to the driver."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(place.alias("at"), "value")
    first = lines.where(F.trim("value") == F.trim(F.lit(bad))).agg(F.min("at")).first()[0]
    if first is None:
        return path, None
    before = lines.where((F.col("at.file") == first.file) & ((F.col("at.block") < first.block) | ((F.col("at.block") == first.block) & (F.col("at.n") < first.n))))
    return first.file if first.file.rstrip("/").split("/")[-1] != path.rstrip("/").split("/")[-1] else path, before.count() + 1


def clean_ocr_jsonl(spark: SparkSession, path: str, output: str | None = None, fields: Sequence[str] = ("text", "reasoning", "title")) -> str:
    """Repairs the broken words in fields of a JSONL file or folder and writes it as a JSONL folder: all fields, nulls and order kept; the folder's name, by default path with .cleaned.jsonl for its ending."""
    output = output or f"{path.rstrip('/').rsplit('.', 1)[0]}.cleaned.jsonl"
    rows = read_table(spark, path)
    kinds = dict(rows.dtypes)
    done = rows.withColumns({c: clean_ocr(F.col(c)) for c in fields if kinds.get(c) == "string"})
    done.write.mode("overwrite").option("ignoreNullFields", "false").json(output)
    return output


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file or folder, by its format."""
    kind = detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")
    if kind == "json":
        first = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.substring(F.regexp_replace("value", r"^[\s﻿]+", ""), 1, 1).alias("c")).where("c <> ''").first()
        if first is None or first[0] != "[":
            raise DataLoadError("the top level must be an array", path)
        return spark.read.json(path, multiLine=True)
    rows = spark.read.option("columnNameOfCorruptRecord", "_bad").json(path)
    if "_bad" in rows.columns:
        rows = rows.cache()
        bad = rows.where("_bad IS NOT NULL").select("_bad").first()
        if bad:
            raise DataLoadError("invalid JSON", *_line_of(spark, path, bad[0]))
        rows = rows.drop("_bad")
    return rows


def _places(rows: DataFrame) -> list[Column]:
    """What orders rows as they stand in their files, these by name; rows of no file come as their partitions do. Spark reads larger files first."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    try:
        rows.select(*place).schema  # noqa: B018
    except AnalysisException:
        place = []
    return [*place, F.monotonically_increasing_id()]


def load_records(rows: DataFrame, text_field: str = "text", id_field: str = "id", record_ids: Sequence[str] | None = None, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """rows with record_id and text: those of record_ids (none: all), the first limit of them (0 or none: all) by the field order_by, nulls last, or else in the order of their files.

    Ids compare as strings. A missing field is an error; other columns stay.
    """
    for field in (text_field, id_field, *([order_by] if order_by else [])):
        if field not in rows.columns:
            raise DataLoadError(f"no field {field!r}", "records")
    kept = rows
    if record_ids:
        kept = kept.where(F.col(id_field).cast("string").isin([str(x) for x in record_ids]))
    if limit:
        places = {f"_place{i}": c for i, c in enumerate(_places(rows))}
        kept = kept.withColumns(places).orderBy(*[F.col(c).asc_nulls_last() for c in ([order_by] if order_by else [])], *places).limit(limit).drop(*places)
    others = [c for c in rows.columns if c not in ("record_id", "text")]
    return kept.select(F.col(id_field).cast("string").alias("record_id"), F.col(text_field).cast("string").alias("text"), *others)


def _stem(ending: str) -> Column:
    """The record that a file's name stands for: the name is escaped once by the scan and once by the writers; other names stay as they are."""
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = decoded(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{ending}$", 1))
    return F.coalesce(decoded(name), name)


def read_triples(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, seq, triple fields) from a folder with a JSON array for each record; files that hold none are left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(_stem("json").alias("record_id"), F.try_parse_json("value").alias("v"))
    listed = files.where(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))).select("record_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("seq", "item"))
    fields = [F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in ("head", "relation", "tail", "inference", "justification")]
    return listed.select("record_id", "seq", *fields)


_GRAPHML = "key array<struct<_id:string,`_attr.name`:string>>, graph struct<node:array<struct<_id:string>>,edge:array<struct<_source:string,_target:string,data:array<struct<_key:string,_VALUE:string>>>>>"


def read_graphml(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder of GraphML files: nodes (record_id, node_seq, node), edges (record_id, edge_seq, src, dst, relation, inference).

    Each edge is read as an element of its own. An attribute's key is the one that a key element gives its
    name, or else the name itself; an edge without the attribute has null, one with an empty value an empty
    string. Attributes that are meant for nodes and edges alike may share a name.
    """
    text = F.regexp_replace("value", r"\s+xmlns(:\w+)?=\"[^\"]*\"|\s+xsi:[\w]+=\"[^\"]*\"", "")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.graphml").select(_stem("graphml").alias("record_id"), F.from_xml(text, _GRAPHML, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}).alias("x"))
    nodes = files.select("record_id", F.posexplode("x.graph.node").alias("node_seq", "n")).select("record_id", "node_seq", F.col("n._id").alias("node"))
    edges = files.select("record_id", F.col("x.key").alias("keys"), F.posexplode("x.graph.edge").alias("edge_seq", "e"))

    def attribute(name: str) -> Column:
        named = F.transform(F.filter(F.coalesce("keys", F.array().cast("array<struct<_id:string,`_attr.name`:string>>")), lambda k: k["_attr.name"] == name), lambda k: k["_id"])
        keys = F.concat(named, F.array(F.lit(name)))
        return F.get(F.transform(F.filter("e.data", lambda d: F.array_contains(keys, d["_key"])), lambda d: F.coalesce(d["_VALUE"], F.lit(""))), F.lit(0)).alias(name)

    return nodes, edges.select("record_id", "edge_seq", F.col("e._source").alias("src"), F.col("e._target").alias("dst"), attribute("relation"), attribute("inference"))
