"""What the training-data operators share: the folder for tables that cut lineage, words, and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage defines it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of its limit from which on the heap of the driver's JVM is tidied up after a table is written.
HEAP_SHARE = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where all run in one JVM."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tripleforge-shared"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage if its heap takes more than HEAP_SHARE of its limit.

    A job of many small tasks leaves the driver plans, task results and events, with which the heap else grows up
    to its limit and stays there. Collected, it shrinks to a few times what is in use, and the executors drop the
    broadcasts and shuffle files that nothing reads any more.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files that a materialized table is read from."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def materialized(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A materialized table that is deleted at the end: for what nothing reads after the block."""
    table = materialize(df, name)
    try:
        yield table
    finally:
        discard(table)


def bounded(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of about most bytes of a column of strings; a longer row is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def give_back() -> None:
    """Returns the memory that a worker has freed to the system, for workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum, so no
    component is ever gathered in one task; rounds go on until every component is a star round its smallest node,
    which one grouping of the nodes tells. Self loops give their node its own component. Each round is written to the shared folder, and the one before deleted. Empty edges give
    an empty result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # large star: every neighbour above a node links to the least of the node and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.select("a", F.col("m").alias("b"))).where("a >= b").distinct()
        # small star: a node and its lower neighbours link to the least of them
        low = large.where("a > b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        roots = large.where("a = b")
        before, now = now, materialize(small.union(roots).where("a >= b").distinct(), "cc")
        discard(before)
        # a node with two parents, or with a parent and a child, keeps its component from being a star
        links = now.where("a > b")
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
