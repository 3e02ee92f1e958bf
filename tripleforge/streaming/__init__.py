"""Pipelines over a folder to which documents are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.triples import extract_by_rule, normalize


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, id_field: str = "doc_id", schema: str = "doc_id bigint, text string") -> StreamingQuery:
    """Rule triples of every Parquet file that comes to folder, appended to output; each file is taken once."""

    def batch(rows: DataFrame, _: int) -> None:
        records = rows.selectExpr(f"cast({id_field} AS string) AS record_id", "text")
        normalize(extract_by_rule(records)).write.mode("append").parquet(output)

    return spark.readStream.schema(schema).parquet(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
