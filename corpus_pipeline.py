"""A corpus pipeline of training-data operators: each stage takes what its predecessor kept.

Language identification drops documents without a language; of each group of near copies one document stays;
personal data is masked; sources are mixed to their targets, with repeats and one cut document a source; and
the mix is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.llm import byte_bpe, language_id, mixing, ngram_join, pii
from tripleforge.llm.common import DOCUMENT_COLUMNS, materialize, read_table

#: Documents whose best language has a lower score go; the scores of all languages add up to 1.
LEAST_SCORE = 0.4


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which stands in lang where that was null; those without a letter or a clear language go."""
    found = language_id.identify(_documents(docs), language_id.fit(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _documents(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles with a similarity of 0.8 or more connect, the one with the smallest doc_id."""
    return ngram_join.keep_first(_documents(docs), k=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(_documents(docs), pii.fit_field(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each time that it is taken whole, and once more with its first words where it is taken in part."""
    return mixing.mixed_documents(_documents(docs), DOCUMENT_COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document of the mix."""
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("PII", pii_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]
#: No SQL has the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's documents written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
