"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns
the columns of ``documents``. Stages that run Python set the session's Arrow batches to BATCH_ROWS rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecweft.llm import exact_dedup, langid, near_dedup, packing, pii
from vecweft.llm.common import table, written


#: Rows that Python workers get at once in the pipeline: texts may be long.
BATCH_ROWS = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go."""
    _small_batches(spark)
    return langid.drop_rejected(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    _small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format, by the session's key."""
    _small_batches(spark)
    return pii.pseudonymise(docs, pii.session_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in training sequences."""
    _small_batches(spark)
    return packing.pack(docs, forget=True)


STAGES = [("language", language), ("exact copies", copies), ("near copies", near_copies), ("personal data", personal_data), ("packing", packed)]

#: Compression, MinHash, keyed permutations and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
