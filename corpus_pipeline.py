"""The corpus pipeline over `documents`: quality classifier, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. The first three return the columns of documents, the last the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railframe.llm import neardup, packing, quality, secrets
from railframe.llm.common import saved
from railframe.llm.queries import TOKENIZER, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    return quality.score(docs, model, into="__score").where("__score >= 0.5").select(*columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more): the one with the smallest doc_id."""
    return neardup.deduplicated(docs, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the kind in angle brackets, and n_chars counted anew."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [("quality_classifier", keep_good), ("near_duplicates", keep_first_copies), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]

#: Compression, MinHash and packing are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
