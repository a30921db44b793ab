"""Corpus preparation: quality filter, near-duplicate removal, benchmark
decontamination, secret masking and source mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's rows as Parquet into the shared folder and hands the
reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import decontaminate, minhash_dedup, mixing, quality, secrets
from shelfcast.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all columns. Null and empty texts are
    scored like others; repeated rows go or stay together; without any label all
    rows stay; an empty table stays empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the smallest doc_id). Null and
    empty texts are linked with nothing and stay; rows without doc_id are documents of
    their own; of rows with the same doc_id and text one stays, the same on every run."""
    return minhash_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; repeated rows go
    or stay together; with an empty benchmark all rows stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials cut out of their texts; rows without one, null and empty
    texts are unchanged."""
    return secrets.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (0: nothing), one row per row. Null and empty
    texts have size 0; a null source is a source of its own, the last one."""
    return mixing.mix(docs)


STAGES = [("quality_classifier", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark),
          ("secret_scan", without_secrets), ("source_mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Stages 1, 3 and 5 are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None
