"""From raw documents to token ids in training order: five operators of ``lakeqa.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeqa.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from lakeqa.llm.common import new_path, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Not in SQL: near-duplicates and byte-level BPE are compared with brute force in the tests.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed, rejected documents go."""
    cleaned = quality.clean_documents(docs).filter("kept")
    return cleaned.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays."""
    return near_dedup.drop_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs.select("doc_id", "source", "text"), keep_ids=True)


STAGES = [("quality rules", clean), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix_sources), ("byte bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
