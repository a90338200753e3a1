"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where that is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and (not sc.master.startswith("local") or sc.master.startswith("local-")):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any store, with all below."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables in the shared folder that lineage is cut with: later plans start there, and a lost executor costs no
    recomputation. Used with ``with``: at its end, also after a failure, all are deleted but the result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, new_path(spark, "tables"), 0

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)

    def cut(self, df: DataFrame) -> DataFrame:
        """df written once, and read from there."""
        self.n += 1
        return _stored(df, f"{self.path}/{self.n}")

    def result(self, df: DataFrame) -> DataFrame:
        """df written to a path of its own, which stays."""
        return _stored(df, new_path(self.spark, "result"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder, new for each call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def clear_of(df: DataFrame, *names: str) -> str:
    """A prefix such that no column of df starts with it: helper columns never clash with columns of the input."""
    prefix = "_h_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix
