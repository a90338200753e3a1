"""How the driver's tables stand for chunks, questions, answers and logs: as DataFrames, and the same as SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeqa.functions import text as t
from lakeqa.operators.retrieval import Index, read_index, write_index
from lakeqa.operators.routing import cell_of
from lakeqa.operators.tables import kept, place  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id, document_id, ticker, filing_date, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.upper("source").alias("ticker"),
        F.make_date(F.lit(2024) + F.pmod("doc_id", F.lit(3)).cast("int"), F.lit(1), F.lit(1)).alias("filing_date"),
        F.col("text").alias("content"),
    )


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, doc_id AS document_id, upper(source) AS ticker,
  make_date(2024 + (doc_id % 3)::INT, 1, 1) AS filing_date, text AS content FROM documents)"""


def version(spark: SparkSession, path: str) -> str:
    """A name for the files under a path as they are now: changes with any file's name, length or time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [at] if fs.getFileStatus(at).isFile() else [x.getPath() for x in fs.listStatus(at)]
    known = sorted((str(x), y.getLen(), y.getModificationTime()) for x in files for y in [fs.getFileStatus(x)])
    return hashlib.sha256(repr(known).encode()).hexdigest()[:20]


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The BM25 index of the chunks, with a cell for each filing; written once for a version of their table."""
    path = f"{place(spark, '').rsplit('/', 1)[0]}/index-{version(spark, f'{sf_dir}/documents.parquet')}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/size/_SUCCESS")  # what is written last
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return read_index(spark, path)
    c = chunks(spark, sf_dir)
    return write_index(c.select("chunk_id", "content", cell_of("ticker", "filing_date").alias("cell")), path)


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as golden entries: query_id, question (the whole item), snippet (60 characters), type, snippets."""
    b = table(spark, sf_dir, "benchmark")
    kind = F.when(F.col("item_id") % 10 == 9, "not_found").when(F.col("item_id") % 2 == 0, "numeric").otherwise("narrative")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.left("text", F.lit(60)).alias("snippet"),
        kind.alias("type"),
    )


GOLDEN = """golden AS (SELECT item_id AS query_id, text AS question, left(text, 60) AS snippet,
  CASE WHEN item_id % 10 = 9 THEN 'not_found' WHEN item_id % 2 = 0 THEN 'numeric' ELSE 'narrative' END AS type FROM benchmark)"""


def piece_count() -> Column:
    """How many pieces a document has."""
    return 1 + F.greatest(F.lit(0), F.floor((F.length("text") - 151) / 650).cast("int"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a fixed stride: piece k of a document has 800 characters from 650 k on. document_id, chunk_index, content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), piece_count() - 1)).alias("chunk_index"))
    return d.select(F.col("doc_id").alias("document_id"), "chunk_index", F.substr("text", 650 * F.col("chunk_index") + 1, F.lit(800)).alias("content"))


PIECES = """pieces AS (SELECT doc_id AS document_id, i::INT AS chunk_index, substring(text, 650 * i + 1, 800) AS content
  FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, (length(text) - 151) // 650))) AS i FROM documents))"""


def tokens_sql(text: str) -> str:
    """DuckDB SQL of ``tokenize``."""
    stop = ", ".join(f"'{w}'" for w in t.STOPWORDS)
    plain = f"replace(replace(lower({text}), '’', ''''), '''s', '')"
    singular = f"list_transform(regexp_extract_all({plain}, '[a-z0-9]+'), lambda x: CASE WHEN length(x) > 3 AND right(x, 1) = 's' THEN left(x, length(x) - 1) ELSE x END)"
    return f"list_filter({singular}, lambda x: length(x) > 1 AND x NOT IN ({stop}))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: answer_id, question (the user's turn before), answer with marks appended by conv_id % 5."""
    c = table(spark, sf_dir, "conversations")
    a, q = c.filter("role = 'assistant'"), c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    k = F.col("conv_id") % 5
    tail = F.when(k == 0, " [1][2]").when(k == 1, F.lit(" of 1,234.5 in 2024 [1, 3]")).when(k == 2, F.lit(" up 12% – see [2]")).when(k == 3, F.lit(""))
    text = F.when(k == 4, F.lit("** I could not find this in the provided filings.**")).otherwise(F.concat("text", tail))
    a = a.select("conv_id", "turn", text.alias("answer")).join(q, ["conv_id", "turn"], "left")
    return a.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "question", "answer")


ANSWERS = """answers AS (SELECT a.conv_id * 1000 + a.turn AS answer_id, a.conv_id, q.text AS question,
  CASE a.conv_id % 5 WHEN 0 THEN a.text || ' [1][2]' WHEN 1 THEN a.text || ' of 1,234.5 in 2024 [1, 3]' WHEN 2 THEN a.text || ' up 12% – see [2]'
    WHEN 3 THEN a.text ELSE '** I could not find this in the provided filings.**' END AS answer
  FROM conversations a LEFT JOIN conversations q ON q.role = 'user' AND q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE a.role = 'assistant')"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of requests: id, created_at, ip, question, status_code, refused, error, cost, total_ms, retrieval_ms."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("ip"),
        F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("question"),
        F.when(failed, 500).otherwise(200).alias("status_code"),
        F.when(failed, F.lit(None)).otherwise(F.col("event_type") == "signup").cast("boolean").alias("refused"),
        F.when(failed, F.concat(F.lit("failed event "), F.col("event_id").cast("string"))).alias("error"),
        F.get_json_object("props", "$.k").cast("double").alias("cost"),
        F.floor(F.col("value") * 100).cast("long").alias("total_ms"),
        F.floor(F.col("value") * 40).cast("long").alias("retrieval_ms"),
    )


LOGS = """logs AS (SELECT event_id AS id, ts AS created_at, user_id::VARCHAR AS ip, event_type || ' ' || user_id AS question,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CASE WHEN event_type <> 'error' THEN event_type = 'signup' END AS refused,
  CASE WHEN event_type = 'error' THEN 'failed event ' || event_id END AS error, json_extract_string(props, '$.k')::DOUBLE AS cost,
  floor(value * 100)::BIGINT AS total_ms, floor(value * 40)::BIGINT AS retrieval_ms FROM events)"""
