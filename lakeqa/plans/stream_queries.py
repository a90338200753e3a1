"""Queries of sources, sinks and streams: tables go through files in the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeqa.operators import corpus
from lakeqa.plans.answer_queries import ORACLES as BATCH
from lakeqa.plans.answer_queries import cached
from lakeqa.plans.feeds import LOGS, logs, place, table
from lakeqa.sources import tables as s
from lakeqa.streaming import jobs as j

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def stream_of(spark, df, order: str, rows: int = 500_000, least: int = 3):
    """df as a stream of files in order, some rows a file at most, a file a micro-batch.

    All files are written at once by range; a stream reads files by their time, so each gets the time of its place.
    """
    path = place(spark, "stream")
    files = max(least, -(-df.count() // rows))
    df.repartitionByRange(files, order).write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((str(s.getPath().getName()), s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for i, (_, part) in enumerate(parts):
        fs.setTimes(part, 1_000_000_000_000 + 1000 * i, -1)
    return j.replay(spark, path, df.schema)


def to_table(spark, stream, keys=None):
    return j.run_to_table(stream, place(spark, "table"), place(spark, "checkpoint"), keys)


@query("stream_rate_limit", BATCH["rate_limit"])
def _(spark, sf):
    return to_table(spark, j.stream_rate_limit(stream_of(spark, logs(spark, sf), "created_at"), 2, 43_200.0))


@query("stream_answer_cache", BATCH["answer_cache_replay"].replace("SELECT id, key AS cache_key, outcome, cost FROM r", "SELECT id, key AS cache_key, outcome FROM r"))
def _(spark, sf):
    return to_table(spark, j.stream_answer_cache(stream_of(spark, cached(spark, sf), "created_at"), "60 days"))


@query("stream_daily_counts", f"WITH {LOGS} SELECT created_at::DATE AS day, count(*) AS requests, count(*) >= 330 AS capped FROM logs GROUP BY ALL")
def _(spark, sf):
    return to_table(spark, j.stream_daily_counts(stream_of(spark, logs(spark, sf), "created_at"), 330, "30 days"), ["day"])


@query("stream_request_stats", BATCH["windowed_stats"])
def _(spark, sf):
    return to_table(spark, j.stream_request_stats(stream_of(spark, logs(spark, sf), "created_at"), "1 hour", "30 days"), ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def manifest(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("document_id"), F.lit("Acme").alias("company"), F.concat(F.lit("SRC"), (F.col("page_id") % 5).cast("string")).alias("ticker"), F.lit("10-K").alias("form_type"), F.lit("2024-01-01").cast("date").alias("filing_date"), F.concat("url", F.lit(" "), F.col("page_id").cast("string")).alias("source_path")
    )


@query("stream_ingest")
def _(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat("url", F.lit(" "), F.col("page_id").cast("string")).alias("source_path"), "html")
    path = place(spark, "corpus")
    j.stream_ingest(stream_of(spark, pages.withColumn("page_id", F.element_at(F.split("source_path", " "), -1).cast("long")), "page_id", least=2), manifest(spark, sf), path, place(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read_corpus(spark, path)[1].select("document_id", "chunk_index", "section", "content")


@query("read_manifest", "SELECT 'Acme' AS company, 'SRC' || (page_id % 5) AS ticker, url || ' ' || page_id AS source_path, DATE '2024-01-01' AS filing_date FROM pages")
def _(spark, sf):
    path = place(spark, "manifest")
    rows = manifest(spark, sf).drop("document_id")
    # the object form: a file for each block of a hundred filings of a ticker
    block = F.floor(F.split("source_path", " ").getItem(1).cast("long") / 500)
    rows.groupBy("ticker", block.alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("filings")).select("filings").write.option("maxRecordsPerFile", 1).json(path)
    return s.read_manifest(spark, path).select("company", "ticker", "source_path", "filing_date")


@query("read_golden", "SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN [] WHEN item_id % 3 = 1 THEN [text] ELSE [text, 'x'] END AS evidence_snippet FROM benchmark")
def _(spark, sf):
    path, i = place(spark, "golden"), F.col("item_id")
    b = table(spark, sf, "benchmark").select(i.cast("string").alias("id"), F.col("text").alias("question"), F.col("text").alias("cut"), (i % 3).alias("k"))
    b.filter("k = 1").select("id", "question", F.col("cut").alias("evidence_snippet")).write.option("maxRecordsPerFile", 1).json(path)
    b.filter("k = 2").select("id", "question", F.array("cut", F.lit("x")).alias("evidence_snippet")).write.mode("append").option("maxRecordsPerFile", 1).json(path)
    b.filter("k = 0").select("id", "question").write.mode("append").option("maxRecordsPerFile", 1).json(path)
    return s.read_golden(spark, path).select("id", "question", "evidence_snippet")


@query("write_corpus", "SELECT page_id AS document_id, 'SRC' || (page_id % 5) AS ticker, url || ' ' || page_id AS source_path, 0 AS chunk_index, html AS content FROM pages")
def _(spark, sf):
    path, m = place(spark, "corpus"), manifest(spark, sf)
    html = table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("content"))
    s.write_corpus(m, m.select("document_id", "ticker", F.lit(0).alias("chunk_index")).join(html, "document_id"), path)
    docs, chunks = s.read_corpus(spark, path)
    return docs.join(chunks.select("document_id", "chunk_index", "content"), "document_id").select("document_id", "ticker", "source_path", "chunk_index", "content")


@query("read_raw_html", "SELECT page_id, replace(html, chr(10), ' ') AS html FROM pages")
def _(spark, sf):
    path = place(spark, "html")
    pages = table(spark, sf, "pages")
    # a file for each page, named by a folder of its id
    pages.select("page_id", F.regexp_replace("html", "\n", " ").alias("value")).write.partitionBy("page_id").text(path)
    raw = s.read_raw_html(spark, f"{path}/*/*.txt")
    return raw.select(F.regexp_extract("source_path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), F.regexp_replace("html", "\n", "").alias("html"))


@query("eval_run_files", "SELECT 'bm25' AS mode, item_id AS query_id, 'numeric' AS type, CASE WHEN item_id % 3 <> 0 THEN (1 + item_id % 7)::INT END AS rank FROM benchmark")
def _(spark, sf):
    path, i = place(spark, "eval"), F.col("item_id")
    ranks = table(spark, sf, "benchmark").select(F.lit("bm25").alias("mode"), i.alias("query_id"), F.lit("numeric").alias("type"), F.when(i % 3 != 0, (1 + i % 7).cast("int")).alias("rank"))
    from lakeqa.operators.retrieval import retrieval_metrics

    s.write_eval_run(retrieval_metrics(ranks, "mode").drop("missed"), ranks, path)
    return s.read_eval_run(spark, path)[1]


@query("append_query_log", f"WITH {LOGS} SELECT id, created_at, status_code FROM logs")
def _(spark, sf):
    path, rows = place(spark, "log"), logs(spark, sf)
    s.append_query_log(rows.filter("id % 2 = 0"), path)
    s.append_query_log(rows.filter("id % 2 = 1"), path)
    return spark.read.parquet(path).select("id", "created_at", "status_code")


@query("empty_filings", "SELECT page_id AS document_id FROM pages WHERE page_id % 3 = 0")
def _(spark, sf):
    m = manifest(spark, sf)
    return corpus.empty_filings(m, m.filter("document_id % 3 <> 0")).select("document_id")
