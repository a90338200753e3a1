"""Streaming forms: ingest of new filings, request counters, rate limits and the answer cache."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lakeqa.operators.corpus import build_corpus
from lakeqa.operators.logs import TTL_ANSWER, allowed, daily_request_counts, replayed, windowed_stats
from lakeqa.sources.tables import write_corpus

#: Buckets that the keys of a stream with state are dealt to.
BUCKETS = 1024


def stream_ingest(pages: DataFrame, manifest: DataFrame, path: str, checkpoint: str):
    """Append the corpus of new filings under path. pages: stream of source_path, html; a filing is loaded once.

    Each micro-batch leaves out what others have loaded and is written under a name made of the checkpoint and its number,
    so one that runs again after a failure writes the same again.
    """

    def batch(frame: DataFrame, number: int) -> None:
        spark, name = frame.sparkSession, f"b{zlib.crc32(checkpoint.encode()):08x}-{number}"
        try:
            loaded = spark.read.parquet(f"{path}/documents").filter(F.col("batch") != name).select("source_path")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            loaded = spark.createDataFrame([], "source_path string")
        fresh = manifest.join(frame.select("source_path").distinct(), "source_path", "left_semi")
        fresh = fresh.join(loaded, "source_path", "left_anti")
        write_corpus(fresh, build_corpus(fresh, frame.dropDuplicates(["source_path"])), path, name)

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def _instant() -> Column:
    """Event time: watermarks need a timestamp with a zone."""
    return F.col("created_at").cast("timestamp").alias("created_at")


def stream_daily_counts(logs: DataFrame, cap: int = 200, watermark: str = "1 hour") -> DataFrame:
    return daily_request_counts(logs.withColumn("created_at", _instant()), cap, watermark)


def stream_request_stats(logs: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    return windowed_stats(logs.withColumn("created_at", _instant()), width, watermark)


def _by_bucket(requests: DataFrame, key: str, decide: Callable[[tuple, list[float]], tuple[object, list[float]]], seconds: float, out: str, watermark: str, buckets: int) -> DataFrame:
    """id, key and what ``decide`` says of each request (its time in seconds and its further columns) by what is kept of its key.

    A call of Python and a row of state are a bucket of keys, not a key: keys have a few rows a micro-batch, so a call for each
    would cost more than its rows. A bucket's state has what is kept of its keys, and until when; a key without rows in a
    micro-batch leaves it when the watermark is past that.
    """

    def update(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, until, told = {}, {}, []
        if state.exists:
            keys, values, ends = state.get
            kept, until = dict(zip(keys, values, strict=True)), dict(zip(keys, ends, strict=True))
        now = state.getCurrentWatermarkMs()
        fresh = {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["created_at", "id"], kind="stable")
            times = (rows["created_at"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
            for k, *row in zip(rows[key].tolist(), times, *(rows[c].tolist() for c in rows.columns[4:]), strict=True):
                said, kept[k] = decide(row, kept.get(k, []))
                told.append(said)
                fresh[k] = int(1000 * (row[0] + seconds)) + 1
            yield pd.DataFrame({"id": rows["id"], key: rows[key], out.split()[0]: told})
        until |= fresh
        left = [k for k in kept if k in fresh or until[k] >= now]
        if left:
            state.update((left, [list(kept[k]) for k in left], [until[k] for k in left]))
            state.setTimeoutTimestamp(max(now + 1, min(until[k] for k in left)))
        else:
            state.remove()

    rows = requests.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), "id", key, _instant(), *(c for c in requests.columns if c not in ("id", key, "created_at")))
    kind = dict(requests.dtypes)[key]
    grouped = rows.withWatermark("created_at", watermark).groupBy("bucket")
    return grouped.applyInPandasWithState(update, f"id long, {key} {kind}, {out}", f"keys array<{kind}>, kept array<array<double>>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_rate_limit(requests: DataFrame, per: int = 10, seconds: float = 60.0, watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """id, ip, allowed for a stream of requests (id, ip, created_at). Within a micro-batch rows are taken by time, across batches as they come.

    A key's state is at most per times; it is dropped when the watermark is past the key's window. Later rows are dropped.
    """

    def decide(row: tuple, slots: list[float]) -> tuple[bool, list[float]]:
        (ok,), slots = allowed([row[0]], slots, per, seconds)
        return ok, slots

    return _by_bucket(requests.select("id", "ip", "created_at"), "ip", decide, seconds, "allowed boolean", watermark, buckets)


def stream_answer_cache(requests: DataFrame, watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """id, cache_key, outcome for a stream of requests (id, cache_key, created_at, cacheable, refused). State: when the kept answer expires.

    Once the watermark is past that, the state is dropped and a later request counts as a miss, not as expired.
    """

    def decide(row: tuple, kept: list[float]) -> tuple[str, list[float]]:
        (outcome,), expires = replayed([tuple(row)], kept[0] if kept else None)
        return outcome, [] if expires is None else [expires]

    return _by_bucket(requests.select("id", "cache_key", "created_at", "cacheable", "refused"), "cache_key", decide, TTL_ANSWER, "outcome string", watermark, buckets)


def replay(spark, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """All that a bounded stream yields, as a Parquet table under path.

    keys: of an aggregate, whose rows change. Each micro-batch writes the rows that changed in it, and the newest row of
    each key counts.
    """
    spark = stream.sparkSession
    if keys is None:
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def batch(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/number={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("number", LongType())])).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "number").alias("row"))
    return newest.select("row.*")
