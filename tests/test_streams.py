"""Streams with keyed state: buckets of keys, against one request after another."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lakeqa.operators import logs
from lakeqa.streaming import jobs

DAY = 86_400.0


def streamed(spark, tmp_path, batches, schema, job):
    """Rows that a job yields over micro-batches, and the most rows of state that it had."""
    seen = set()
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).withColumn("created_at", F.timestamp_seconds(F.col("at") + 1_000_000_000)).drop("at")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (new,) = set((tmp_path / "in").glob("part-*")) - seen  # a stream reads files by their time
        os.utime(new, (1_000_000_000 + i, 1_000_000_000 + i))
        seen.add(new)
    source = jobs.replay(spark, str(tmp_path / "in"), frame.schema)
    query = job(source).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    states = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    return spark.read.parquet(str(tmp_path / "out")).collect(), states


def test_state_is_by_bucket(spark, tmp_path):
    """Thousands of keys with a row or two a micro-batch are some buckets of state; one key is null."""
    random.seed(8)
    rows = [(i, None if i % 50 == 0 else f"k{random.randrange(1500)}", i * 97.0, random.random() < 0.7, random.random() < 0.5) for i in range(4500)]
    batches = [rows[a : a + 1500] for a in range(0, 4500, 1500)]
    got, states = streamed(spark, tmp_path, batches, "id long, cache_key string, at double, cacheable boolean, refused boolean", lambda s: jobs.stream_answer_cache(s, "60 days", buckets=16))
    kept, want = {}, {}
    for i, key, at, fit, refused in rows:
        (want[i],), kept[key] = logs.replayed([(at, fit, refused)], kept.get(key))
    assert {r.id: r.outcome for r in got} == want and {r.id: r.cache_key for r in got} == {r[0]: r[1] for r in rows}
    assert states <= 16


def test_limits_by_bucket(spark, tmp_path):
    random.seed(9)
    rows = [(i, None if i % 40 == 0 else random.choice(["hot", f"k{random.randrange(400)}"]), i * 7.0) for i in range(1800)]
    got, states = streamed(spark, tmp_path, [rows[a : a + 600] for a in range(0, 1800, 600)], "id long, ip string, at double", lambda s: jobs.stream_rate_limit(s, 2, 60.0, buckets=8))
    slots, want = {}, {}
    for i, ip, at in rows:
        (want[i],), slots[ip] = logs.allowed([at], slots.get(ip, []), 2, 60.0)
    assert {r.id: r.allowed for r in got} == want and len(got) == 1800
    assert states <= 8


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_leave_one_by_one(spark, tmp_path, buckets):
    """A key without rows leaves its bucket when the watermark is past its time; one with rows in that micro-batch is kept."""
    first = [(1, "back", 0.0, True, False), (2, "late", 0.0, True, False)]
    batches = [first, [(3, "other", 10 * DAY, True, False)], [(4, "back", 10 * DAY + 1, True, False)], [(5, "late", 10 * DAY + 2, True, False), (6, "back", 10 * DAY + 3, True, False)]]
    got, _ = streamed(spark, tmp_path, batches, "id long, cache_key string, at double, cacheable boolean, refused boolean", lambda s: jobs.stream_answer_cache(s, buckets=buckets))
    assert {r.id: r.outcome for r in got} == {1: "miss", 2: "miss", 3: "miss", 4: "expired", 5: "miss", 6: "hit"}
