"""Cache replay over slices and rate limits cut at pauses, against one request after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeqa.operators import logs, replay

SCHEMA = "id long, cache_key string, at double, cacheable boolean, refused boolean, cost double"


def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("created_at", F.timestamp_seconds("at")).drop("at")


def brute(rows, answer, refusal):
    out, kept = {}, {}
    for i, key, at, fit, refused, cost in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0])):
        (outcome,), kept[key] = logs.replayed([(at, bool(fit), bool(refused))], kept.get(key), answer, refusal)
        out[i] = (outcome, 0.0 if outcome == "hit" else cost)
    return out


@pytest.mark.parametrize("seed, fits", [(1, 0.9), (2, 0.5), (3, 0.0), (4, 1.0)])
def test_replay(spark, seed, fits):
    """One key holds most rows and covers most slices; others fit into one; times are tied; keys and flags are null at times."""
    random.seed(seed)
    keys = ["hot"] * 60 + ["warm"] * 20 + [None] * 5 + [f"k{i}" for i in range(15)]
    rows = [(i, random.choice(keys), float(random.randrange(4000)), random.choice([random.random() < fits, None if fits < 1 else True]), random.choice([True, False, None]), 2.0) for i in range(3000)]
    for n in (40, 3000):
        got = replay.answer_cache_replay(requests(spark, rows).repartition(3), 50.0, 7.0, rows=n)
        assert {r.id: (r.outcome, r.cost) for r in got.collect()} == brute(rows, 50.0, 7.0)


def test_replay_of_one_key(spark):
    """All slices are of one key: its rows lie in all tasks, and answers that last for many slices skip them."""
    rows = [(i, "k", float(i), True, i % 2 == 0, 1.0) for i in range(2000)]
    for answer in (3.0, 900.0, 1e6):
        got = replay.answer_cache_replay(requests(spark, rows), answer, answer, rows=50)
        assert {r.id: (r.outcome, r.cost) for r in got.collect()} == brute(rows, answer, answer)
    edges = requests(spark, rows).repartitionByRange(40, "created_at").groupBy(F.spark_partition_id()).count().collect()
    assert len(edges) > 20
    assert replay.answer_cache_replay(requests(spark, rows).limit(0)).collect() == []


def test_ends():
    after = np.array([2, 2, 4, 5, 9, 9, 9, 8, 9])
    assert replay.ends(after).tolist() == [4, 4, 4, 5, 4, 5, 6, 8, 8]
    assert replay.follow(after, np.array([True, False, True, True, False, True, True, True, True]), 0, "miss").tolist() == ["miss", "hit", "expired", "hit", "expired", "hit", "hit", "hit", "hit"]


def test_paths():
    from collections import namedtuple

    edge, row = namedtuple("edge", "slice first last"), namedtuple("row", "at cache_key us")
    made = lambda i, a, b, us: edge(i, row(0, a, 0), row(1, b, us))
    found = replay.paths_of([made(0, "a", "b", 5), made(1, "b", "b", 7), made(2, "b", "c", 9), made(4, "c", "d", 3), made(5, "e", "e", 4)])
    assert found == [replay.Path([0, 1, 2], [5, 7]), replay.Path([2, 4], [9])]


@pytest.mark.parametrize("seconds", [60.0, 7.5])
def test_rate_limit(spark, seconds):
    """A busy ip has many spells, which are keys of their own."""
    random.seed(5)
    ips = ["hot"] * 8 + ["a", None]
    at, rows = 0.0, []
    for i in range(1500):
        at += random.choice([0.0, 0.5, 1.0, 3.0, 30.0, seconds, seconds + 1e-6, 2 * seconds])
        rows.append((i, random.choice(ips), at))
    df = spark.createDataFrame(rows, "id long, ip string, at double").withColumn("created_at", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")))
    slots, want = {}, {}
    for i, ip, now in rows:
        (want[i],), slots[ip] = logs.allowed([round(now * 1e6) / 1e6], slots.get(ip, []), 3, seconds)
    assert {r.id: r.allowed for r in logs.rate_limit(df.repartition(4), 3, seconds).collect()} == want
    ticks = df.select("ip", F.floor(F.unix_micros("created_at") / F.lit(int(seconds * 1e6))).alias("tick"))
    assert logs.busy_spells(ticks, seconds).filter("ip = 'hot'").select("spell").distinct().count() > 10
