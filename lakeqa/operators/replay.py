"""Replay of an answer cache over a log of requests, with hot keys spread over all tasks.

A request that finds a kept answer is a hit and changes nothing, so only fetches matter: each fetch points at the next
one, the first request of its key after its answer's expiry, or just the next request if its answer was not kept. The
fetches of a key are the chain of these pointers from its first request on.

1. Requests are range-sorted by key and time into slices of about ``ROWS``; a hot key covers many slices. Of each slice
   the key and time of its first and last rows reach the driver.
2. Inside a slice, keys that begin there are followed from their first request. For the key that comes from the slice
   before, every request is followed to its end, the last fetch that it leads to in the slice, and from there to the
   slice in which the chain goes on.
3. So ends point at ends in later slices. Those that a key's first request leads to are found by doubling these pointers,
   in as many rounds as the logarithm of the slices that one key covers.
4. An end that is reached says where the chain enters a later slice, one place a slice; from there it is followed.

Keys inside one slice are done after step 2. No task holds more than a slice.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeqa.operators.tables import kept

#: Requests of a slice, about.
ROWS = 500_000
TTL_ANSWER, TTL_REFUSAL = 24 * 3600.0, 3600.0
#: Stands for the expiry of an answer that is not kept.
NEVER = -(2**63)
OUTCOMES = "id long, cache_key string, outcome string, cost double"


def pointers(us: np.ndarray, fit: np.ndarray, expires: np.ndarray) -> np.ndarray:
    """Of each request of a key, in order, the place of the next fetch after it; their number if that is behind them."""
    return np.where(fit, np.searchsorted(us, expires, side="right"), np.arange(1, len(us) + 1))


def ends(after: np.ndarray) -> np.ndarray:
    """Of each request the last fetch that it leads to, itself included."""
    n = len(after)
    to = np.where(after < n, after, np.arange(n))
    while (to[to] != to).any():
        to = to[to]
    return to


def follow(after: np.ndarray, fit: np.ndarray, entry: int, label: str) -> np.ndarray:
    """Outcomes of a key's requests; the first fetch is at entry and has the label."""
    out = np.full(len(after), "hit", object)
    while entry < len(after):
        out[entry] = label
        label, entry = "expired" if fit[entry] else "miss", int(after[entry])
    return out


class Path(NamedTuple):
    """The slices that one key covers, and its last time in each but the last."""

    slices: list[int]
    last: list[int]


def paths_of(edges: list) -> list[Path]:
    """Paths of the keys that cover several slices. edges: slice, first and last (at, cache_key, us), in order."""
    out: list[Path] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a.last.cache_key == b.first.cache_key:
            if not out or out[-1].slices[-1] != a.slice or a.first.cache_key != a.last.cache_key:
                out.append(Path([a.slice], []))
            out[-1].slices.append(b.slice)
            out[-1].last.append(a.last.us)
    return out


def _segments(rows: pd.DataFrame) -> list[pd.DataFrame]:
    """The rows of a slice in order, a frame for each key."""
    rows = rows.sort_values("at", ignore_index=True)
    keys = rows["cache_key"].to_numpy(object)
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _after(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    fit = rows["fit"].to_numpy(bool)
    return pointers(rows["us"].to_numpy(np.int64), fit, rows["expires"].to_numpy(np.int64)), fit


def _told(rows: pd.DataFrame, entry: int, label: str) -> pd.DataFrame:
    return rows[["id", "cache_key", "cost"]].assign(outcome=follow(*_after(rows), entry, label))[["id", "cache_key", "outcome", "cost"]]


def _begun(carried: frozenset, rows: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of the keys that begin in a slice."""
    parts = _segments(rows)[1 if int(rows["slice"].iloc[0]) in carried else 0 :]
    return pd.concat([_told(part, 0, "miss") for part in parts]) if parts else pd.DataFrame(columns=["id", "cache_key", "outcome", "cost"])


def _onward(paths: list[Path], rows: pd.DataFrame) -> pd.DataFrame:
    """end, slice, expires, label, starts: of the key that goes on behind a slice, the ends in it and the slice that each leads to."""
    number = int(rows["slice"].iloc[0])
    path = next(p for p in paths if number in p.slices[:-1])
    place, part = path.slices.index(number), _segments(rows)[-1]
    after, fit = _after(part)
    to = ends(after)
    found = to[:1] if place == 0 else np.unique(to)
    expires = np.where(fit[found], part["expires"].to_numpy(np.int64)[found], NEVER)
    slices = [path.slices[max(place + 1, bisect_right(path.last, int(e)))] for e in expires]
    return pd.DataFrame({"end": part["at"].to_numpy()[found], "slice": slices, "expires": expires, "label": np.where(fit[found], "expired", "miss"), "starts": place == 0})


def _linked(known: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """end, to, slice, entry, label, starts: where the ends of earlier slices enter a slice, and the ends that this leads to."""
    part = _segments(rows)[0] if len(rows) and len(known) else rows
    entry = np.searchsorted(part["us"].to_numpy(np.int64), known["expires"].to_numpy(np.int64), side="right")
    known, entry = known[entry < len(part)], entry[entry < len(part)]
    at, to = part["at"].to_numpy(), ends(_after(part)[0]) if len(part) else entry
    return known[["end"]].assign(to=at[to[entry]], slice=known["slice"], entry=at[entry], label=known["label"], starts=known["starts"])


def _entered(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of the key that comes from the slice before: all hits, or a chain from one place on."""
    part = _segments(rows)[0]
    if not len(entries):
        return _told(part, len(part), "hit")
    return _told(part, int(np.searchsorted(part["at"].to_numpy(), entries["entry"].iloc[0])), entries["label"].iloc[0])


def _reached(links: DataFrame, rounds: int) -> DataFrame:
    """end: the ends that keys' first requests lead to."""
    reached, jumps = links.filter("starts").select("end"), links.select("end", "to")
    for _ in range(rounds):
        reached = kept(reached.unionByName(reached.join(jumps, "end").select(F.col("to").alias("end"))).distinct())
        jumps = kept(jumps.join(jumps.select(F.col("end").alias("to"), F.col("to").alias("then")), "to").select("end", F.col("then").alias("to")))
    return reached


def answer_cache_replay(requests: DataFrame, answer_ttl: float = TTL_ANSWER, refusal_ttl: float = TTL_REFUSAL, rows: int = ROWS) -> DataFrame:
    """id, cache_key, outcome (hit, miss, expired) and the cost that is left of requests (id, cache_key, created_at, cacheable,
    refused, cost). A null key is a key like others; null cacheable and refused are false; equal times go by id."""
    ttl = F.when(F.coalesce("refused", F.lit(False)), refusal_ttl).otherwise(answer_ttl)
    us, fit = F.unix_micros(F.col("created_at").cast("timestamp")), F.coalesce("cacheable", F.lit(False))
    table = requests.select("id", "cache_key", us.alias("us"), fit.alias("fit"), (us + (ttl * 1_000_000).cast("long")).alias("expires"), F.col("cost").cast("double").alias("cost"))
    order = ["cache_key", "us", "id"]
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(table.count() / rows))
    table = table.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = kept(table.withColumns({"slice": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id()}), "requests")

    row = F.struct("at", "cache_key", "us")
    paths = paths_of(sorted(table.groupBy("slice").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect()))
    carried = sorted(s for p in paths for s in p.slices[1:])
    inner = frozenset(carried)
    told = table.groupBy("slice").applyInPandas(lambda x: _begun(inner, x), OUTCOMES)
    if paths:
        going = table.filter(F.col("slice").isin([s for p in paths for s in p.slices[:-1]]))
        found = going.groupBy("slice").applyInPandas(lambda x: _onward(paths, x), "end long, slice long, expires long, label string, starts boolean")
        inside = table.filter(F.col("slice").isin(carried))
        links = found.groupBy("slice").cogroup(inside.groupBy("slice")).applyInPandas(_linked, "end long, to long, slice long, entry long, label string, starts boolean")
        links = kept(links)
        entries = links.join(_reached(links, math.ceil(math.log2(max(len(p.slices) for p in paths)))), "end").select("slice", "entry", "label")
        told = told.unionByName(entries.groupBy("slice").cogroup(inside.groupBy("slice")).applyInPandas(_entered, OUTCOMES))
    return told.withColumn("cost", F.when(F.col("outcome") == "hit", 0.0).otherwise(F.col("cost")))
