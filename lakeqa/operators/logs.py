"""Request logs: status, statistics, limits and cache replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeqa.operators.replay import TTL_ANSWER, TTL_REFUSAL
from lakeqa.operators.selection import exact_percentiles


def build_query_log(requests: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of the log: requests (request_id, question, error) with their answers and a summary of their chunks by rank."""
    chunk = F.struct("rank", F.struct("chunk_id", "ticker", "filing_date", "score").alias("c"))
    chunks = hits.groupBy("request_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    rows = requests.withColumnRenamed("error", "request_error").join(answers, "request_id", "left").join(chunks, "request_id", "left")
    return rows.select(
        "request_id",
        F.left("question", F.lit(2000)).alias("question"),
        F.left(F.coalesce("request_error", "error"), F.lit(500)).alias("error"),
        F.nullif("answer", F.lit("")).alias("answer"),
        F.transform("chunks", lambda x: x["c"]).alias("chunks"),
    )


def status_code(stage: Column, error: Column) -> Column:
    """500 if retrieval failed, 503 for errors of an unpaid account (402), 502 for others and crashes, else 200."""
    return F.when(stage == "retrieval", 500).when(F.contains(error, F.lit("402")), 503).when(error.isNotNull() | (stage == "crash"), 502).otherwise(200)


def cacheable(error: Column, finish_reason: Column, answer: Column, verification: Column) -> Column:
    """Whether an answer may be kept: complete, not empty, without error, and not of unclear verification."""
    fine = (F.coalesce(error, F.lit("")) == "") & finish_reason.eqNullSafe("stop") & (F.coalesce(answer, F.lit("")) != "")
    return fine & ~verification.eqNullSafe("inconclusive")


def request_stats(logs: DataFrame, exact: bool = True) -> DataFrame:
    """One row of statistics. Percentiles are exact, found by ``exact_percentiles`` in passes over the logs, or with
    exact=False approximate, in the same pass as the rest."""
    if exact:
        p50, p95 = (F.lit(p).cast("double") for p in exact_percentiles(logs, "total_ms", [0.5, 0.95]))
    else:
        p50, p95 = (F.percentile_approx("total_ms", p).cast("double") for p in (0.5, 0.95))
    rows = logs.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == 200).alias("ok"),
        F.count_if(F.col("status_code") >= 500).alias("failed"),
        F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("sum"),
        F.round(F.avg("total_ms"), 0).alias("avg_total_ms"),
        F.round(F.avg("retrieval_ms"), 0).alias("avg_retrieval_ms"),
        F.round(p50, 0).alias("p50_total_ms"),
        F.round(p95, 0).alias("p95_total_ms"),
    )
    each = F.when(F.col("requests") > 0, F.col("sum") / F.col("requests")).otherwise(0.0)
    return rows.withColumn("cost", F.round("sum", 4)).withColumn("cost_per_request", F.round(each, 4)).drop("sum")


def recent_errors(logs: DataFrame, n: int = 5) -> DataFrame:
    """The last n rows with an error, which is cut to 200 characters."""
    return logs.filter("error IS NOT NULL").orderBy(F.desc("id")).limit(n).select("id", "status_code", F.left("error", F.lit(200)).alias("error"))


def daily_cap(logs: DataFrame, cap: int = 200) -> DataFrame:
    """The requests that a day's cap (UTC) lets in, in order of time; cap <= 0: all. Spark cuts each task's days to cap rows first."""
    if cap <= 0:
        return logs
    order = Window.partitionBy(F.to_date("created_at")).orderBy("created_at", "id")
    return logs.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= cap).drop("k")


def allowed(times: list[float], state: list[float], per: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Sliding-window decisions for rising times, and the times that still hold slots. A refused request takes none."""
    out, slots = [], list(state)
    for now in times:
        slots = [s for s in slots if now - s <= seconds]
        out.append(len(slots) < per)
        if out[-1]:
            slots.append(now)
    return out, slots


def busy_spells(requests: DataFrame, seconds: float) -> DataFrame:
    """ip, tick, spell: of each stretch of ``seconds`` in which an ip has requests, the first of its spell without an empty stretch.

    An empty stretch is a pause of more than ``seconds``, behind which the sliding window is empty. Stretches are reduced
    to one row each before the shuffle, so a busy ip has as many rows as its time has stretches.
    """
    ticks = requests.select("ip", "tick").distinct()
    order = Window.partitionBy("ip").orderBy("tick")
    begins = F.when(F.coalesce(F.col("tick") - F.lag("tick").over(order) > 1, F.lit(True)), F.col("tick"))
    return ticks.withColumn("spell", F.last(begins, True).over(order))


def rate_limit(requests: DataFrame, per: int = 10, seconds: float = 60.0) -> DataFrame:
    """requests (id, ip, created_at) with allowed: at most per requests of an ip within seconds.

    An ip's requests are cut at pauses, where the window is empty, and its spells are dealt to tasks one by one. Rows of a
    spell come sorted to one task in Arrow batches; only per times are held. A spell without a pause cannot be split: each
    decision depends on those before it.
    """
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = requests.select("id", "ip", "created_at", us.alias("us"), F.floor(us / F.lit(int(seconds * 1_000_000))).alias("tick"))
    spells = busy_spells(rows, seconds).select(F.col("ip").alias("of"), F.col("tick").alias("in"), "spell")
    rows = rows.join(spells, F.col("ip").eqNullSafe(F.col("of")) & (F.col("tick") == F.col("in"))).select("id", "ip", "created_at", "us", "spell")
    rows = rows.repartition("ip", "spell").sortWithinPartitions("ip", "spell", "us", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, slots = None, []
        for batch in batches:
            decided = []
            for ip, spell, now in zip(batch["ip"], batch["spell"], batch["us"] / 1e6, strict=True):
                if (ip, spell) != key:
                    key, slots = (ip, spell), []
                (ok,), slots = allowed([now], slots, per, seconds)
                decided.append(ok)
            yield batch[["id", "ip", "created_at"]].assign(allowed=decided)

    return rows.mapInPandas(run, "id long, ip string, created_at timestamp, allowed boolean")


def admit(requests: DataFrame, per: int = 10, seconds: float = 60.0, cap: int = 200) -> DataFrame:
    """id, ip, created_at, status of requests (id, ip, created_at): the rate limit first (rate_limited), then the day's cap
    (capped), else admitted. A request that the cap refuses uses its ip's slot, but is not of the day's count."""
    limited = rate_limit(requests, per, seconds)
    within = daily_cap(limited.filter("allowed"), cap).select("id", F.lit(True).alias("within"))
    status = F.when(~F.col("allowed"), "rate_limited").when(F.col("within"), "admitted").otherwise("capped")
    return limited.join(within, "id", "left").select("id", "ip", "created_at", status.alias("status"))


def replayed(rows: list[tuple[float, bool, bool]], state: float | None, answer_ttl: float = TTL_ANSWER, refusal_ttl: float = TTL_REFUSAL) -> tuple[list[str], float | None]:
    """Outcomes of one key's requests (time, cacheable, refused) and the time at which the kept answer expires."""
    out, expires = [], state
    for now, fit, refused in rows:
        if expires is not None and expires >= now:
            out.append("hit")
            continue
        out.append("miss" if expires is None else "expired")
        expires = now + (refusal_ttl if refused else answer_ttl) if fit else None
    return out, expires


def daily_request_counts(logs: DataFrame, cap: int = 200, watermark: str | None = None) -> DataFrame:
    """day, requests, capped of each UTC day; with a watermark for streams."""
    rows = logs.withWatermark("created_at", watermark) if watermark else logs
    counts = rows.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("w.start").cast("date").alias("day"), "requests", (F.lit(cap > 0) & (F.col("requests") >= cap)).alias("capped"))


def windowed_stats(logs: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Counters of each time window, without percentiles; with a watermark for streams."""
    rows = logs.withWatermark("created_at", watermark) if watermark else logs
    stats = rows.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == 200).alias("ok"),
        F.count_if(F.col("status_code") >= 500).alias("failed"),
        F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"),
        F.round(F.avg("total_ms"), 4).alias("avg_total_ms"),
    )
    return stats.select(F.col("w.start").alias("start"), "requests", "ok", "failed", "refused", "cost", "avg_total_ms")
