"""Exact percentiles of a column of any size by distributed selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that are counted one by one instead of in ranges.
FEW = 5_000


def _counted(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at the ranks, from a count of each value."""
    out, below = {}, 0
    for row in sorted(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()):
        out |= {rank: row.v for rank in ranks if below <= rank < below + row.n}
        below += row.n
    return out


def _narrowed(values: DataFrame, ranks: list[int], low: float, high: float, buckets: int) -> dict[int, float]:
    """The values at the ranks, from counts in ranges that get narrower pass by pass."""
    #: rank: (smallest, largest value of its range, values below the range)
    ranges = {rank: (low, high, 0) for rank in ranks}
    while open_ := {rank: x for rank, x in ranges.items() if x[0] < x[1]}:
        place = {x: i for i, x in enumerate(sorted(set(open_.values())))}
        part = lambda i, a, b: F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        inside = F.array_compact(F.array(*(F.when(F.col("v").between(a, b), part(i, a, b)) for (a, b, _), i in place.items())))
        rows = values.select("v", F.explode(inside).alias("x"))
        # halves do not overflow; the ends of a range never share a bucket, so each pass narrows it
        share = F.nanvl(F.try_divide(F.col("v") / 2 - F.col("x.a") / 2, F.col("x.b") / 2 - F.col("x.a") / 2), F.lit(0.5))
        inner = F.greatest(F.lit(1), F.least(F.lit(buckets), F.ceil(F.coalesce(share, F.lit(0.5)) * buckets)))
        bucket = F.when(F.col("v") == F.col("x.a"), 0).when(F.col("v") == F.col("x.b"), buckets + 1).otherwise(inner)
        counts: dict[int, list] = {}
        for row in rows.groupBy(F.col("x.i").alias("i"), bucket.alias("bucket")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(row.i, []).append((row.a, row.b, row.n))
        for rank, x in open_.items():
            below = x[2]
            for a, b, n in sorted(counts[place[x]]):
                if rank < below + n:
                    ranges[rank] = (a, b, below)
                    break
                below += n
    return {rank: x[0] for rank, x in ranges.items()}


def exact_percentiles(df: DataFrame, column: str, shares: list[float], buckets: int = 1000) -> list[float | None]:
    """Percentiles of a column, interpolated between neighbours; nulls and NaN are left out, None where nothing is left.

    A first pass counts the values and estimates how many are different. If few are, a second one counts each. Else each
    pass counts the values of all ranks' ranges in buckets of equal width and narrows a range to the bucket of its rank,
    down to the smallest and largest value found there, until those are equal. Tasks and the driver hold ``buckets`` counts
    a rank at most; ranges shrink by that factor, so a few passes do.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high, different = values.agg(F.count("v"), F.min("v"), F.max("v"), F.approx_count_distinct("v")).head()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    ranks = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    found = _counted(values, ranks) if different <= FEW else _narrowed(values, ranks, low, high, buckets)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
