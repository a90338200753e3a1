"""Mixing sources to target weights along a curriculum (operator 2).

Every source has a weight and a schedule: how its weight runs over training time t in 0..1. The steps:

1. the size of a document is its number of words; a source's target is its share of all sizes by
   weight, at most ``max_repeat`` times the source's own size, the excess shared out by weight again;
2. inside a source, documents stand in an order fixed by the MD5 of their id, and their sizes are summed
   up: document d covers demand from c to c + size in the first pass, the same plus the source's size
   in the second, and so on; a copy is taken where its middle lies below the target;
3. the schedule is integrated, so a share W(t) of the target is asked for until t; inverting W at the
   start of a copy gives the training position of that copy;
4. ``training_order`` has one row per copy taken, range-sorted by position.

Running sums are taken in two steps: inside cells of (source, leading digits of the MD5), then over the
cells of a source. So no task gathers a whole source, however large. Only sums by source (bounded by
``max_sources``, an error beyond) reach the driver.

A null text has size 0; a null source is a source of its own and comes last; null ids and repeated rows
are documents like any other. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeqa.llm.common import WORD, clear_of, read, text_of

#: Times that a document is taken at most.
MAX_REPEAT = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Schedules in the same order: relative weight at the knots, linear between them, as (t, weight).
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.5)), ((0.0, 0.5), (1.0, 2.0)))


def capped_targets(sizes: list[int], weights: list[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Targets by weight that add up to all sizes, none above max_repeat times its size."""
    total, capped = float(sum(sizes)), set()
    while True:
        rest = total - sum(float(max_repeat * sizes[i]) for i in sorted(capped))
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [float(max_repeat * s) if i in capped else rest * weights[i] / free for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in capped and targets[i] > max_repeat * s}
        if not above:
            return targets
        capped |= above


def _integral(schedule: tuple) -> list[tuple[float, float, float, float]]:
    """Parts of a schedule as (t from, t to, weight from, weight to), with weights scaled to an integral of 1."""
    parts = [(a, b, u, v) for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False) if b > a]
    area = sum((b - a) * (u + v) / 2 for a, b, u, v in parts)
    return [(a, b, u / area, v / area) for a, b, u, v in parts]


def position_of(share: Column, schedule: tuple) -> Column:
    """The time t at which the integral of the schedule reaches a share of 0..1: piecewise inverse of a quadratic."""
    out, before = F.lit(float(schedule[-1][0])), 0.0
    pieces = []
    for a, b, u, v in _integral(schedule):
        area, slope = (b - a) * (u + v) / 2, (v - u) / (b - a)
        x = share - F.lit(before)
        # u s + slope s^2 / 2 = x, solved in the form that also holds for a slope of 0
        t = F.lit(a) + 2 * x / (F.lit(u) + F.sqrt(F.greatest(F.lit(0.0), F.lit(u * u) + F.lit(2 * slope) * x)))
        pieces.append((before + area, F.when(x <= 0, F.lit(a)).otherwise(F.least(F.lit(b), t))))
        before += area
    for end, t in reversed(pieces):
        out = F.when(share <= end, t).otherwise(out)
    return out


def mix(
    df: DataFrame,
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_repeat: int = MAX_REPEAT,
    digits: int = 3,
    max_sources: int = 100_000,
    id_column: str = "doc_id",
) -> DataFrame:
    """df with size, source_size, target, copies, taken and positions (one for each copy).

    digits: hexadecimal digits that make the cells; 16 ** digits cells of each source are to be small
    enough for one task each.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in ("size", "source_size", "target", "copies", "taken", "positions")))
    h = clear_of(df)
    of = lambda name: F.col(h + name)
    df = df.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))
    df = df.withColumn(h + "md5", F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    df = df.withColumn(h + "cell", F.substring(of("md5"), 1, digits))

    # cells, then sources: what is summed up shrinks before it is shuffled
    cells = df.groupBy(F.col("source").alias(h + "source"), h + "cell").agg(F.sum("size").alias(h + "cell_size"))
    by_source = cells.groupBy(h + "source").agg(F.sum(h + "cell_size").alias("n")).limit(max_sources + 1).collect()
    if len(by_source) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    by_source.sort(key=lambda r: (r[0] is None, r[0] or ""))  # by code point, null last
    targets = capped_targets([r["n"] for r in by_source], [float(weights[i % len(weights)]) for i in range(len(by_source))], max_repeat)
    plan = df.sparkSession.createDataFrame(
        [(r[0], r["n"], t, i % len(schedules)) for i, (r, t) in enumerate(zip(by_source, targets, strict=True))],
        f"{h}source string, source_size long, target double, {h}schedule int",
    )
    same = lambda a, b, *names: [a[h + n].eqNullSafe(b[h + n]) for n in names]
    starts = cells.withColumn(
        h + "before", F.sum(h + "cell_size").over(Window.partitionBy(h + "source").orderBy(h + "cell").rowsBetween(Window.unboundedPreceding, -1))
    ).drop(h + "cell_size")
    starts = starts.join(F.broadcast(plan), same(starts, plan, "source")).drop(plan[h + "source"])

    inside = Window.partitionBy("source", h + "cell").orderBy(h + "md5", "size", id_column).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(h + "inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(starts, [df["source"].eqNullSafe(starts[h + "source"]), df[h + "cell"] == starts[h + "cell"]]).drop(starts[h + "cell"])
    df = df.withColumn(h + "start", F.coalesce(of("before"), F.lit(0)) + of("inside"))
    taken = [F.col("size") + 2 * (of("start") + e * F.col("source_size")) <= 2 * F.col("target") for e in range(max_repeat)]
    df = df.withColumn("copies", F.when(F.col("size") > 0, sum((x.cast("int") for x in taken[1:]), taken[0].cast("int"))).otherwise(0))
    df = df.withColumn("taken", F.col("copies") * F.col("size"))

    def positions(schedule: tuple) -> Column:
        share = lambda e: (of("start") + e * F.col("source_size")) / F.col("target")
        return F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: position_of(share(e), schedule))

    chosen = F.when(F.col("copies") == 0, F.array().cast("array<double>"))
    for i, schedule in enumerate(schedules):
        chosen = chosen.when(of("schedule") == i, positions(schedule))
    return df.withColumn("positions", chosen).drop(*(c for c in df.columns if c.startswith(h)))


def training_order(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each copy taken, with copy and position (which replace columns of these names), range-sorted by position;
    ties by id and copy."""
    columns = [c for c in mixed.columns if c.lower() not in ("positions", "position", "copy")]
    copies = mixed.select(*columns, F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", id_column, "copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with the position of its first copy (null: none), range-sorted by the positions of its copies;
    those not taken come last."""
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    ordered = mixed.orderBy(F.size("positions") == 0, "positions", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy taken, with its training position, in training order."""
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return training_order(mixed).select("doc_id", "source", "size", "copy", "position")


def _by_weight(value) -> str:
    """value(u, slope) of the schedule of a source in SQL; w - 1 is its number. Each schedule is one part here."""
    parts = [_integral(schedule)[0] for schedule in SCHEDULES]
    return "CASE w " + " ".join(f"WHEN {i + 1} THEN {value(u, (v - u) / (b - a))!r}e0" for i, (a, b, u, v) in enumerate(parts)) + " END"


def _position_sql(share: str) -> str:
    root = f"sqrt(greatest(0e0, {_by_weight(lambda u, slope: u * u)} + {_by_weight(lambda u, slope: 2 * slope)} * ({share})))"
    return f"CASE WHEN {share} <= 0 THEN 0e0 ELSE least(1e0, 2 * ({share}) / ({_by_weight(lambda u, slope: u)} + {root})) END"


#: The same in SQL. Sources are capped in order of size by weight, which ends where capping in rounds does.
_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n,
        1.0 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(n) OVER () AS total FROM s),
k AS (SELECT *, 3 * n < (total - capped) * w / free AS is_capped FROM o),
r AS (SELECT coalesce(sum(3 * n) FILTER (is_capped), 0) AS capped, sum(w) FILTER (NOT is_capped) AS free FROM k),
t AS (SELECT source, n, w, CASE WHEN is_capped THEN 3 * n ELSE (total - r.capped) * w / r.free END AS target FROM k, r),
c AS (SELECT d.*, n, w, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY m, size, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
OP2_SQL = f"""{_MIX_SQL}
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  (size * ((size + 2 * start <= 2 * target)::INT + (size + 2 * (start + n) <= 2 * target)::INT
           + (size + 2 * (start + 2 * n) <= 2 * target)::INT))::BIGINT AS taken,
  CASE WHEN size > 0 AND size + 2 * start <= 2 * target THEN {_position_sql("start / target")} END AS position FROM c
"""
OP2_ORDER_SQL = f"""{_MIX_SQL}
SELECT doc_id, source, size::BIGINT AS size, copy, {_position_sql("(start + copy * n) / target")} AS position
FROM c, (VALUES (0), (1), (2)) AS k(copy) WHERE size > 0 AND size + 2 * (start + copy * n) <= 2 * target
"""
