"""Hard negatives by slot-decomposed selection (operator 12).

An anchor's positives are its ``positives`` best other rows of the same label. Each positive asks for the best rows of
other labels whose score lies in a window that ends at a share of the positive's own score. Windows of one anchor overlap;
instead of a search for each,

1. the upper limits of an anchor's windows, sorted, cut the scores into disjoint slots: (limit 1, limit 0], (limit 2,
   limit 1], ... The last slot ends at the smallest lower limit, below which nobody asks;
2. each block of rows keeps the best ``negatives`` rows of each slot of each anchor, tasks and then the shuffle keep as
   many of those of their blocks;
3. from the lowest slot up, a slot's list and the list of all slots below merge into the best rows under the slot's
   limit. That is the answer to every window with this limit, once the rows under its lower limit are cut off its end.

Vectors become integers, so scores are exact and do not depend on the order of sums. Both sides are packed into blocks of
rows, written once; each pair of blocks is a matrix product in float64 where all sums stay below 2**53, in int64 beyond.
A key of score and position makes keys unique, so one sort of a block's keys serves all slots. Anchor blocks are broadcast
only where ANCHOR_BYTES hold all of them, else pairs of blocks are dealt to tasks. Nothing is dealt by label, so a label
that a third of all rows have is like any other.

Rows with a null id, label or vector, or any null or non-finite component take no part; vectors that are too short
count as ending in zeros. Ties go to the smaller id. Rows that share an id are candidates each; an anchor's own id is
none of its others, and of repeated anchors the smallest (label, vector) asks. An anchor without positives, or whose
windows are empty, has no rows; neither has an empty table. Only the named columns are used. Scores must stay below
2**62, else there is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeqa.llm.common import Tables, read

#: Bytes of anchor blocks that are sent to every task at once.
ANCHOR_BYTES = 64 << 20
#: Rows and bytes of a block, rows of a block of anchors.
BLOCK_ROWS, BLOCK_BYTES, ANCHOR_ROWS = 4096, 4 << 20, 512
LARGEST = 1 << 62
BLOCK = "ids binary, labels binary, vectors binary, kind string, limits binary"


def integer_rows(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, shorter vectors filled up with zeros, and which rows have finite components only."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = bad[ends] == bad[ends - sizes]
    with np.errstate(all="ignore"):
        values = np.floor(values * scale)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    out = out[whole]
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError("components are too large for exact scores")
    return out.astype(np.int64), whole


def _blocks(df: DataFrame, scale: int, rows: int) -> DataFrame:
    """df (id, label, vector, limits) in blocks: ids, labels, integer components and limits as bytes, a block's rows in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = integer_rows(batch.column("vector"), scale)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[whole] for c in ("id", "label"))
            limits = np.array(batch.column("limits").to_pylist(), np.int64).reshape(len(whole), -1)[whole]
            kind = next((k for k in ("int16", "int32") if not x.size or np.abs(x).max() <= np.iinfo(k).max), "int64")
            step = max(1, min(rows, BLOCK_BYTES // max(8, 8 * x.shape[1])))
            for at in range(0, len(ids), step):
                order = at + np.argsort(ids[at : at + step], kind="stable")
                value = [ids[order].tobytes(), labels[order].tobytes(), x[order].astype(kind).tobytes(), kind, limits[order].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in value], names=["ids", "labels", "vectors", "kind", "limits"])

    return df.mapInArrow(run, BLOCK)


def _opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
    vectors = np.frombuffer(block["vectors"], block["kind"]).astype(np.int64).reshape(len(ids), -1)
    return ids, labels, vectors, np.frombuffer(block["limits"], np.int64).reshape(len(ids), -1)


def scores(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Inner products of all pairs as int64, and a bound of their absolute values."""
    width = min(anchors.shape[1], rows.shape[1])  # what is missing is zero
    anchors, rows = anchors[:, :width], rows[:, :width]
    bound = max((sum(map(abs, map(int, a))) for a in anchors), default=0) * int(np.abs(rows).max(initial=0))
    if bound >= LARGEST:
        raise ValueError("scores are too large to be exact")
    if bound < 1 << 53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64), bound
    return anchors @ rows.T, bound


def best_in_slots(score: np.ndarray, bound: int, edges: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slot, rows of score, columns) of the k largest scores in each slot (edges[:, j + 1], edges[:, j]]; earlier columns first.

    Scores that take no part are -bound - 1.
    """
    step = max(1, min(score.shape[1], LARGEST // (bound + 2)))
    edges = np.clip(edges, -bound - 1, bound)
    for at in range(0, score.shape[1], step):
        part = score[:, at : at + step]
        n = part.shape[1]
        keys = part * n + np.arange(n - 1, -1, -1)
        keys.sort(axis=1)
        under = [(keys < (edges[:, j, None] + 1) * n).sum(axis=1) for j in range(edges.shape[1])]
        for j in range(edges.shape[1] - 1):
            place = under[j][:, None] - 1 - np.arange(min(k, n))[None, :]
            row, t = np.nonzero(place >= under[j + 1][:, None])
            yield j, row, at + n - 1 - keys[row, place[row, t]] % n


def _search(anchors: DataFrame, rows: DataFrame, same: bool, k: int, small: bool) -> DataFrame:
    """anchor_id, slot, id, score: of each pair of blocks the best rows of the anchor's label, or of other labels in each slot."""
    asked = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    pairs = rows.crossJoin(F.broadcast(asked) if small else asked)  # blocks, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, labels, x, _ = _opened(pair)
                a_ids, a_labels, a, limits = _opened({name[2:]: value for name, value in pair.items() if name.startswith("a_")})
                score, bound = scores(a, x)
                fits = (a_labels[:, None] == labels[None, :]) == same
                if same:
                    fits &= a_ids[:, None] != ids[None, :]
                    limits = np.repeat([[bound, -bound - 1]], len(a_ids), axis=0)
                score[~fits] = -bound - 1
                for slot, row, column in best_in_slots(score, bound, limits, k):
                    columns = [a_ids[row], np.full(len(row), slot, np.int32), ids[column], score[row, column]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "id", "score"])

    found = pairs.mapInArrow(run, "anchor_id long, slot int, id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_column: str = "id",
    label: str = "label",
    vector: str = "vector",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the columns of df. low, high: the window of a negative's score, in percent of the positive's.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("asks"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    anchors = rows.filter(F.col("asks") & finite).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
    with Tables(df.sparkSession) as tables:
        blocks = tables.cut(_blocks(rows.select("id", "label", "vector", F.array().cast("array<long>").alias("limits")), scale, BLOCK_ROWS))
        asking = tables.cut(_blocks(anchors.withColumn("limits", F.array().cast("array<long>")), scale, ANCHOR_ROWS))
        # in memory, components are of eight bytes whatever their kind in the table
        size = asking.agg(F.sum(F.length("vectors") * 4)).head()[0] or 0
        small = size <= ANCHOR_BYTES
        best = _search(asking, blocks, True, positives, small)
        best = tables.cut(best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

        # 100 * score between low and high percent: integers from lower to upper
        percent = lambda p, plus: F.expr(f"positive_score div 100 * {p} + (positive_score % 100 * {p} + {plus}) div 100")
        best = best.filter("positive_score >= 0").withColumns({"lower": percent(low, 99), "upper": percent(high, 0)}).filter("lower <= upper")
        limits = best.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), False).alias("uppers"), F.min("lower").alias("least"))
        padded = F.concat("uppers", F.array_repeat(F.col("least") - 1, positives + 1 - F.size("uppers")))
        limited = anchors.join(limits.select(F.col("anchor_id").alias("id"), padded.alias("limits")), "id").select("id", "label", "vector", "limits")
        asking = tables.cut(_blocks(limited, scale, ANCHOR_ROWS))
        found = tables.cut(_search(asking, blocks, False, negatives, small))

        row = F.struct("slot", "rank", "id", "score")
        lists = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(row)).alias("found"))
        none = F.filter("found", lambda x: F.lit(False))

        def merge(merged: Column, slot: Column) -> Column:
            """merged: for each slot done so far, lowest last, the best rows of it and all below, begun with the newest."""
            own = F.filter("found", lambda x: x["slot"] == slot)
            return F.concat(F.array(F.slice(F.concat(own, F.coalesce(F.get(merged, F.lit(0)), none)), 1, negatives)), merged)

        lists = lists.select("anchor_id", F.aggregate(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), F.array(none), merge).alias("suffixes"))
        asked = best.join(limits.select("anchor_id", "uppers"), "anchor_id").join(lists, "anchor_id")
        under = F.get("suffixes", F.array_position("uppers", F.col("upper")).cast("int") - 1)
        asked = asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(under, lambda x: x["score"] >= F.col("lower"))).alias("at", "row"))
        out = asked.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("negative_id"), "positive_score", F.col("row.score").alias("negative_score"))
        return tables.result(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0, id_column="vec_id", vector="embedding")


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
