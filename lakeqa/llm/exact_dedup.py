"""Exact duplicates by deterministic block naming (operator 8).

Texts are normalised (every character of U+0020 and U+0009 to U+000D deleted) and cut into blocks of a
fixed size. All blocks are sorted; equal blocks get one integer name, in order. Then adjacent pairs of
names are sorted and named in the same way, level by level, until each document has a single name. As
names stand for contents, not for hashes of them, two documents of as many blocks have the same name
exactly if their normalised texts are equal.

Sorting is a range partitioning by (digest of the block, row), so a block that a third of all rows share
is spread over as many tasks as its size asks for, and what range partitioning samples for the driver is
short; names come from comparing the blocks themselves. Each task names what it holds; whether its first block goes on
from the task before it is settled with a row for each task on the driver (two digests and a count).
After the first level only names travel, not texts; a level halves the rows, and documents of one block
are finished at once. Every level ends in a table in the shared folder, so a lost executor costs one
level; these tables are deleted at the end, also after a failure.

A null text counts as empty, so null and empty texts are equal. Repeated rows are members of the group
like any other; of rows that tie in length and id one stays. Null ids come last. An empty table gives an
empty result. Helper columns stand apart from those of the input, so no name of an id or other column clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeqa.llm.common import SPACE, Tables, clear_of, read, text_of

#: Characters of a block.
BLOCK = 8192


def _named(keys: list[str], fields: list[str]):
    """A function for mapInArrow over rows sorted by keys: the fields, the task's number and the rank of the keys in it.

    The task's last row has its digests: those of its first and last keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rank, before, first = TaskContext.get().partitionId(), 0, None, None
        digest = lambda key: hashlib.sha256(repr(key).encode()).digest()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            n = batch.num_rows
            change = None
            for c in columns:
                differs = pc.not_equal(c.slice(1), c.slice(0, n - 1))
                change = differs if change is None else pc.or_(change, differs)
            head = [c[0].as_py() for c in columns]
            first = first or head
            opens = before is not None and head != before
            steps = pc.cumulative_sum(pa.concat_arrays([pa.array([int(opens)], pa.int64()), change.cast(pa.int64())]))
            ranks = pc.add(steps, rank)
            rank, before = ranks[-1].as_py(), [c[-1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in fields), pa.array([part] * n, pa.int32()), ranks, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                names=[*fields, "part", "rank", "first", "last"],
            )
        if before is not None:
            values = [pa.nulls(1, batch.schema.field(f).type) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*values, pa.array([part], pa.int32()), pa.array([rank], pa.int64()), pa.array([digest(first)], pa.binary()), pa.array([digest(before)], pa.binary())],
                names=[*fields, "part", "rank", "first", "last"],
            )

    return run


def name_sorted(df: DataFrame, keys: list[str], row: list[str], tables: Tables, leading: list[Column] | None = None) -> DataFrame:
    """df without keys, with a column name: an integer, the same for equal keys and rising with them.

    row: columns that tell the rows apart; they spread equal keys over several tasks. leading: short values made of the
    keys to range-partition and sort by first, for long keys.
    """
    fields = [c for c in df.columns if c not in keys]
    schema = T.StructType([*(df.schema[f] for f in fields), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    placed = df.repartitionByRange(*(leading or keys), *row).sortWithinPartitions(*(leading or []), *keys, *row)
    ranked = tables.cut(placed.mapInArrow(_named(keys, fields), schema))
    # a row for each task: where its names start, given that its first keys may be the last ones of the task before
    offset, following, offsets = 0, None, []
    for r in sorted(ranked.filter("first IS NOT NULL").select("part", "rank", "first", "last").collect()):
        if following is not None:
            offset += r["first"] != following
        offsets.append((r["part"], offset))
        offset, following = offset + r["rank"], r["last"]
    starts = df.sparkSession.createDataFrame(offsets, "part int, start long")
    named = ranked.filter("first IS NULL").join(F.broadcast(starts), "part")  # a row for each task
    return named.select(*fields, (F.col("start") + F.col("rank")).alias("name"))


def identities(df: DataFrame, tables: Tables, text: str = "text", block: int = BLOCK) -> DataFrame:
    """own (a struct of df's other columns, whatever their names), row, n_code_points, sha256, n_blocks, name.

    n_blocks and name are the same for equal normalised texts.
    """
    rest = [c for c in df.columns if c != text]
    normal = F.regexp_replace(text_of(text), SPACE, "")
    df = df.select(
        F.struct(*(F.col(c) for c in rest)).alias("own"),
        F.monotonically_increasing_id().alias("row"),
        F.length(text_of(text)).alias("n_code_points"),
        F.sha2(normal, 256).alias("sha256"),
        normal.alias("normal"),
    )
    blocks = F.when(F.col("normal") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("normal", F.lit(f"((?s).{{1,{block}}})"), F.lit(1)))
    df = df.withColumn("blocks", blocks).withColumn("n_blocks", F.size("blocks"))
    kept = ["own", "row", "n_code_points", "sha256", "n_blocks"]
    level = name_sorted(df.select(*kept, F.posexplode("blocks").alias("place", "block")), ["block"], ["row", "place"], tables, [F.unhex(F.sha2("block", 256))])
    done, width = None, 1
    while True:
        single = level.filter(F.col("n_blocks") <= width).drop("place")
        done = single if done is None else done.unionByName(single)
        level = level.filter(F.col("n_blocks") > width)
        if level.isEmpty():
            break
        half = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        pairs = level.groupBy(*kept, F.floor(F.col("place") / 2).cast("int").alias("half")).agg(half(0).alias("a"), F.coalesce(half(1), F.lit(-1)).alias("b"))
        level = name_sorted(pairs.withColumnRenamed("half", "place"), ["a", "b"], ["row", "place"], tables)
        width *= 2
    return done.select("own", "row", "n_code_points", "sha256", "n_blocks", "name")


def exact_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of df: its id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the most code points stays, then the one with the smallest id. A large group is a hot
    key on the side of the documents only, in an equi-join that adaptive execution splits; the counts are summed up
    before the shuffle, and written, so that the join has a shuffle of its own.
    """
    id_ = F.col("own").getField(id_column)
    with Tables(df.sparkSession) as tables:
        named = identities(df.select(id_column, text), tables, text, block)
        best = F.struct((-F.col("n_code_points")).alias("n"), id_.isNull().alias("none"), id_.alias("id"), F.col("row").alias("row"))
        groups = tables.cut(named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")))
        out = named.join(groups, ["n_blocks", "name"]).select(
            id_.alias(id_column),
            F.col("best.id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("best.row")).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
        return tables.result(out)


def drop_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that do not stay. The text is shuffled once: the join and the removal of repeated rows share a key."""
    groups = exact_groups(df, id_column, text)
    return keep_rows(df, groups.filter("kept").select(id_column, "text_sha256"), id_column, F.sha2(F.regexp_replace(text_of(text), SPACE, ""), 256), F.length(text_of(text)))


def keep_rows(df: DataFrame, kept: DataFrame, id_column: str, mark: Column, size: Column) -> DataFrame:
    """The rows of df whose id and mark are in kept (id, mark); of several such rows of one id and mark the longest."""
    h = clear_of(df)
    key = lambda id_, m: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), m.cast("string"))
    keys = kept.select(key(F.col(kept.columns[0]), F.col(kept.columns[1])).alias(h + "key"))
    rows = df.withColumn(h + "key", key(F.col(id_column), mark)).join(keys, h + "key", "left_semi")
    first = Window.partitionBy(h + "key").orderBy(size.desc())
    return rows.withColumn(h + "k", F.row_number().over(first)).filter(F.col(h + "k") == 1).select(*df.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


#: The same in SQL.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY t) AS group_size,
        first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
