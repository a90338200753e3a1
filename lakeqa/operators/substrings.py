"""Literal substring joins by q-grams: which chunks hold which needles, without looking at all pairs.

A chunk is cut into blocks of q characters from its beginning on; their hashes are an inverted table (q, gram, chunk_id),
a row for each q characters of text. Wherever a needle of 2 q - 1 characters or more stands in a chunk, one of its first q
windows of length q is such a block, and the same holds for any q windows in a row. So a needle is looked up by q windows in
a row, those that occur in the fewest chunks, and what is found is verified.

A needle takes the largest size of SIZES that it is long enough for; one of a single character takes blocks of one. The
empty needle, size 0, stands in every chunk. A null needle or content matches nothing. Positions count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeqa.operators.tables import kept

SIZES = (16, 12, 10, 8, 4, 2, 1)
#: Ids of chunks to verify that are sent to every task at most.
IDS = 1_000_000


def needle_size(needle: Column) -> Column:
    """The block size that a needle is looked up by."""
    out = F.lit(0)
    for q in reversed(SIZES):
        out = F.when(F.length(needle) >= 2 * q - 1, q).otherwise(out)
    return out


def gram_index(chunks: DataFrame, sizes: list[int], content: str = "content", scope: tuple[str, ...] = ()) -> DataFrame:
    """q, gram, chunk_id and the columns of scope: the blocks of each chunk, once each. May be stored, by q."""
    tables = []
    for q in sizes:
        rows = chunks.filter(F.col(content).isNotNull())
        if q:
            blocks = F.regexp_extract_all(content, F.lit(f"(?s).{{{q}}}"), F.lit(0))
            rows = rows.select("chunk_id", *scope, F.explode(F.array_distinct(blocks)).alias("block"))
        else:
            rows = rows.select("chunk_id", *scope, F.lit("").alias("block"))
        tables.append(rows.select(F.lit(q).alias("q"), F.xxhash64("block").alias("gram"), "chunk_id", *scope))
    return reduce(DataFrame.unionByName, tables)


def _windows(needles: DataFrame, sizes: list[int]) -> DataFrame:
    """needle, q, run, gram: the windows of each needle, every q in a row as one run; the rest at the end is of no run."""
    tables = []
    for q in sizes:
        rows = needles.filter(F.col("q") == q)
        if q:  # a window begins at each code point
            found = F.regexp_extract_all("needle", F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))
            rows = rows.select("needle", "q", F.posexplode(found).alias("at", "block")).withColumn("run", F.floor(F.col("at") / q))
            rows = rows.filter((F.col("run") + 2) * q - 1 <= F.length("needle"))
        else:
            rows = rows.select("needle", "q", F.lit("").alias("block"), F.lit(0).cast("long").alias("run"))
        tables.append(rows.select("needle", "q", "run", F.xxhash64("block").alias("gram")))
    return reduce(DataFrame.unionByName, tables)


def candidates(needles: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """needle and the index's columns but q and gram: chunks that have a block of the needle's rarest run. needles: needle, q; distinct."""
    windows = _windows(needles, sizes)
    found = index.join(windows.select("q", "gram").distinct(), ["q", "gram"], "left_semi")
    counts = found.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    runs = windows.join(counts, ["q", "gram"], "left").groupBy("needle", "q", "run")
    runs = runs.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set(F.when(F.col("n") > 0, F.col("gram"))).alias("grams"))
    rarest = runs.groupBy("needle", "q").agg(F.min(F.struct("n", "run", "grams")).alias("r"))
    asked = rarest.select("needle", "q", F.explode("r.grams").alias("gram"))
    return asked.join(found, ["q", "gram"]).drop("q", "gram").distinct()


def substring_join(
    needles: DataFrame, chunks: DataFrame, content: str = "content", scope: tuple[str, ...] = (), condition: Column | None = None, keep: tuple[str, ...] = (), index: DataFrame | None = None
) -> DataFrame:
    """Columns of needles (needle, and others), chunk_id and the columns of scope and keep: a row for each chunk that holds the needle.

    condition: on columns of needles and of scope, checked before any content is read. index: a stored ``gram_index`` of
    the chunks with the sizes that the needles ask for. Rows of needles that are repeated give repeated rows.
    """
    asked = needles.filter(F.col("needle").isNotNull())
    texts = asked.select("needle", needle_size(F.col("needle")).alias("q")).distinct()
    sizes = sorted(r.q for r in texts.select("q").distinct().collect()) or [0]  # six at most
    index = gram_index(chunks, sizes, content, scope) if index is None else index
    pairs = candidates(texts, index, sizes).join(asked, "needle")
    pairs = kept(pairs if condition is None else pairs.filter(condition), "candidates")
    bodies = chunks.select("chunk_id", F.col(content).alias("_body"), *(F.col(c) for c in keep))
    ids = pairs.select("chunk_id").distinct()
    if ids.limit(IDS + 1).count() <= IDS:  # then other chunks are left where they are
        bodies = bodies.join(F.broadcast(ids), "chunk_id", "left_semi")
    return pairs.join(bodies, "chunk_id").filter(F.contains("_body", "needle")).drop("_body")
