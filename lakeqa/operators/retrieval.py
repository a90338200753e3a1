"""Retrieval over tables of questions and chunks: BM25, exact cosine search, rank fusion, reranking, and its evaluation.

Texts are joined to finalists only; shuffles carry ids, ranks and scores. Ties end at the chunk id. The BM25 index is made
once of the tokenised chunks and may be stored: ``write_index`` and ``read_index``. It holds blocks of postings with their
greatest impact, in a folder for each bucket of terms, so a search reads the buckets and skips the blocks that it can.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeqa.functions.text import plain, tokenize, tokens_of
from lakeqa.operators.tables import kept

#: Bytes of question vectors that are sent to every task at once; more are worked off in several rounds.
QUERY_BYTES = 64 << 20
#: Postings of a block, folders of a stored index's postings, chunks of a group.
BLOCK, BUCKETS, GROUP = 128, 64, 4096
#: Tokens that end a group early, and terms of all questions together that are sent to every task.
TOKENS, TERMS = 2_000_000, 500_000
#: Characters of chunks whose postings a task sorts when an index is stored, about, tasks that share its buckets, and
#: most tasks: beyond 200 Spark's shuffle holds a map task's rows in memory (measured: 575 MB), more than these sorts then do.
CHARS, SHARES, SORTS = 16 << 20, 8, 200
#: Scores of a group that a task holds at once; more questions are worked off in several rounds.
SCORES = 8_000_000


def _top(df: DataFrame, key: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, ranked from 1. Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def _apart(ranked: DataFrame) -> DataFrame:
    """The same rows (query_id, rank from 1 or null), without Spark's knowing that they are dealt by query_id.

    Spark 4.1 joins up the tasks of a union whose sides are dealt alike, and fails if adaptive execution deals one anew.
    """
    return ranked.withColumn("query_id", F.when(F.coalesce(F.col("rank"), F.lit(1)) >= 1, F.col("query_id")))


class Index(NamedTuple):
    """postings: bucket, term, grp, block, top_tf, least_dl, n, postings (minus_tf, dl, chunk_id, cell). terms: term, df, raw (idf before the
    floor). chunks: chunk_id, cell, dl. size: one row of n, avgdl, mean (of raw)."""

    postings: DataFrame
    terms: DataFrame
    chunks: DataFrame
    size: DataFrame


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocked(batches: Iterator[pa.RecordBatch], size: int, group: int) -> Iterator[pa.RecordBatch]:
    """Blocks of postings of chunk_id, cell, plain text: each ``group`` chunks, or as many as TOKENS tokens allow, are a group."""
    parts, chunks, tokens = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, min(256, group)):
            own, cell, text = batch.slice(at, min(256, group)).columns
            parts.append(pa.RecordBatch.from_arrays([own, cell, tokens_of(text)], names=["chunk_id", "cell", "tokens"]))
            chunks, tokens = chunks + len(own), tokens + len(parts[-1].column("tokens").flatten())
            if chunks >= group or tokens >= TOKENS:
                yield _blocks_of(pa.Table.from_batches(parts).combine_chunks(), size)
                parts, chunks, tokens = [], 0, 0
    if parts:
        yield _blocks_of(pa.Table.from_batches(parts).combine_chunks(), size)


def _blocks_of(chunks: pa.Table, size: int) -> pa.RecordBatch:
    """A group's blocks: term, grp, block, top_tf, least_dl, n, postings."""
    ids, cells, tokens = (c.chunk(0) for c in chunks.columns)
    dl = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    words = tokens.flatten().dictionary_encode()
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    # the last code stands for no term: it lists all chunks
    code, row = np.concatenate([key // len(dl), np.full(len(dl), len(words.dictionary))]), np.concatenate([key % len(dl), np.arange(len(dl))])
    tf = np.concatenate([tf, np.ones(len(dl), tf.dtype)])
    code, row, tf = _by_impact(code, row, tf, dl)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    starts = np.flatnonzero(place % size == 0)
    n = np.diff(np.append(starts, len(code)))
    posting = pa.StructArray.from_arrays([pa.array(-tf, pa.int64()), pa.array(dl[row], pa.int32()), ids.take(pa.array(row)), cells.take(pa.array(row))], names=["minus_tf", "dl", "chunk_id", "cell"])
    terms = pa.concat_arrays([words.dictionary, pa.nulls(1, words.dictionary.type)]).take(pa.array(code[starts]))
    columns = {
        "term": terms,
        "grp": pa.array(np.full(len(starts), zlib.crc32(repr(ids[0].as_py()).encode())), pa.int64()),
        "block": pa.array(place[starts] // size, pa.int32()),
        "top_tf": pa.array(tf[starts], pa.int64()),
        "least_dl": pa.array(np.minimum.reduceat(dl[row], starts), pa.int32()),
        "n": pa.array(n, pa.int32()),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), posting),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _by_impact(code: np.ndarray, row: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by term, falling tf, rising length of their chunk and its row: as one number each, where 63 bits hold them."""
    parts = [code, tf.max() - tf, dl[row].astype(np.int64), row]
    bits = [int(part.max()).bit_length() for part in parts]
    if sum(bits) > 63:
        order = np.lexsort(parts[::-1])
        return code[order], row[order], tf[order]
    packed = parts[0]
    for part, n in zip(parts[1:], bits[1:], strict=True):
        packed = packed << n | part
    packed = np.sort(packed)
    low = lambda n: (1 << n) - 1
    return packed >> sum(bits[1:]), packed & low(bits[3]), tf.max() - (packed >> bits[2] + bits[3] & low(bits[1]))


def postings(chunks: DataFrame, content: str = "content", buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """Blocks of postings: bucket (of the term), term, grp, block, top_tf, least_dl, n, postings (minus_tf, dl, chunk_id, cell).

    Chunks that stand together, ``group`` of them, are a group; its blocks are made where they stand, so postings are
    not shuffled one by one, and a term that all chunks have lies in as many groups as there are. In a group a term's postings
    stand by falling tf (which is stored negated) and rising length, cut into blocks of BLOCK; each block says its
    largest tf and its shortest length. Rows without a term list all chunks, those without tokens too. chunks may have a
    cell, the number of their filing (``routing.cell_of``).
    """
    cell = F.col("cell") if "cell" in chunks.columns else F.lit(0).cast("long").alias("cell")
    tasks, cores = chunks.select(F.spark_partition_id().alias("p")).distinct().count(), chunks.sparkSession.sparkContext.defaultParallelism
    rows = chunks if tasks >= cores else chunks.repartition(cores)  # a few row groups would keep most cores idle
    rows = rows.select("chunk_id", cell, plain(F.coalesce(F.col(content), F.lit(""))).alias("plain"))
    posting = T.StructType([T.StructField("minus_tf", T.LongType()), T.StructField("dl", T.IntegerType()), *rows.schema.fields[:2]])
    numbers = [T.StructField(name, kind) for name, kind in (("grp", T.LongType()), ("block", T.IntegerType()), ("top_tf", T.LongType()), ("least_dl", T.IntegerType()), ("n", T.IntegerType()))]
    size = BLOCK
    blocks = rows.mapInArrow(lambda batches: _blocked(batches, size, group), T.StructType([T.StructField("term", T.StringType()), *numbers, T.StructField("postings", T.ArrayType(posting))]))
    return blocks.select(_bucket(F.col("term"), buckets).alias("bucket"), "*")


def _summed(blocks: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """terms, chunks and size (without mean) of an index's postings."""
    chunks = blocks.filter(F.col("term").isNull() & (F.col("bucket") == _bucket(F.lit(None).cast("string"), buckets))).select(F.explode("postings").alias("p")).select("p.chunk_id", "p.cell", "p.dl")
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    found = blocks.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(size))  # one row
    return found.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), chunks, size


def build_index(chunks: DataFrame, content: str = "content") -> Index:
    """The index as a plan, which each use computes; ``write_index`` stores it."""
    index = postings(chunks, content, 1)
    terms, listed, size = _summed(index, 1)
    return Index(index, terms, listed, size.join(F.broadcast(terms.agg(F.avg("raw").alias("mean")))))


def write_index(chunks: DataFrame, path: str, content: str = "content", buckets: int = BUCKETS) -> Index:
    """Tokenise the chunks once and store postings in a folder for each bucket of terms, so that a search reads the buckets
    of its terms and, in their files, the rows of these terms; and terms, chunks and size.

    Blocks are dealt evenly: a task gets one piece of a share of the buckets, and there are as many pieces as the characters
    of the chunks ask for, up to SORTS tasks. So a task sorts about the same number of postings up to SORTS * CHARS characters, and
    a 200th of them beyond; a term that all chunks have lies in all pieces.
    """
    spark = chunks.sparkSession
    shares, chars = min(SHARES, buckets), chunks.agg(F.sum(F.length(content))).head()[0] or 0
    pieces = max(1, min(math.ceil(chars / CHARS / shares), SORTS // shares))
    task = F.pmod(F.xxhash64("term", "grp", "block"), F.lit(pieces)).cast("int") * shares + F.pmod("bucket", F.lit(shares))
    blocks = postings(chunks, content, buckets).repartitionById(pieces * shares, task)
    blocks.sortWithinPartitions("bucket", "term", "grp", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms, listed, size = _summed(_read_postings(spark, path), buckets)
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    listed.write.mode("overwrite").parquet(f"{path}/chunks")
    size = spark.read.parquet(f"{path}/chunks").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    size.join(F.broadcast(spark.read.parquet(f"{path}/terms").agg(F.avg("raw").alias("mean")))).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/size")
    return read_index(spark, path)


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(_read_postings(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in Index._fields[1:]))


def bm25_stats(index: Index, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf: negative idf is replaced by epsilon times the mean idf of the vocabulary."""
    return index.terms.join(F.broadcast(index.size)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one grp and part after another; they come sorted by these."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("grp", "part")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, start].tolist())
            if parts and key != last:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            parts, last = [*parts, batch.slice(start, end - start)], key
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the different ones, which are sorted."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _scored(rows: pa.Table, k: int | None, part: Callable[[np.ndarray, np.ndarray], np.ndarray], scoped: bool) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id, score: the k best of a group of chunks for each question, without those that score 0.

    rows: blocks with the questions that ask for their term (minus_tf, dl, chunk_id, cell, asked) and, if scoped, the chunks
    that a question may return (query_id, seen). Scores are a matrix of SCORES at most: some questions, all chunks of the group.
    """
    blocks = rows.filter(pc.is_valid(rows["asked"])).combine_chunks()
    if not blocks.num_rows:
        return
    lists, asked = blocks["chunk_id"].chunk(0), blocks["asked"].chunk(0)
    starts, at = lists.offsets.to_numpy() - lists.offsets[0].as_py(), asked.offsets.to_numpy() - asked.offsets[0].as_py()
    flat, asked = lambda name: blocks[name].chunk(0).flatten(), asked.flatten()
    column, chunks = _codes(flat("chunk_id"))
    question, queries = _codes(asked.field("query_id"))
    weight, parts = asked.field("weight").to_numpy(), part(-flat("minus_tf").to_numpy().astype(float), flat("dl").to_numpy().astype(float))
    allow = None
    if asked.type.get_field_index("cells") >= 0:
        cell, known = _codes(flat("cell"))
        known = {c: i for i, c in enumerate(known.to_pylist()) if c is not None}
        allow = np.zeros((len(queries), max(cell) + 1), bool)
        for i, cells in enumerate(asked.field("cells").take(pa.array(np.unique(question, return_index=True)[1])).to_pylist()):
            allow[i, [known[c] for c in cells if c in known] if cells is not None else slice(None)] = True
    if scoped:
        scope = rows.filter(pc.is_valid(rows["seen"])).combine_chunks()
        if not scope.num_rows:
            return
        seen = scope["seen"].chunk(0)
        of = np.repeat(pc.fill_null(pc.index_in(scope["query_id"].chunk(0), queries), -1).to_numpy(), seen.value_lengths().to_numpy())
        to = pc.fill_null(pc.index_in(seen.flatten(), chunks), -1).to_numpy()
        of, to = of[(of >= 0) & (to >= 0)], to[(of >= 0) & (to >= 0)]

    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    twice = len(np.unique(block * len(chunks) + column)) < len(column)  # a block lists a chunk twice
    step = max(1, SCORES // len(chunks))
    for low in range(0, len(queries), step):
        scores = np.zeros((min(step, len(queries) - low), len(chunks)))
        for row in range(blocks.num_rows):
            p, q = slice(starts[row], starts[row + 1]), slice(at[row], at[row + 1])
            who, much, where = question[q] - low, weight[q], column[p]
            if len(queries) > step:
                inside = (who >= 0) & (who < step)
                who, much = who[inside], much[inside]
            added = much[:, None] * parts[p]
            if allow is not None:
                added *= allow[who + low][:, cell[p]]
            np.add.at(scores, (who[:, None], where), added) if twice else scores.__setitem__((who[:, None], where), scores[who[:, None], where] + added)
        scores = np.round(scores, 6)
        if scoped:
            inside = (of >= low) & (of < low + step)
            own = np.zeros(scores.shape, bool)
            own[of[inside] - low, to[inside]] = True
            scores[~own] = 0
        fit = scores != 0
        if k is not None and k < len(chunks):
            fit &= scores >= np.partition(scores, len(chunks) - k, axis=1)[:, len(chunks) - k, None]
        i, j = np.nonzero(fit)
        if k is not None:  # chunks of the same score as the k-th go by id
            order = np.lexsort((j, -scores[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)
            i, j = i[np.arange(len(i)) - first < k], j[np.arange(len(j)) - first < k]
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(i + low)), chunks.take(pa.array(j)), pa.array(scores[i, j])], names=["query_id", "chunk_id", "score"])


def bm25_topk(
    queries: DataFrame,
    chunks: DataFrame | Index,
    k: int = 10,
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    scope: DataFrame | None = None,
    cells: DataFrame | None = None,
    prune: bool = False,
) -> DataFrame:
    """query_id, chunk_id, score, rank. queries: query_id, question. chunks: a table, or its index. scope: query_id, chunk_id
    that a query may return. cells: query_id, cells that a query may return chunks of (null: all), from ``cells_of``.

    Statistics come from all chunks. Chunks without a term of the query have score 0 and are candidates too: each query
    gets the 2 k smallest chunk ids with a score of 0 added to what they have. Of these at most k - 1 score above 0 where
    they matter, so k of score 0 are among them; only if a floor below 0 makes scores negative (a mean idf below 0, of
    a few chunks with the same words), all chunks are added.

    prune: skip blocks that cannot matter. The first blocks of all terms give sums that k chunks of a query reach at least.
    A block is left out where its greatest part and the greatest parts of the query's other terms together stay below
    that, since then so do all its chunks. This reads the bounds of all blocks before, which pays for short questions over
    many chunks; with dozens of terms in a question hardly a block can be left out. Results are the same.
    """
    index = chunks if isinstance(chunks, Index) else build_index(chunks)
    size = index.size.head()
    buckets, mean, avgdl = (size["buckets"] if "buckets" in index.size.columns else 1), size["mean"], size["avgdl"] or 1.0
    negative = mean is not None and mean * epsilon < 0
    asked = queries.select("query_id", F.explode(tokenize(F.col("question"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).join(bm25_stats(index, epsilon), "term")
    asked = asked.select("query_id", "term", _bucket(F.col("term"), buckets).alias("bucket"), (F.col("qtf") * F.col("idf")).alias("weight"))
    part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    by_query = cells.select("query_id", "cells") if cells is not None else None
    #: tasks: as many as there are groups, about, so that a task holds a few groups whatever their number
    tasks = max(index.postings.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * size["n"] * max(1 / GROUP, avgdl / TOKENS)))

    asked = kept(asked if by_query is None else asked.join(by_query, "query_id"), "asked").filter("bucket >= 0")  # the filter is what lets Spark prune the buckets of postings by the terms asked for
    n_asked = asked.count()
    small, parts = n_asked <= TERMS, math.ceil(n_asked / TERMS)
    own = F.lit(0) if small else F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    wanted = F.struct("query_id", "weight", *(["cells"] if by_query is not None else []))
    located = index.postings.filter(F.col("term").isNull() & (F.col("bucket") == _bucket(F.lit(None).cast("string"), buckets))).select("grp", F.explode("postings").alias("p")).select("grp", "p.chunk_id")
    seen = scope.join(located, "chunk_id").groupBy("grp", own.alias("part"), "query_id").agg(F.collect_list("chunk_id").alias("seen")) if scope is not None else None
    kinds = {f.name: f.dataType for f in [*asked.schema.fields, *index.postings.schema.fields]}
    chunk_type = next(f.dataType for f in kinds["postings"].elementType.fields if f.name == "chunk_id")
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])
    most_rows, scoped = None if negative else k, scope is not None
    numbers = [F.col("postings.minus_tf").cast("array<int>").alias("minus_tf"), *(F.col(f"postings.{name}") for name in ("dl", "chunk_id", *(["cell"] if by_query is not None else [])))]

    def best(rows: DataFrame, dealt: bool = False) -> DataFrame:
        """query_id, chunk_id, score: the k best of each group of chunks (all, if scores may be negative). rows: grp, part, term, postings, and asked unless dealt.

        Postings are dealt as lists of numbers, which take less than half of the structs' bytes: Spark's shuffle to more than 200 tasks
        holds what a task sends, and each task sorts what it gets. Cells are sent only where questions have them.
        """
        rows = rows.select("grp", "part", "term", "block", *numbers, *([] if dealt else ["asked"]))
        rows = rows if seen is None else rows.unionByName(seen, allowMissingColumns=True)
        rows = rows.repartition(tasks, "grp", "part")
        rows = rows.join(F.broadcast(asked.groupBy("term").agg(F.collect_list(wanted).alias("asked"))), "term", "left") if dealt else rows
        rows = rows.sortWithinPartitions("grp", "part", "term", "block")  # behind the join: Spark drops a sort before one
        return rows.drop("term", "block").mapInArrow(lambda batches: (out for group in _of_groups(batches) for out in _scored(group, most_rows, part, scoped)), schema)

    if prune and not negative:
        bound = lambda tf, dl: F.col("weight") * part(F.col(tf), F.col(dl))
        hits = (F.broadcast(asked) if small else asked).join(index.postings, ["bucket", "term"])
        single = lambda rows: rows.select("grp", own.alias("part"), "term", "block", "postings", F.array(wanted).alias("asked"))
        reached = _top(best(single(hits.filter("block = 0"))), "query_id", [F.desc("score")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        most = hits.groupBy("query_id", "term").agg(F.max(bound("top_tf", "least_dl")).alias("most"))
        total = most.groupBy("query_id").agg(F.sum("most").alias("total")).join(reached, "query_id", "left")
        bounds = most.join(total, "query_id").select("query_id", "term", (F.col("total") - F.col("most")).alias("others"), "reached")
        hits = hits.join(bounds, ["query_id", "term"])
        hits = hits.filter(bound("top_tf", "least_dl") + F.col("others") >= F.coalesce(F.col("reached"), F.lit(0.0)) - 1e-5)  # scores are rounded
        found = best(single(hits))
    elif small:
        # postings of the terms asked for are dealt by group once; questions meet them there, and k rows a group go on
        hits = index.postings.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
        found = best(hits.withColumn("part", F.lit(0)), dealt=True)
    else:
        found = best(index.postings.join(asked.groupBy("bucket", "term", own.alias("part")).agg(F.collect_list(wanted).alias("asked")), ["bucket", "term"]))
    if scope is None:
        listed = index.chunks.select("chunk_id", "cell")
        least = listed if negative else listed.orderBy("chunk_id").limit(2 * k)
        if cells is None:
            spare = queries.select("query_id").join(least if negative else F.broadcast(least))
        else:
            wanted = queries.select("query_id").join(cells, "query_id")
            of_cell = listed if negative else _top(listed, "cell", [F.asc("chunk_id")], 2 * k)
            spare = wanted.filter("cells IS NULL").join(least if negative else F.broadcast(least))
            spare = spare.select("query_id", "chunk_id").unionByName(wanted.select("query_id", F.explode(F.array_distinct("cells")).alias("cell")).join(of_cell, "cell").select("query_id", "chunk_id"))
    else:
        spare = scope if negative else _top(scope, "query_id", [F.asc("chunk_id")], 2 * k)
    # a spare chunk that scores but is not among the best of its group is behind k others, with a score of 0 as well
    rows = found.unionByName(spare.select("query_id", "chunk_id", F.lit(0.0).alias("score")))
    scores = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return _top(scores, "query_id", [F.desc("score"), F.asc("chunk_id")], k)


def _blocks(df: DataFrame, id_column: str, scopes: Column, rows: int) -> DataFrame:
    """df's vectors of unit length in blocks of up to rows: ids, vectors (float64, as bytes), scopes (a list a row, or null)."""
    df = df.select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), scopes.cast("array<string>").alias("scopes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                values = [part.column("id").to_pylist(), x.tobytes(), part.column("scopes").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.string()))), strict=True)], names=["ids", "vectors", "scopes"])

    return df.mapInArrow(run, "ids array<long>, vectors binary, scopes array<array<string>>")


def _allowed(wanted: list, own: list) -> np.ndarray:
    """Which rows (one scope each) each query (some scopes, or null for any) may see."""
    names = [scopes[0] if scopes else None for scopes in own]
    code = {name: i for i, name in enumerate(sorted({n for n in names if n is not None}))}
    table = np.zeros((len(wanted), len(code) + 1), bool)  # the last column: rows without a scope
    for i, scopes in enumerate(wanted):
        table[i, [code[n] for n in scopes if n in code] if scopes is not None else slice(None)] = True
    return table[:, [code.get(n, len(code)) for n in names]]


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, scope: bool = False, rows: int = 2048) -> DataFrame:
    """query_id, chunk_id, distance, rank by cosine distance, exact. Both: id, embedding, and with scope=True scope: of a row
    its ticker, cell or the like, of a query the one or the array of those that it asks for (null asks for all).

    Both sides are packed into blocks of rows, each pair of blocks is one matrix product, and k rows of a query go on from
    each. Query blocks are broadcast where QUERY_BYTES hold all of them, else pairs of blocks are dealt to tasks.
    """
    dim = queries.select(F.size("embedding")).head()
    small = dim is not None and queries.limit(QUERY_BYTES // (8 * max(1, dim[0])) + 1).count() <= QUERY_BYTES // (8 * max(1, dim[0]))
    one = lambda: F.when(F.col("scope").isNotNull(), F.array("scope")) if scope else F.lit(None)
    many = scope and dict(queries.dtypes)["scope"].startswith("array")
    asked = _blocks(queries, "query_id", F.col("scope") if many else one(), rows).toDF("asked", "matrix", "wanted")
    pairs = _blocks(vectors, "chunk_id", one(), rows).crossJoin(F.broadcast(asked) if small else asked)  # blocks, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (row,) = batch.slice(n, 1).to_pylist()  # one pair of blocks at a time
                chunk, query = np.array(row["ids"]), np.array(row["asked"])
                x, q = np.frombuffer(row["vectors"]).reshape(len(chunk), -1), np.frombuffer(row["matrix"]).reshape(len(query), -1)
                distance = np.round(1 - q @ x.T, 6) + 0.0  # no negative zero
                if scope:
                    distance[~_allowed(row["wanted"], row["scopes"])] = np.inf
                order = np.argsort(chunk, kind="stable")  # ties go to the smaller id
                best = order[np.argsort(distance[:, order], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(distance, best, 1)
                i, j = np.nonzero(np.isfinite(found))
                yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(chunk[best[i, j]]), pa.array(found[i, j])], names=["query_id", "chunk_id", "distance"])

    found = pairs.mapInArrow(run, "query_id long, chunk_id long, distance double")
    return _top(found, "query_id", [F.asc("distance"), F.asc("chunk_id")], k)


def rrf_fuse(lists: list[DataFrame], chunks: DataFrame, k: int = 10, c: int = 60, key: str = "prefix") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank): query_id, chunk_id, rrf, rank.

    key="prefix": candidates of one ticker, filing date and first 120 characters are one candidate; its first seen row
    stands for it. key="chunk_id": each chunk is its own.
    """
    union = None
    for i, x in enumerate(lists):
        rows = _apart(x.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")))
        union = rows if union is None else union.unionByName(rows)
    keys = ["chunk_id"]
    if key == "prefix":
        union = union.join(chunks.select("chunk_id", "ticker", "filing_date", F.left("content", F.lit(120)).alias("prefix")), "chunk_id")
        keys = ["ticker", "filing_date", "prefix"]
    union = union.withColumn("key", F.xxhash64(*keys) if key == "prefix" else F.col("chunk_id"))
    fused = union.groupBy("query_id", "key").agg(F.sum(1 / (c + F.col("rank"))).alias("rrf"), F.min_by("chunk_id", F.struct("list", "rank")).alias("chunk_id"), F.min(F.struct("list", "rank")).alias("seen"))
    fused = fused.withColumn("rrf", F.round("rrf", 8))
    return _top(fused, "query_id", [F.desc("rrf"), F.asc("seen"), F.asc("chunk_id")], k).select("query_id", "chunk_id", "rrf", "rank")


def dedupe_newest(candidates: DataFrame, chunks: DataFrame, prefix: int = 200) -> DataFrame:
    """Of a query's candidates with one beginning the newest stays; ranks anew, newest first, then in the order before."""
    rows = candidates.join(chunks.select("chunk_id", "filing_date", F.left("content", F.lit(prefix)).alias("start")), "chunk_id")
    one = Window.partitionBy("query_id", "start").orderBy(F.desc("filing_date"), F.asc("rank"))
    kept = rows.withColumn("k", F.row_number().over(one)).filter("k = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("filing_date"), F.asc("rank"))
    return kept.withColumn("rank", F.row_number().over(order)).drop("k", "start", "filing_date")


def overlap_score(question: Column, content: Column) -> Column:
    """The default pair score: share of the question's distinct tokens that the content has."""
    asked = F.array_distinct(tokenize(question))
    return F.size(F.array_intersect(asked, tokenize(content))) / F.greatest(F.lit(1), F.size(asked))


def _overlaps(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates with the ``overlap_score`` as score: each question and each chunk in the lists is split once, however many lists it is in."""
    asked = queries.join(candidates.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.array_distinct(tokenize(F.col("question"))).alias("asked"))
    own = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.array_distinct(tokenize(F.col("content"))).alias("own"))
    rows = candidates.join(own, "chunk_id").join(asked, "query_id")
    return rows.withColumn("score", F.size(F.array_intersect("asked", "own")) / F.greatest(F.lit(1), F.size("asked")))


def rerank_topk(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """query_id, chunk_id, score, rank by a pair score of question and content (a column function, or a pandas UDF)."""
    pairs = candidates.select("query_id", "chunk_id", F.col("rank").alias("before"))
    if score is overlap_score:
        rows = _overlaps(pairs, queries, chunks)
    else:
        rows = pairs.join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "question"), "query_id")
        rows = rows.withColumn("score", score(F.col("question"), F.col("content")))
    rows = rows.select("query_id", "chunk_id", "before", F.round("score", 3).alias("score"))
    return _top(rows, "query_id", [F.desc("score"), F.asc("before")], k).select("query_id", "chunk_id", "score", "rank")


def search(queries: DataFrame, chunks: DataFrame, dense: DataFrame, mode: str, k: int = 10, pool: int = 100, bm25: DataFrame | None = None) -> DataFrame:
    """Ranked chunks of a mode: dense, bm25, hybrid or rerank. dense and bm25: the lists of the pool's length, made once."""
    bm25 = bm25_topk(queries, chunks, pool) if bm25 is None else bm25
    if mode in ("dense", "bm25"):
        return (dense if mode == "dense" else bm25).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    fused = rrf_fuse([dense, bm25], chunks, k if mode == "hybrid" else pool)
    if mode == "hybrid":
        return fused.select("query_id", "chunk_id", "rank")
    return rerank_topk(dedupe_newest(fused, chunks), queries, chunks, k).select("query_id", "chunk_id", "rank")


def first_hit_rank(hits: DataFrame, golden: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, type, rank of the first hit within k, or null. golden: query_id, type, snippets, filing_date (null: any)."""
    near = hits.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "content", F.col("filing_date").alias("filed")), "chunk_id")
    rows = near.join(golden.select("query_id", "snippets", "filing_date"), "query_id")
    hit = F.exists("snippets", lambda s: F.contains(F.col("content"), s)) & (F.col("filing_date").isNull() | (F.col("filing_date") == F.col("filed")))
    first = rows.filter(hit).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.select("query_id", "type").join(first, "query_id", "left")


def retrieval_metrics(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """n, hit_at_1, hit_at_5, hits_at_5, mrr; by: also missed, the ids without a hit."""
    share = lambda k: F.round(F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    metrics = [
        F.count(F.lit(1)).alias("n"),
        share(1).alias("hit_at_1"),
        share(5).alias("hit_at_5"),
        F.count_if(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("hits_at_5"),
        F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("mrr"),
    ]
    if by is None:
        return ranks.agg(*metrics)
    return ranks.groupBy(by).agg(*metrics, F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.col("query_id")))).alias("missed"))


def evaluate(golden: DataFrame, chunks: DataFrame, lists: dict[str, DataFrame], k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ranks (mode, query_id, type, rank), metrics (mode and those of retrieval_metrics, with the ids missed) and not_found
    (mode, query_id, score, start) of the ranked lists of several modes. Metrics are of the entries that have an answer."""
    answerable, ranks, blank = golden.filter("type <> 'not_found'"), None, None
    for mode, hits in lists.items():
        of_mode = _apart(first_hit_rank(hits, answerable, chunks, k)).withColumn("mode", F.lit(mode))
        ranks = of_mode if ranks is None else ranks.unionByName(of_mode)
        scored = hits if "score" in hits.columns else hits.withColumn("score", F.lit(None).cast("double"))
        top = not_found_top_scores(scored, golden, chunks).withColumn("mode", F.lit(mode))
        blank = top if blank is None else blank.unionByName(top)
    return ranks, retrieval_metrics(ranks, "mode"), blank


def not_found_top_scores(hits: DataFrame, golden: DataFrame, chunks: DataFrame, length: int = 150) -> DataFrame:
    """Of each unanswerable entry the best score and the beginning of its chunk."""
    best = hits.filter("rank = 1").join(chunks.select("chunk_id", "content"), "chunk_id")
    best = best.select("query_id", "score", F.translate(F.left("content", F.lit(length)), "\n", " ").alias("start"))
    return golden.filter("type = 'not_found'").select("query_id").join(best, "query_id", "left")


def pool_sweep(ranked: DataFrame, scored: DataFrame, needles: DataFrame, chunks: DataFrame, pools: tuple[int, ...] = (30, 100, 300)) -> DataFrame:
    """For each query and pool: matching candidates, best fused rank, best reranked rank (both from 0) and its score.

    ranked: query_id, chunk_id, rank. scored: query_id, chunk_id, score. needles: query_id, needle. No deduplication.
    """
    sizes = ranked.sparkSession.createDataFrame([(p,) for p in pools], "pool int")
    rows = ranked.select("query_id", "chunk_id", "rank").join(scored.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"])
    rows = rows.join(chunks.select("chunk_id", "content"), "chunk_id").join(needles, "query_id").withColumn("match", F.contains("content", "needle")).drop("content", "needle")
    rows = rows.join(F.broadcast(sizes), F.col("rank") <= F.col("pool"))
    order = Window.partitionBy("query_id", "pool").orderBy(F.desc("score"), F.asc("rank"))
    rows = rows.withColumn("reranked", F.row_number().over(order))
    return rows.groupBy("query_id", "pool").agg(
        F.count_if("match").alias("matches"),
        (F.min(F.when(F.col("match"), F.col("rank"))) - 1).alias("fused_rank"),
        (F.min(F.when(F.col("match"), F.col("reranked"))) - 1).alias("reranked_rank"),
        F.max(F.when(F.col("match"), F.col("score"))).alias("score"),
    )


def top_sections_report(hits: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of each query as an ordered array of (rank, section, content), cut and on one line."""
    line = lambda c, size: F.translate(F.left(c, F.lit(size)), "\n", " ")
    rows = hits.filter(F.col("rank") <= n).select("query_id", "chunk_id", "rank").join(chunks, "chunk_id")
    row = F.struct("rank", line("section", 35).alias("section"), line("content", 400).alias("content"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
