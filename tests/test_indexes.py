"""Indexes that spare scans and pairs: postings by bucket and block, q-grams, cells, percentiles by selection."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeqa.functions import text
from lakeqa.operators import packing, retrieval, routing, selection, substrings

CHUNK = "chunk_id long, ticker string, filing_date date, content string"


def corpus(spark, n=400, seed=1):
    """Chunks with a few common words, many rare ones, equal texts and empty ones."""
    random.seed(seed)
    words = [f"common{i}" for i in range(6)] + [f"rare{i}" for i in range(300)]
    text = lambda: " ".join(random.choices(words, [40] * 6 + [1] * 300, k=random.choice([0, 1, 5, 30, 80])))
    rows = [(i, random.choice(["A", "B", None]), random.choice(["2024-01-01", "2025-01-01", None]), text()) for i in range(n)]
    rows += [(n + i, "A", None, rows[7][3]) for i in range(5)] + [(n + 9, "B", "2024-01-01", None)]
    frame = spark.createDataFrame(rows, "chunk_id long, ticker string, filing_date string, content string")
    return rows, frame.withColumn("filing_date", F.col("filing_date").cast("date"))


def asked(spark, n=30):
    random.seed(2)
    pool = [f"common{i}" for i in range(6)] + [f"rare{i}" for i in range(300)] + ["absent"]
    return spark.createDataFrame([(i, " ".join(random.choices(pool, k=random.choice([1, 2, 4])))) for i in range(n)], "query_id int, question string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    _, chunks = corpus(spark)
    path = str(tmp_path_factory.mktemp("bm25"))
    return chunks, retrieval.write_index(chunks.withColumn("cell", routing.cell_of("ticker", "filing_date")), path, buckets=16), path


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_skipped_blocks_change_nothing(spark, stored, monkeypatch):
    """With blocks of three postings most are skipped for short questions, and the lists are the same."""
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    chunks, _, _ = stored
    queries = asked(spark)
    index = retrieval.build_index(chunks)
    for k in (1, 4, 50):
        assert rows_of(retrieval.bm25_topk(queries, index, k, prune=True)) == rows_of(retrieval.bm25_topk(queries, index, k))
    scope = queries.select("query_id").join(chunks.select("chunk_id").filter("chunk_id % 3 = 0"))
    assert rows_of(retrieval.bm25_topk(queries, index, 4, scope=scope, prune=True)) == rows_of(retrieval.bm25_topk(queries, index, 4, scope=scope))


def test_groups_of_a_term(spark):
    """A term that all chunks have is spread over groups, blocks are ordered by impact, and the lists do not change."""
    _, chunks = corpus(spark)
    blocks = retrieval.postings(chunks.select("chunk_id", "content"), group=50).filter("term = 'common0'").collect()
    assert sum(b.block == 0 for b in blocks) >= 8 and sum(b.n for b in blocks) == chunks.filter("content RLIKE '(^| )common0( |$)'").count()
    for b in blocks:
        tf = [-p.minus_tf for p in b.postings]
        assert tf == sorted(tf, reverse=True) and b.top_tf == tf[0] and b.least_dl == min(p.dl for p in b.postings)


def test_buckets_are_pruned(spark, stored):
    """Spark reads the folders of the terms asked for, which the plan finds out at run time."""
    _, _, path = stored
    one = spark.createDataFrame([(1, "rare7")], "query_id int, question string")
    df = retrieval.bm25_topk(one, retrieval.read_index(spark, path), 3)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "postings" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


def test_cells(spark, stored):
    """Scoped lists by cells are those by pairs of questions and chunks, which are never made for them."""
    chunks, index, _ = stored
    import datetime

    day = datetime.date(2024, 1, 1)
    spec = [("A", None), ("A", [day]), (None, [day]), (None, None), ("B", [day, datetime.date(2025, 1, 1)]), ("Z", None), ("A", [datetime.date(1999, 1, 1)]), (None, [])]
    routed = spark.createDataFrame([(i, *spec[i % len(spec)]) for i in range(30)], "query_id int, ticker string, dates array<date>")
    cells = routing.cells_of(routed, routing.cell_dictionary(chunks))
    by = {r.query_id: r.cells for r in cells.collect()}
    assert by[3] is None and by[5] == [] and by[7] == [] and len(by[0]) == 3 and len(by[1]) == 1 and len(by[2]) == 3
    pairs = routing.scope_join(routed, chunks)
    allowed = lambda t, d, row: (t is None or t == row.ticker) and (d is None or row.filing_date in d)
    want = sorted((i, row.chunk_id) for i in range(30) for row in chunks.collect() if allowed(*spec[i % len(spec)], row) and not (spec[i % len(spec)][1] is not None and row.filing_date is None))
    assert rows_of(pairs) == want
    for k in (1, 7):
        assert rows_of(retrieval.bm25_topk(asked(spark), index, k, cells=cells)) == rows_of(retrieval.bm25_topk(asked(spark), index, k, scope=pairs))


def test_dense_cells(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=4).tolist(), int(rng.integers(0, 5))) for i in range(80)]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<double>, scope long")
    wanted = {0: [1, 3], 1: None, 2: [], 3: [9], 4: [2]}
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist(), w) for i, w in wanted.items()], "query_id long, embedding array<double>, scope array<long>")
    got = retrieval.dense_topk(queries, vectors, 6, scope=True, rows=13)
    asked_for = {r.query_id: r.embedding for r in queries.collect()}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for q, w in wanted.items():
        near = sorted((round(1 - float(unit(asked_for[q]) @ unit(x)), 6), i) for i, x, c in data if w is None or c in w)[:6]
        assert [r.chunk_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in near]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    """Needles of all lengths, repeated, empty, null and with characters of two code units, against every pair."""
    random.seed(seed)
    text = lambda n: "".join(random.choice("ab😀é\n") for _ in range(n))
    bodies = [(i, "AB"[i % 2], text(random.choice([0, 1, 2, 5, 40, 400]))) for i in range(60)] + [(60, "A", None), (61, "B", "")]
    needles = [(i, random.choice(["A", None]), text(n)) for i, n in enumerate([0, 1, 2, 3, 4, 6, 7, 8, 14, 15, 16, 30, 31, 32, 50, 100] * 2)]
    for i in range(40):  # parts of the texts
        body = random.choice([b for _, _, b in bodies if b])
        at = random.randrange(len(body))
        needles.append((100 + i, None, body[at : at + random.randrange(1, 80)]))
    needles += [needles[-1], (900, None, None)]
    found = substrings.substring_join(
        spark.createDataFrame(needles, "needle_id int, own string, needle string"),
        spark.createDataFrame(bodies, "chunk_id int, ticker string, content string"),
        scope=("ticker",),
        condition=F.col("own").isNull() | (F.col("own") == F.col("ticker")),
    )
    want = sorted((i, c) for i, own, x in needles for c, ticker, body in bodies if x is not None and body is not None and x in body and own in (None, ticker))
    assert sorted((r.needle_id, r.chunk_id) for r in found.collect()) == want and len(want) > 300


def test_substring_plan(spark, tmp_path):
    """No pairs are made; a stored index gives the same."""
    random.seed(4)
    bodies = spark.createDataFrame([(i, "T", None, " ".join(f"word{random.randrange(99)}" for _ in range(200))) for i in range(100)], CHUNK)
    golden = spark.createDataFrame([(1, None, None, ["word1 word2", "no such thing in any of them"]), (2, "T", None, ["word9 word"])], "query_id int, ticker string, filing_date date, snippets array<string>")
    found = packing.snippet_match(golden, bodies)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    substrings.gram_index(bodies, [4, 8], scope=("ticker", "filing_date")).write.partitionBy("q").parquet(str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    short = golden.withColumn("snippets", F.filter("snippets", lambda s: F.length(s) < 16))
    assert rows_of(packing.snippet_match(short, bodies, index)) == rows_of(packing.snippet_match(short, bodies)) != []


def test_rarest_run(spark):
    """Boilerplate in a needle costs nothing: it is looked up by the part that few chunks have."""
    boiler = "all rights reserved by the company and its partners " * 2
    bodies = spark.createDataFrame([(i, boiler + f"number {i} of the series is quite special " + boiler) for i in range(300)], "chunk_id int, content string")
    needles = spark.createDataFrame([(boiler + "number 77 of the series is quite special " + boiler, 16)], "needle string, q int")
    assert substrings.candidates(needles, substrings.gram_index(bodies, [16]), [16]).count() <= 20


def percentile(values, p):
    values, place = sorted(values), p * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("few", [0, 5000])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    random.seed(8)
    cases = {
        "wide": [random.expovariate(1) ** 9 for _ in range(3000)],
        "ties": [random.choice([1.0, 2.0, 2.0, 7.0]) for _ in range(100)],
        "far": [-1e308, 1e308, 0.0, 1e-300, 5e-324, -5e-324, 1.0],
        "near": [1.0 + i * 2**-52 for i in range(5)],
        "one": [4.0],
        "infinite": [float("inf"), 1.0, 2.0, 3.0, 4.0, float("-inf"), 5.0],
    }
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
        shares = [0.0, 0.25, 0.5, 1.0] if name != "infinite" else [0.5]
        with np.errstate(all="ignore"):
            assert selection.exact_percentiles(df, "v", shares, 10) == [percentile(values, p) for p in shares], name
    assert selection.exact_percentiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    assert selection.exact_percentiles(spark.range(101), "id", [0.95]) == [95.0]


def test_scores_are_bounded(spark, stored, monkeypatch):
    """Tasks that score grow with the groups; rounds of questions, questions dealt to parts and listed chunks twice change no list."""
    chunks, index, _ = stored
    queries = asked(spark)
    scope = queries.select("query_id").join(chunks.select("chunk_id").filter("chunk_id % 3 = 0"))
    cells = queries.select("query_id", F.when(F.col("query_id") % 3 > 0, F.array(F.col("query_id").cast("long"))).alias("cells")).join(chunks.select(routing.cell_of("ticker", "filing_date").alias("c")).agg(F.min("c").alias("c")))
    cells = cells.select("query_id", F.when(F.col("cells").isNotNull(), F.array("c")).alias("cells"))
    lists = lambda: [rows_of(retrieval.bm25_topk(queries, index, 6, **kinds)) for kinds in ({}, {"scope": scope}, {"cells": cells}, {"scope": scope, "cells": cells}, {"prune": True})]
    want = lists()
    for name, value in (("SCORES", 1000), ("TERMS", 20)):
        monkeypatch.setattr(retrieval, name, value)
        assert lists() == want
    monkeypatch.setattr(retrieval, "TERMS", 500_000)
    monkeypatch.setattr(retrieval, "GROUP", 10)
    df = retrieval.bm25_topk(queries, index, 6)
    assert rows_of(df) == want[0]
    assert "hashpartitioning(grp" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 82)" in plan


def test_postings_are_dealt_as_numbers(spark, stored):
    """What is dealt to the tasks that score are lists of numbers, not structs; cells go along only for questions that have them."""
    chunks, _, path = stored
    index, queries = retrieval.read_index(spark, path), asked(spark)
    cells = routing.cells_of(queries.select("query_id", F.lit("A").alias("ticker"), F.lit(None).cast("array<date>").alias("dates")), routing.cell_dictionary(chunks))
    for kinds, sent in (({}, False), ({"cells": cells}, True)):
        df = retrieval.bm25_topk(queries, index, 6, **kinds)
        assert rows_of(df) == rows_of(retrieval.bm25_topk(queries, retrieval.build_index(chunks.withColumn("cell", routing.cell_of("ticker", "filing_date"))), 6, **kinds))
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "minus_tf" in line and "Project" in line]
        assert dealt and all(("cell#" in line) == sent for line in dealt)


def test_stored_blocks_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """More text is more tasks that sort the postings of an index, each of about the same number of blocks, and the lists do not change."""
    _, chunks = corpus(spark)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    chars = chunks.agg(F.sum(F.length("content"))).head()[0]
    tasks, lists = {}, []
    for n in (8, 96):
        monkeypatch.setattr(retrieval, "CHARS", math.ceil(chars / n), raising=False)
        index = retrieval.write_index(chunks, str(tmp_path / f"of{n}"), buckets=16)
        task = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        tasks[n] = [r["count"] for r in index.postings.groupBy(task.alias("task")).count().collect()]
        lists.append(rows_of(retrieval.bm25_topk(asked(spark), index, 6)))
    assert len(tasks[8]) == 8 and len(tasks[96]) == 96 and sum(tasks[8]) == sum(tasks[96])
    assert max(tasks[96]) <= 3 * sum(tasks[96]) / 96
    monkeypatch.setattr(retrieval, "SORTS", 24)
    index = retrieval.write_index(chunks, str(tmp_path / "most"), buckets=16)
    assert index.postings.select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).distinct().count() == 24
    assert lists[0] == lists[1] == rows_of(retrieval.bm25_topk(asked(spark), retrieval.build_index(chunks), 6))


def test_chunk_listed_twice(spark):
    """Two rows of one chunk id in a group add up, as they do in different groups."""
    rows = [(i, f"apple pear{i}") for i in range(6)] + [(2, "apple apple pear2"), (9, "plum")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "pear2 apple")], "query_id int, question string")
    got = {group: rows_of(retrieval.bm25_topk(queries, retrieval.build_index(chunks.coalesce(n)), 3)) for group, n in (("one", 1), ("several", 4))}
    assert got["one"] == got["several"]


def test_tokens_in_python(spark):
    """Tokens of an index are those of ``tokenize``, whatever the text, and in slices of a table too."""
    random.seed(5)
    texts = ["", None, "   ", "a", "As the US's class glasses's ss sss", "İstanbul Kelvin ſtraße ’s 's ’S’s", "naïve—dashes 10-K’s 3.5% x_y\tz\n\x0b\x1c\x85 tab", "😀😀 ab😀cd 日本 gas bus", "s" * 3 + " " + "s" * 4, "whos whose does doess", "end"]
    pool = ["s", "'", "’", "S", "a", "9", " ", "é", "😀", "was", "its", "İ", "-"]
    texts += ["".join(random.choices(pool, k=random.choice([0, 1, 5, 60]))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = rows.select("i", text.plain(F.col("t")).alias("p"), text.tokenize(F.col("t")).alias("want")).orderBy("i").toArrow().combine_chunks()
    want = [w or [] for w in got["want"].to_pylist()]
    plain = got["p"].chunk(0)
    assert text.tokens_of(plain).to_pylist() == want and sum(map(len, want)) > 300
    assert [x for at in range(0, len(plain), 7) for x in text.tokens_of(plain.slice(at, 7)).to_pylist()] == want
    assert text.tokens_of(plain.slice(0, 0)).to_pylist() == []


def test_order_of_postings():
    """One sort of packed numbers orders postings as a sort by four keys does, and where 63 bits do not hold them that sort is taken."""
    rng = np.random.default_rng(6)
    for most in (5, 2**40):
        code, row = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(30), indexing="ij"))
        tf, dl = rng.integers(1, most, len(code), endpoint=True), rng.integers(0, 2**30 if most > 5 else 4, 30).astype(np.int32)
        order = np.lexsort((row, dl[row], -tf, code))
        got = retrieval._by_impact(code, row, tf, dl)
        assert all((a == b[order]).all() for a, b in zip(got, (code, row, tf), strict=True))
