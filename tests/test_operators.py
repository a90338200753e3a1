"""Operators by hand-computed cases, invariants, and their oracles at a small size."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeqa.operators import corpus, logs, packing, retrieval, routing

HIT = "query_id int, rank int, chunk_id int, filing_id int, position int, header string, text string, filing_date string"


def test_html_to_text():
    page = "<p>One&nbsp;&amp; two</p><script>x</script><table><tr><td>a <b>b</b></td><td></td><td>c<tr><th>d</table><div>end<ix:header>hidden</ix:header></div>"
    assert corpus.html_to_text(page) == "One & two\na b | c\nd\nend"
    assert corpus.html_to_text(None) == ""


def test_chunks_of():
    assert corpus.chunks_of("short") == []
    line = "x" * 60
    got = corpus.chunks_of("\n".join([line] * 20))
    assert len(got) == 2 and got[0].endswith(got[1][:100].split("\n")[0][-10:])
    long = corpus.chunks_of("y" * 2000)
    assert [len(c) for c in long] == [800, 800, 700] and all(len(c) <= 951 for c in got + long)


def test_sections(spark):
    text = "Cover\nItem 1. Business\nabc\nItem 7\nx\nItem 1. Again\nmore"
    rows = corpus.split_sections(spark.createDataFrame([(1, text), (2, "plain\ntext")], "document_id int, text string")).orderBy("document_id", "section_order").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Unsectioned", "Cover"), (1, 1, "Item 1. Business", "abc\nmore"), (1, 2, "Item 7", "x"), (2, 0, "Unsectioned", "plain\ntext")]


def pack(spark, rows, budget=6000):
    got = packing.pack(spark.createDataFrame(rows, HIT), budget).collect()
    return got[0] if got else None


def test_pack_merges_overlap(spark):
    tail = "".join(chr(97 + i % 26) for i in range(150))
    row = pack(spark, [(1, 1, 10, 5, 0, "", "start " + tail, None), (1, 2, 11, 5, 1, "", tail + " end", None)])
    assert row.context == "start " + tail + " end" and row.blocks[0].chunk_ids == [10, 11]


def test_pack_keeps_apart(spark):
    row = pack(spark, [(1, 1, 10, 5, 0, "H", "alpha beta", None), (1, 2, 11, 5, 3, "H", "gamma delta", None), (1, 3, 12, 6, 1, "", "omega", None)])
    assert [b.text for b in row.blocks] == ["H\nalpha beta", "H\ngamma delta", "omega"]


def test_pack_drops_duplicates_and_stops(spark):
    row = pack(spark, [(1, 1, 1, 1, 0, "", "one two three four five", None), (1, 2, 2, 2, 0, "", "one two three four", None), (1, 3, 3, 3, 0, "", "z" * 50, None), (1, 4, 4, 4, 0, "", "six", None)], 60)
    assert [b.chunk_ids for b in row.blocks] == [[1]]  # the next one does not fit, and nothing behind it is taken


def test_pack_cuts_the_first(spark):
    row = pack(spark, [(1, 1, 1, 1, 0, "H", "a" * 100, None)], 50)
    assert len(row.context) == 50 and row.blocks[0].truncated
    assert pack(spark, []) is None


def test_filing_dates(spark):
    d = datetime.date
    registry = spark.createDataFrame([("ACM", 2024, d(2024, 11, 1)), ("ACM", 2025, d(2025, 10, 31))], "ticker string, fiscal_year int, filing_date date")
    asked = [(1, "in 2024?", "ACM"), (2, "now?", "acm"), (3, "in 2019?", "ACM"), (4, "in 2024?", "XYZ"), (5, "x", None), (6, "2024 or 2025", "ACM")]
    got = {r.query_id: r.dates for r in routing.resolve_filing_dates(spark.createDataFrame(asked, "query_id int, question string, ticker string"), registry).collect()}
    both = [d(2025, 10, 31), d(2024, 11, 1)]
    assert got == {1: both[1:], 2: both[:1], 3: both, 4: None, 5: None, 6: both}


def test_fusion_keys(spark):
    lists = [spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int"), spark.createDataFrame([(1, 11, 1)], "query_id int, chunk_id int, rank int")]
    same = "h" * 120
    chunks = spark.createDataFrame([(10, "A", None, same + "x"), (11, "A", None, same + "y")], "chunk_id int, ticker string, filing_date date, content string")
    prefix = retrieval.rrf_fuse(lists, chunks).collect()
    assert [(r.chunk_id, r.rrf) for r in prefix] == [(10, pytest.approx(2 / 61 + 1 / 62, abs=1e-8))]
    assert [r.chunk_id for r in retrieval.rrf_fuse(lists, chunks, key="chunk_id").orderBy("rank").collect()] == [11, 10]


def test_bm25_fills_up(spark):
    chunks = spark.createDataFrame([(i, "apple pie" if i == 3 else f"word{i} other{i}") for i in range(5)], "chunk_id int, content string")
    got = retrieval.bm25_topk(spark.createDataFrame([(1, "apple")], "query_id int, question string"), chunks, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [3, 0, 1] and got[1].score == 0


def brute_bm25(texts, question, k):
    """All chunks scored one by one, with the tokens that Spark makes."""
    import math
    from collections import Counter

    df = Counter(t for x in texts.values() for t in set(x))
    raw = {t: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean, avgdl = sum(raw.values()) / len(raw), sum(map(len, texts.values())) / len(texts)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    score = lambda x: sum(n * idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for t, n in Counter(question).items() if t in idf)
    return sorted(((round(score(x), 6) + 0.0, -i) for i, x in texts.items()), reverse=True)[:k]


@pytest.mark.parametrize("words, asked", [(["apple"] * 10 + ["pear"] * 10, "apple cherry"), (["apple"] * 3 + ["pear"] * 1, "apple"), (["plum pear", "plum", "plum fig", "plum"], "plum fig")])
def test_bm25_scores_of_zero_and_less(spark, words, asked, tmp_path):
    """A term in half of the chunks scores 0 and ties with chunks that lack it; a floor below 0 ranks behind those; both from a stored index."""
    chunks = spark.createDataFrame([(len(words) - i, w) for i, w in enumerate(words)], "chunk_id int, content string")
    queries = spark.createDataFrame([(1, asked)], "query_id int, question string")
    stored = retrieval.write_index(chunks, str(tmp_path / "index"))
    for k in (1, 3, 30):
        want = brute_bm25({len(words) - i: w.split() for i, w in enumerate(words)}, asked.split(), k)
        for source in (chunks, retrieval.read_index(spark, str(tmp_path / "index")), stored):
            got = retrieval.bm25_topk(queries, source, k).orderBy("rank").collect()
            assert [(r.score + 0.0, -r.chunk_id) for r in got] == want


def test_dense_blocks(spark):
    """Many question blocks and vector blocks, ties and no negative zeros, against all pairs."""
    import random

    random.seed(1)
    data = [(i, [float(random.choice([-1, 0, 1])) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(data, "chunk_id long, embedding array<double>")
    unit = {i: [a / (sum(b * b for b in x) ** 0.5 or 1e-300) for a in x] for i, x in data}
    rows = retrieval.dense_topk(v.withColumnRenamed("chunk_id", "query_id"), v, 5, rows=7).collect()
    got = {(r.query_id, r["rank"]): (r.distance, r.chunk_id) for r in rows}
    for q in unit:
        want = sorted((round(1 - sum(a * b for a, b in zip(unit[q], unit[c], strict=True)), 6) + 0.0, c) for c in unit)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(pytest.approx(d, abs=1e-6), c) for d, c in want] or [got[q, k + 1][0] for k in range(5)] == [pytest.approx(d, abs=1e-6) for d, _ in want]
    assert not any(str(r.distance) == "-0.0" for r in rows)


def test_corpus_batches(spark, tmp_path):
    """A batch that fails between its chunks and its documents is not seen, and loses nothing when it runs again."""
    from lakeqa.sources import tables

    docs = spark.createDataFrame([(1, "A", "x")], "document_id int, ticker string, source_path string")
    chunks = spark.createDataFrame([(1, "A", 0, "text")], "document_id int, ticker string, chunk_index int, content string")
    path = str(tmp_path / "corpus")
    tables.write_corpus(docs, chunks, path, "b1")
    broken = docs.select("document_id", "ticker", F.raise_error(F.lit("no")).cast("string").alias("source_path"))
    with pytest.raises(Exception, match="no"):
        tables.write_corpus(broken, chunks.withColumn("document_id", F.lit(2)), path, "b2")
    assert [x.count() for x in tables.read_corpus(spark, path)] == [1, 1]
    for _ in range(2):  # and once more
        tables.write_corpus(docs.withColumn("document_id", F.lit(2)), chunks.withColumn("document_id", F.lit(2)), path, "b2")
        assert sorted(r.document_id for r in tables.read_corpus(spark, path)[1].collect()) == [1, 2]


def test_build_corpus(spark):
    manifest = spark.createDataFrame([(1, "Acme", "ACM", "10-K", datetime.date(2024, 1, 1), "a"), (2, "Acme", "ACM", "10-K", datetime.date(2025, 1, 1), "b")], "document_id int, company string, ticker string, form_type string, filing_date date, source_path string")
    body = "The company makes things of many kinds and sells them to all who ask."
    pages = spark.createDataFrame([("a", f"<p>Item 1. Business</p><p>{body}</p>"), ("b", "<p>short</p>")], "source_path string, html string")
    rows = corpus.build_corpus(manifest, pages).collect()
    assert [(r.document_id, r.chunk_index, r.section, r.content) for r in rows] == [(1, 0, "Item 1. Business", f"Acme (ACM) 10-K | Item 1. Business\n{body}")]
    assert list(rows[0].embedding) == pytest.approx(list(corpus.hash_encode([rows[0].content])[0])) and sum(x * x for x in rows[0].embedding) == pytest.approx(1, abs=1e-5)
    assert [r.document_id for r in corpus.empty_filings(manifest, corpus.build_corpus(manifest, pages)).collect()] == [2]
    assert corpus.build_corpus(manifest, pages, docs=manifest.filter("document_id = 1")).collect() == []


def test_packed_vs_control(spark):
    tail = "".join(chr(97 + i % 26) for i in range(150))
    hits = spark.createDataFrame([(1, 1, 10, 5, 0, "", "start " + tail, None), (1, 2, 11, 5, 1, "", tail + " needle", None), (2, 1, 12, 6, 0, "", "other", None)], HIT)
    golden = spark.createDataFrame([(1, "numeric", ["needle"], None), (2, "narrative", ["absent"], None)], "query_id int, type string, snippets array<string>, filing_date string")
    metrics, ranks = packing.packed_vs_control(golden, hits, base=hits.filter("rank = 1"))
    assert {(r.system, r.query_id): r["rank"] for r in ranks.collect()} == {("PACKED", 1): 1, ("PROD", 1): 2, ("CONTROL", 1): 2, ("BASE", 1): None, ("PACKED", 2): None, ("PROD", 2): None, ("CONTROL", 2): None, ("BASE", 2): None}
    assert {r.system: r.mrr for r in metrics.collect()} == {"PACKED": 0.5, "PROD": 0.25, "CONTROL": 0.25, "BASE": 0.0}


def test_detect_ticker(spark):
    aliases = spark.createDataFrame([("ACM", "acme corp"), ("ACM", "acme"), ("ATT", "at&t"), ("BEE", "bee")], "ticker string, alias string")
    asked = spark.createDataFrame([(1, "How is Acme?"), (2, "AT&T or Bee"), (3, "beehive acmes"), (4, None), (5, "\tBEE's")], "query_id int, question string")
    got = {r.query_id: (r.ticker, r.status) for r in routing.detect_ticker(asked, aliases).collect()}
    assert got == {1: ("ACM", "single"), 2: (None, "multiple"), 3: (None, "zero"), 4: (None, "zero"), 5: ("BEE", "single")}
    bad = routing.validate_requests(spark.createDataFrame([("\t ab\n", " acm ")], "question string, ticker string"), ["ACM"]).head()
    assert (bad.question, bad.ticker, bad.reason) == ("ab", "ACM", "question too short")


def test_rate_limit_state():
    assert logs.allowed([0, 1, 2, 61, 61.5], [], 2, 60) == ([True, True, False, True, True], [61, 61.5])


def test_cache_state():
    rows = [(0.0, True, False), (86400.0, True, False), (86400.5, False, False), (86401.0, True, True), (90001.0, True, False), (90002.0, True, False)]
    assert logs.replayed(rows, None)[0] == ["miss", "hit", "expired", "miss", "hit", "expired"]


def test_partitioning_changes_nothing(spark):
    chunks = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5}") for i in range(40)], "chunk_id int, content string")
    asked = spark.createDataFrame([(1, "beta1 gamma2"), (2, "alpha")], "query_id int, question string")
    a = retrieval.bm25_topk(asked, chunks.repartition(1), 7).orderBy("query_id", "rank").collect()
    assert a == retrieval.bm25_topk(asked.repartition(3), chunks.repartition(5), 7).orderBy("query_id", "rank").collect()


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "chunk_id int, content string")
    asked = spark.createDataFrame([(1, "x")], "query_id int, question string")
    assert retrieval.bm25_topk(asked, chunks).collect() == []
    assert retrieval.retrieval_metrics(spark.createDataFrame([], "query_id int, rank int")).head().asDict() == {"n": 0, "hit_at_1": 0.0, "hit_at_5": 0.0, "hits_at_5": 0, "mrr": 0.0}


def test_dense_scope(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 1)], "chunk_id long, embedding array<double>, scope int")
    asked = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [1.0, 0.0], None)], "query_id long, embedding array<double>, scope int")
    got = retrieval.dense_topk(asked, vectors, 2, scope=True).orderBy("query_id", "rank").select("query_id", "chunk_id").collect()
    assert [tuple(r) for r in got] == [(7, 3), (7, 2), (8, 1), (8, 3)]
    assert retrieval.dense_topk(asked.filter(F.lit(False)), vectors, 2).collect() == []


def test_duplicate_pairs_at_any_distance(spark):
    words = ["north bridge river stone", "entirely other words here", "river stone bridge north", "one more passage now", "stone river north bridge today"]
    hits = [(1, i + 1, 10 * i, i, 0, "", w, None) for i, w in enumerate(words)] + [(2, 1, 70, 7, 0, "", words[0], None), (2, 2, 80, 8, 0, "", "", None)]
    got = {(r.query_id, r.number, r.other): r.duplicate for r in packing.duplicate_pairs(spark.createDataFrame(hits, HIT)).collect()}
    sets = [set(w.split()) for w in words]
    want = {(1, i + 1, j + 1): len(sets[i] & sets[j]) / len(sets[i]) >= 0.8 for i in range(5) for j in range(i)} | {(2, 2, 1): False}
    assert got == want and [k for k, v in got.items() if v] and got[1, 3, 1] and got[1, 5, 1] and got[1, 5, 3]


def test_overlap_of_chunks_apart(spark):
    tail = "t" * 150
    rows = [(1, 0, "a" + tail), (1, 1, tail + "b"), (1, 3, tail + "b"), (2, 4, "c"), (2, 5, "d")]
    got = corpus.adjacent_overlap(spark.createDataFrame(rows, "document_id int, chunk_index int, content string"), F.col("content")).collect()
    assert {(r.document_id, r.chunk_index): (r.adjacent, r.matches) for r in got} == {(1, 0): (False, False), (1, 1): (True, True), (1, 3): (False, False), (2, 4): (False, False), (2, 5): (True, False)}


def test_all_pieces_count(spark):
    import __spark_entry__
    from lakeqa.plans import corpus_queries, feeds

    sf = "/root/testdata/sf0.001"
    rows = corpus_queries.hits(spark, sf).collect()
    assert any(r.position >= 6 for r in rows) and all(r.chunk_id == (r.filing_id << 22) + r.position for r in rows)
    assert any(r.duplicate for r in __spark_entry__.queries()["near_duplicate_blocks"](spark, sf).collect())
    assert __spark_entry__.queries()["adjacent_overlap_all"](spark, sf).count() == feeds.pieces(spark, sf).count()


def test_pack_takes_late_pieces(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["pack"](spark, "/root/testdata/sf0.001").collect()
    assert any(i >> 22 > 0 and i % 2**22 >= 6 for r in rows for b in r.blocks for i in b.chunk_ids)
