"""Hybrid search of vectors and BM25 against lists made one pair at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeqa.operators import corpus, retrieval
from tests.test_operators import brute_bm25

WORDS = [f"word{'abcdefgh'[i % 8] * (1 + i // 8)}" for i in range(40)]


@pytest.fixture(scope="module")
def small(spark):
    random.seed(11)
    texts = {i: " ".join(random.choices(WORDS, k=random.randint(3, 25))) for i in range(50)}
    texts[50] = texts[3]
    asked = {i: " ".join(random.choices(WORDS, k=4)) for i in range(12)}
    chunks = spark.createDataFrame([(i, "T", None, t) for i, t in texts.items()], "chunk_id long, ticker string, filing_date date, content string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    return texts, asked, chunks, queries


def brute_lists(texts, asked, k):
    """(dense, bm25) ids of each question, best first."""
    ids = list(texts)
    x, q = corpus.hash_encode([texts[i] for i in ids]).astype(float), corpus.hash_encode(list(asked.values())).astype(float)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    near = np.round(1 - unit(q) @ unit(x).T, 6)
    dense = {i: [c for _, c in sorted(zip(near[n], ids, strict=True))[:k]] for n, i in enumerate(asked)}
    tokens = {i: t.split() for i, t in texts.items()}
    return dense, {i: [-c for _, c in brute_bm25(tokens, asked[i].split(), k)] for i in asked}


def brute_fused(texts, dense, bm25, k):
    """Reciprocal ranks added up by the first 120 characters."""
    sums, seen = {}, {}
    for n, ranked in enumerate((dense, bm25)):
        for rank, c in enumerate(ranked, 1):
            key = texts[c][:120]
            sums[key] = sums.get(key, 0) + 1 / (60 + rank)
            seen[key] = min(seen.get(key, (n, rank, c)), (n, rank, c))
    return [seen[key][2] for key in sorted(sums, key=lambda key: (-round(sums[key], 8), seen[key]))][:k]


def test_hybrid(spark, small):
    texts, asked, chunks, queries = small
    vectors = corpus.embed(chunks.select("chunk_id", "content"))
    dense = retrieval.dense_topk(corpus.embed(queries.select("query_id", F.col("question").alias("content"))), vectors, 20)
    bm25 = retrieval.bm25_topk(queries, chunks, 20)
    want_dense, want_bm25 = brute_lists(texts, asked, 20)
    ranked = lambda df: {i: [c for _, c in sorted((r["rank"], r.chunk_id) for r in rows)] for i, rows in group(df).items()}

    def group(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.query_id, []).append(r)
        return out

    assert ranked(bm25) == want_bm25
    assert ranked(dense) == want_dense
    hybrid = ranked(retrieval.search(queries, chunks, dense, "hybrid", 10, 20, bm25=bm25))
    assert hybrid == {i: brute_fused(texts, want_dense[i], want_bm25[i], 10) for i in asked}
    assert ranked(retrieval.search(queries, chunks, dense, "dense", 5, 20, bm25=bm25)) == {i: x[:5] for i, x in want_dense.items()}

    golden = queries.select("query_id", F.lit("numeric").alias("type"), F.array(F.lit(texts[7])).alias("snippets"), F.lit(None).cast("date").alias("filing_date"))
    lists = {mode: retrieval.search(queries, chunks, dense, mode, 10, 20, bm25=bm25) for mode in ("dense", "bm25", "hybrid", "rerank")}
    _, metrics, _ = retrieval.evaluate(golden, chunks, lists)
    mrr = {r["mode"]: r.mrr for r in metrics.collect()}
    place = lambda ids: next((1 / (n + 1) for n, c in enumerate(ids[:10]) if texts[7] in texts[c]), 0.0)
    for mode, found in (("dense", want_dense), ("bm25", want_bm25), ("hybrid", hybrid)):
        assert mrr[mode] == pytest.approx(sum(place(found[i]) for i in asked) / len(asked), abs=1e-6)
    assert set(mrr) == {"dense", "bm25", "hybrid", "rerank"}
