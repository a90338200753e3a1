"""Line dedup, hard negatives and source divergence: brute force, edge cases, clashing names."""

import collections
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeqa.llm import divergence, hard_negatives, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute_lines(rows, least=10):
    """(id, text) -> (lines, lines dropped, what is left), row by row; null ids are the last document."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), i), i, key=order)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made_rows(n=300, seed=3):
    random.seed(seed)
    pool = ["A common Footer line", " a common footer LINE\t", "short", "", "naïve ÀÉ Zeile", "naïve ÀÉ zeile", "naïve àé zeile", "ten chars!", "ten chars", *(f"line number {i} of many" for i in range(200))]
    rows = [(random.randint(0, n // 2), "\n".join(random.choice(pool) for _ in range(random.randint(0, 12)))) for _ in range(n)]
    rows += [(None, "a common footer line\nonly here and nowhere"), (None, None), (5, None), (6, ""), (7, "\n\n"), (8, "x\r\nlast line of all\r"), (9, "LAST LINE OF ALL\n" * 5000)]
    return rows + rows[:5]


@pytest.mark.parametrize("batches, fanout", [(1, 4), (7, 2), (8, 4)])
def test_lines(spark, batches, fanout):
    rows = made_rows()
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches, fanout).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.clean_text) for r in got), key=repr) == brute_lines(rows)


def test_lines_of_other_ids(spark):
    """Ids that are no numbers, columns named like outputs and helpers, an empty table, a table of nulls only."""
    rows = [("b", "one line of text\nmy own line here", 1, "k", 0), ("a", "one line of text", 2, "k", 0), (None, "ONE LINE OF TEXT", 3, "k", 0)]
    docs = spark.createDataFrame(rows, "Key string, body string, n_dropped int, clean_text string, _h_row int")
    got = line_dedup.drop_lines(docs, text="body", id_column="Key")
    assert got.columns == ["Key", "body", "_h_row", "n_lines", "n_dropped", "clean_text"]
    assert {r.Key: (r.n_dropped, r.clean_text) for r in got.collect()} == {"a": (0, "one line of text"), "b": (1, "my own line here"), None: (1, "")}
    assert line_dedup.drop_lines(docs.limit(0), text="body", id_column="Key").collect() == []
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [(r.n_lines, r.n_dropped, r.clean_text) for r in line_dedup.drop_lines(nulls).collect()] == [(1, 0, "")] * 3
    clash = spark.createDataFrame([(2, "one line of text"), (1, "one line of text")], "n_lines long, clean_text string")
    got = line_dedup.drop_lines(clash, text="clean_text", id_column="n_lines")
    assert sorted(r.clean_text for r in got.collect()) == ["", "one line of text"]


def test_runs(spark, tmp_path):
    """Runs are levelled, sorted and bucketed; a later call knows them; a batch that comes again changes nothing."""
    path = str(tmp_path / "runs")
    docs = spark.createDataFrame([(i, f"a line that all of them have\nown line number {i}") for i in range(40)], "doc_id long, text string")
    line_dedup.drop_lines(docs, 5, 2, path=path).collect()
    runs = line_dedup.Runs(spark, path, 2)
    assert [level for level, *_ in runs.folders()] == [0, 2]
    held = runs.holders("bigint")
    assert held.count() == 41 and held.select("hash").distinct().count() == 41
    for *_, folder in runs.folders():
        for name in os.listdir(f"{path}/{folder}"):
            if name.endswith(".parquet"):
                hashes = [bytes(r.hash) for r in spark.read.parquet(f"{path}/{folder}/{name}").collect()]
                assert hashes == sorted(hashes)
    runs.close()
    later = spark.createDataFrame([(3, "A LINE that all of them have\nnew line of the third"), (1, "a line that all of them have\nown line number 1")], "doc_id long, text string")
    for _ in range(2):
        got = {r.doc_id: (r.n_dropped, r.clean_text) for r in line_dedup.drop_lines(later, 1, 2, path=path).collect()}
        assert got == {3: (1, "new line of the third"), 1: (1, "own line number 1")}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_not_shuffled(spark, tmp_path):
    """A batch is dealt out by the hash once; the runs that it is merged with are not."""
    runs = line_dedup.Runs(spark, str(tmp_path), 4)
    lines = lambda a, b: spark.range(a, b).select(F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 16).alias("hash"), F.col("id").alias("holder"))
    for i in range(3):
        runs.add(lines(10 * i, 10 * i + 15))
    assert runs.holders("bigint").count() == 35
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = lines(0, 50).groupBy("hash").agg(F.min("holder").alias("holder"))
        for *_, name in runs.folders():
            keys = keys.join(runs.table(name, "bigint").select("hash"), "hash", "left_anti")
        plan = keys._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3
    runs.close()


def brute_negatives(rows, positives, negatives, low, high, scale, asks):
    """rows: id, label, vector."""
    fine = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in fine:
        if asks(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        score = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in fine]  # noqa: B905
        near = sorted((s, i) for s, i, other in score if other == lab and i != a)[:positives]
        far = sorted((s, i) for s, i, other in score if other != lab)
        for s, p in near:
            hits = [(t, i) for t, i in far if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hits)]
    return sorted(out)


def mined(df, **options):
    rows = hard_negatives.mine(df, F.col("id") % 3 == 0, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows)


@pytest.mark.parametrize("blocks", [(4096, 512), (7, 3)])
def test_negatives(spark, monkeypatch, blocks):
    """Ties, negative scores, small label groups, nulls, repeated rows, short and empty vectors, many blocks."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", blocks[1])
    random.seed(5)
    vector = lambda: [random.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, random.choice([0, 0, 0, 1, 2]), vector()) for i in range(90)] + [(90, 7, vector()), (93, 8, [1.0] * 4), (94, 8, [1.0] * 4)]
    rows += [(96, None, vector()), (99, 1, None), (102, 1, [1.0, None, 0.0, 0.0]), (105, 1, [float("nan")] * 4), (108, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, vector())]
    rows += [(111, 0, [1.0, 0.5]), (112, 0, []), (114, 1, []), rows[3], rows[4], (6, 2, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = mined(df, positives=4, negatives=3, scale=8)
    want = brute_negatives(rows, 4, 3, 30, 90, 8, lambda i: i % 3 == 0)
    assert got == want and len(got) > 100


def test_negatives_that_are_large(spark, monkeypatch):
    """Scores beyond 2**53 are exact; those that are too large are an error; anchors go out in blocks where they are many."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 0)
    random.seed(6)
    rows = [(i, i % 2, [float(random.randint(-(2**29), 2**29)) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = mined(df, scale=1)
    assert got == brute_negatives(rows, 5, 10, 30, 90, 1, lambda i: i % 3 == 0) and max(r[4] for r in got) > 2**53
    assert mined(df.limit(0)) == [] and mined(df.filter("id = 3"), scale=1) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark.createDataFrame([(i, 0, [1e18, 1.0]) for i in range(4)], "id long, label int, vector array<double>"), scale=1)


def test_slots():
    """Each slot has its best columns, however the block is cut up."""
    rng = np.random.default_rng(1)
    score = rng.integers(-50, 50, (20, 300))
    edges = -np.sort(-rng.integers(-60, 60, (20, 4)), axis=1)
    for bound in (50, (1 << 62) // 40):
        found = collections.defaultdict(list)
        for slot, row, column in hard_negatives.best_in_slots(score.copy(), bound, edges, 5):
            for r, c in zip(row, column, strict=True):
                found[slot, int(r)].append((-score[r, c], int(c)))
        for slot, row in itertools.product(range(3), range(20)):
            want = sorted((-s, c) for c, s in enumerate(score[row]) if edges[row, slot + 1] < s <= edges[row, slot])[:5]
            assert sorted(found[slot, row])[:5] == want


def brute_divergence(rows, top=200, least=3):
    terms = [("".join(c.lower() if c < "\x80" else c for c in t), lang or "", source or "", r) for r, (text, lang, source) in enumerate(rows) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    groups = {(lang or "", source or "") for _, lang, source in rows}
    docs, n = collections.defaultdict(set), collections.Counter()
    for t, lang, source, r in terms:
        docs[lang, t].add(r)
        n[lang, source, t] += 1
    out = []
    for lang, source in groups:
        kept = sorted(t for (x, t), d in docs.items() if x == lang and len(d) >= least)
        others = sorted(s for x, s in groups if x == lang)

        def p(sources, kept=kept, lang=lang):
            count = {t: sum(n[lang, s, t] for s in sources) for t in kept}
            total = sum(count.values())
            return {t: 1 + 10**9 * (c + 1) // (total + len(kept)) for t, c in count.items()}

        own, whole = p([source]), p(others)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(f(own[t], q[t]) for t in kept), s.encode()) for s in others if s != source for q in [p([s])]]
        words = [(-f(own[t], whole[t]), t.encode()) for t in kept if n[lang, source, t] and own[t] > whole[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def audited(df, **options):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **options).collect())


def test_divergence(spark, monkeypatch):
    """Copies within and across sources, nulls, groups and languages without terms, terms that few have, ties."""
    monkeypatch.setattr(divergence, "FLUSH", 50)
    random.seed(7)
    words = ["Apple", "apple", "Über", "naïve", "日本", "it's", "x2y", "foo_bar", "É", "é", *(f"w{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60))]
    text = lambda: " ".join(random.choice(words[: random.choice([5, 20, 70])]) for _ in range(random.randint(0, 15)))
    rows = [(text(), random.choice(["en", "de", None]), random.choice(["a", "b", "C", "é", None])) for _ in range(120)]
    rows += rows[:10] + [(rows[0][0], "en", s) for s in "abC" for _ in range(9)] + [(None, "en", "empty"), ("123 !!", "fr", "a"), ("", "fr", "b"), ("rare", "it", "a"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = audited(df)
    assert got == brute_divergence(rows) and {r[2] for r in got} == {"pair", "term"}
    assert audited(df, top=3, least=1) == brute_divergence(rows, 3, 1)
    assert audited(df.limit(0)) == []


def test_divergence_of_large_counts(spark):
    """A count times SCALE beyond a long."""
    counts = spark.range(1).select(F.lit(2**40).alias("n"), F.lit(2**42).alias("total"), F.lit(5).cast("long").alias("v"))
    assert counts.select(divergence._p("n")).head()[0] == 1 + 10**9 * (2**40 + 1) // (2**42 + 5)


def test_terms():
    want = [t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "Don't STOP_naïve ÀB\x00c 日本語 a1b z")]
    assert [t.decode() for t in divergence.terms_of("Don't STOP_naïve ÀB\x00c 日本語 a1b z".encode())] == want


def test_line_digest(spark):
    """The query's digest is that of the text that is left."""
    rows = line_dedup.op11_line_dedup(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r.doc_id: r.clean_text for r in line_dedup.drop_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
