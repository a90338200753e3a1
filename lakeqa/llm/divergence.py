"""Audit of how sources diverge in their words (operator 13), over collapsed copies.

1. Identical texts of a language are one text with a multiplicity for each source that has it. Copies are counted by
   (language, digest, source) and texts kept by (language, digest) before each shuffle, so a text that a third of all
   documents have is a row a task, and a text crosses the network once.
2. Each text is split into terms once, whatever its copies. A source's term count grows by the term's occurrences times
   the multiplicity, its document frequency by the multiplicity. Tasks sum up as many terms as FLUSH allows and pass the
   sums on; Spark adds them up.
3. A language keeps the terms of at least ``least`` of its documents. Every group, a source in a language, gives each kept
   term a probability p = 1 + floor(SCALE * (count + 1) / (N + V)), terms it lacks included.
4. The divergence of two groups is the sum over all kept terms of floor((p - q)^2 / q), evaluated where counts are
   not zero only: with the value f0 of a term that both lack, it is V * f0, plus what each group's own terms change
   against a term that the other lacks (by distinct probabilities, of which there are few), plus what terms that both
   have change. Only the last needs the terms themselves, and goes through terms by the groups that have them.

All arithmetic is in integers. Sums stay below 2**63 as the p of a group add up to about SCALE; beyond, Spark stops with
an error instead of a wrong value.

Null text, language or source counts as ''. Repeated rows count each. Groups without terms have p of terms they lack; a
language without kept terms has pairs of value 0. Ties in ranks go to the item first by UTF-8. An empty table gives an
empty result. Only the named columns are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeqa.llm.common import Tables, read, text_of

SCALE = 1_000_000_000
#: Entries that a task sums up before it passes them on.
FLUSH = 600_000
#: Bytes of a text in UTF-8 as they stand in a term, A-Z in lower case; all others part terms. Code points above 127 are letters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(LETTERS).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of texts (lang, body, sources: source and number of copies), summed up as far as FLUSH goes."""
    sums: dict[tuple[str, str], tuple[dict, dict]] = {}
    entries = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            values = [[lang] * len(n), [source] * len(n), pa.array(list(n), pa.binary()).cast(pa.string()), list(n.values()), list(docs.values())]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, SUMS, strict=True)], schema=SUMS)
        sums.clear()

    for batch in batches:
        bodies = batch.column("body").cast(pa.binary())
        for lang, body, sources in zip(batch.column("lang").to_pylist(), bodies, batch.column("sources").to_pylist(), strict=True):
            found = Counter(terms_of(body.as_py()))
            for copies in sources:
                n, docs = sums.setdefault((lang, copies["source"]), ({}, {}))
                before, times = len(n), copies["copies"]
                for term, count in found.items():
                    n[term] = n.get(term, 0) + count * times
                    docs[term] = docs.get(term, 0) + times
                entries += len(n) - before
            if entries > FLUSH:
                yield from flushed()
                entries = 0
    yield from flushed()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("copies"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = rows.groupBy("lang", "digest").agg(F.any_value("body").alias("body")).join(copies, ["lang", "digest"])
    counted = texts.select("lang", "body", "sources").mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)); the product may exceed a long."""
    return F.expr(f"1 + (cast({count} AS decimal(20, 0)) + 1) * {SCALE} div (total + v)")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, top: int = 200, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: each group against the other sources of its language (part pair), and the
    terms that it has more of than its language, up to rank ``top`` (part term)."""
    with Tables(docs.sparkSession) as tables:
        kept = term_counts(docs, text, lang, source).groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("found"))
        kept = tables.cut(kept.filter(F.col("in_docs") >= least).drop("in_docs"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_total"))
        rows = kept.select("lang", "term", "all_n", F.inline("found"))
        groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
        groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")))
        groups = tables.cut(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0"))))

        # what terms have: p in their group, q in their language
        known = rows.join(groups, ["lang", "source"]).withColumn("p", _p("n"))
        known = tables.cut(known.select("lang", "source", "term", "p", "p0", F.expr("lang_total AS total"), "v", "all_n").withColumn("q", _p("all_n")).drop("total", "v", "all_n"))
        terms = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))

        one, other = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        changes = [one.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"coalesce(v * {_f('p0', 'q0')}, 0)").alias("value"))]
        alike = known.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
        own = alike.join(other, "lang").filter("source <> item")
        changes.append(own.select("lang", "source", "item", F.expr(f"m * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value")))
        # the same the other way round: the terms of the item's group, against a term that the source lacks
        changes.append(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("value")))
        both = known.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("found")).filter(F.size("found") > 1)
        both = both.select("lang", "found", F.inline("found")).select("lang", "source", "p", "p0", F.explode("found").alias("o"))
        both = both.select("lang", "source", F.col("o.source").alias("item"), "p", "p0", F.col("o.p").alias("q"), F.col("o.p0").alias("q0")).filter("source <> item")
        value = f"{_f('p', 'q')} - {_f('p', 'q0')} - {_f('p0', 'q')} + {_f('p0', 'q0')}"
        changes.append(both.select("lang", "source", "item", F.expr(value).alias("value")))
        pairs = changes[0]
        for change in changes[1:]:
            pairs = pairs.unionByName(change)
        pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
        ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return tables.result(ranked.unionByName(pairs.withColumn("rank", F.row_number().over(order))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (lang_total + v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
