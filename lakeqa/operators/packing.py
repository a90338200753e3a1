"""Packing of hits into a character budget, and the comparison of packed with unpacked retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeqa.functions.text import tokenize
from lakeqa.operators.retrieval import first_hit_rank, retrieval_metrics
from lakeqa.operators.substrings import substring_join

OVERLAP, DUPLICATE, SEPARATOR = 150, 0.80, "\n\n"


def merge_runs(hits: DataFrame) -> DataFrame:
    """Blocks of consecutive chunks: query_id, filing_id, block, chunk_ids, header, text, filing_date, best.

    hits: query_id, rank, chunk_id, filing_id, position, header, text, filing_date. A chunk that begins with the end of
    the one before is joined without the overlap, else on a new line. best is the block's best rank.
    """
    rows = hits.withColumn("filing_id", F.coalesce("filing_id", "chunk_id"))
    order = Window.partitionBy("query_id", "filing_id").orderBy("position", "rank")
    opens = F.coalesce(F.col("position") != F.lag("position").over(order) + 1, F.lit(True))
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(order))
    part = F.struct("position", "rank", "chunk_id", "header", "text", "filing_date")
    rows = rows.groupBy("query_id", "filing_id", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("rank").alias("best"))

    def add(text: Column, nxt: Column) -> Column:
        overlaps = F.right(text, F.lit(OVERLAP)) == F.left(nxt, F.lit(OVERLAP))
        return F.when(overlaps, F.concat(text, F.substr(nxt, F.lit(OVERLAP + 1)))).otherwise(F.concat(text, F.lit("\n"), nxt))

    rest = F.slice("parts", 2, F.greatest(F.lit(1), F.size("parts")))
    text = F.aggregate(rest, F.get("parts", F.lit(0))["text"], lambda acc, p: add(acc, p["text"]))
    first = F.get("parts", F.lit(0))
    return rows.select("query_id", "filing_id", "block", F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), first["header"].alias("header"), text.alias("text"), first["filing_date"].alias("filing_date"), "best")


def _render(header: Column, text: Column) -> Column:
    return F.when(header == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def near_duplicate(new: Column, kept: Column) -> Column:
    """Whether a set of tokens is mostly in another; an empty one never is."""
    return (F.size(new) > 0) & (F.size(F.array_intersect(new, kept)) / F.greatest(F.lit(1), F.size(new)) >= DUPLICATE)


def duplicate_pairs(hits: DataFrame) -> DataFrame:
    """query_id, number, other, duplicate: each merged block of a query, by rank from 1, against each block before it.

    A query has a handful of blocks; they are compared inside its row, so that hits are computed once.
    """
    b = merge_runs(hits).select("query_id", F.struct("best", "chunk_ids", F.array_distinct(tokenize(F.col("text"))).alias("tokens")).alias("b"))
    rows = b.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    rows = rows.select("query_id", "blocks", F.posexplode("blocks").alias("i", "b"))
    rows = rows.select("query_id", "i", "b", F.posexplode(F.slice("blocks", F.lit(1), F.col("i"))).alias("j", "kept"))
    return rows.select("query_id", (F.col("i") + 1).alias("number"), (F.col("j") + 1).alias("other"), near_duplicate(F.col("b.tokens"), F.col("kept.tokens")).alias("duplicate"))


def pack(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, context, blocks (number, chunk_ids, text, filing_date, truncated): merged, without near-duplicates, within the budget.

    A query has a handful of blocks; both folds run inside its row.
    """
    blocks = merge_runs(hits).select(
        "query_id",
        F.struct("best", "chunk_ids", F.coalesce("header", F.lit("")).alias("header"), "text", F.coalesce(F.col("filing_date").cast("string"), F.lit("")).alias("filing_date"), F.array_distinct(tokenize(F.col("text"))).alias("tokens")).alias("b"),
    )
    rows = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    none = F.slice("blocks", 1, 0)
    unique = F.aggregate("blocks", none, lambda kept, b: F.when(F.exists(kept, lambda k: near_duplicate(b["tokens"], k["tokens"])), kept).otherwise(F.array_append(kept, b)))
    rows = rows.withColumn("blocks", unique)
    head = F.get("blocks", F.lit(0))
    room = F.lit(budget) - F.length(_render(head["header"], F.lit("")))
    too_long = F.length(_render(head["header"], head["text"])) > budget
    cut_text = F.when(too_long, F.left(head["text"], F.greatest(room, F.lit(0)))).otherwise(head["text"])
    start = F.struct(F.array(F.struct(head["chunk_ids"].alias("chunk_ids"), _render(head["header"], cut_text).alias("text"), head["filing_date"].alias("filing_date"), too_long.alias("truncated"))).alias("out"), F.length(_render(head["header"], cut_text)).alias("used"), F.lit(False).alias("full"))

    def take(acc: Column, b: Column) -> Column:
        text = _render(b["header"], b["text"])
        fits = ~acc["full"] & (acc["used"] + F.length(text) + len(SEPARATOR) <= budget)
        more = F.array_append(acc["out"], F.struct(b["chunk_ids"].alias("chunk_ids"), text.alias("text"), b["filing_date"].alias("filing_date"), F.lit(False).alias("truncated")))
        return F.struct(F.when(fits, more).otherwise(acc["out"]).alias("out"), F.when(fits, acc["used"] + F.length(text) + len(SEPARATOR)).otherwise(acc["used"]).alias("used"), ~fits.alias("full"))

    packed = F.aggregate(F.slice("blocks", 2, F.size("blocks")), start, take)
    rows = rows.select("query_id", packed["out"].alias("out"))
    numbered = F.transform("out", lambda b, i: F.struct((i + 1).alias("number"), b["chunk_ids"].alias("chunk_ids"), b["text"].alias("text"), b["filing_date"].alias("filing_date"), b["truncated"].alias("truncated")))
    return rows.select("query_id", F.array_join(F.transform("out", lambda b: b["text"]), SEPARATOR).alias("context"), numbered.alias("blocks"))


def take_within_budget(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """Whole chunks by rank while they fit, separators counted; the first always. hits: query_id, rank, text."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.length("text") + F.when(F.col("rank") == 1, 0).otherwise(len(SEPARATOR))
    return hits.withColumn("used", F.sum(cost).over(order)).filter((F.col("rank") == 1) | (F.col("used") <= budget))


def block_ranks(packed: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, type, rank of the first block that holds a snippet (of the entry's filing date, if it has one)."""
    blocks = packed.select("query_id", F.explode("blocks").alias("b")).select("query_id", "b.number", "b.text", F.col("b.filing_date").alias("filed"))
    rows = blocks.join(golden, "query_id")
    hit = F.exists("snippets", lambda s: F.contains(F.col("text"), s)) & (F.col("filing_date").isNull() | (F.col("filing_date").cast("string") == F.col("filed")))
    return golden.select("query_id", "type").join(rows.filter(hit).groupBy("query_id").agg(F.min("number").alias("rank")), "query_id", "left")


def snippet_match(golden: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """query_id, snippet, chunk_id, filing_date: chunks that hold a snippet, in the entry's ticker and filing date (null: any).

    golden: query_id, ticker, filing_date, snippets. Chunks are found by q-grams of the snippets, whatever their number;
    index: a stored ``gram_index`` of the chunks with scope ticker and filing_date.
    """
    asked = golden.select("query_id", F.col("ticker").alias("of"), F.col("filing_date").alias("only"), F.explode("snippets").alias("needle"))
    fits = (F.col("of").isNull() | (F.col("of") == F.col("ticker"))) & (F.col("only").isNull() | (F.col("only") == F.col("filing_date")))
    rows = substring_join(asked, chunks, scope=("ticker", "filing_date"), condition=fits, index=index)
    return rows.select("query_id", F.col("needle").alias("snippet"), "chunk_id", "filing_date")


def snippet_audit(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, matches, found, dates, status: OK if every snippet occurs, else BROKEN; SKIP for not_found entries."""
    counts = snippet_match(golden, chunks).groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("snippet").alias("found"), F.array_sort(F.collect_set("filing_date")).alias("dates"))
    rows = golden.select("query_id", "type", F.size(F.array_distinct("snippets")).alias("n")).join(counts, "query_id", "left")
    status = F.when(F.col("type") == "not_found", "SKIP").when((F.col("n") > 0) & (F.coalesce("found", F.lit(0)) == F.col("n")), "OK").otherwise("BROKEN")
    return rows.select("query_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("dates", F.array().cast("array<date>")).alias("dates"), status.alias("status"))


def audit_counts(audit: DataFrame) -> DataFrame:
    """One row: entries, ok, broken, skipped of a snippet audit."""
    return audit.agg(F.count(F.lit(1)).alias("entries"), *(F.count_if(F.col("status") == status).alias(name) for status, name in (("OK", "ok"), ("BROKEN", "broken"), ("SKIP", "skipped"))))


def packed_vs_control(golden: DataFrame, hits: DataFrame, budget: int = 6000, base: DataFrame | None = None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The systems BASE (if given, other hits), PROD (hits as they are), CONTROL (whole chunks within the budget) and PACKED
    (packed within the budget): metrics with a row for each, and ranks (system, query_id, type, rank)."""
    chunks = hits.select("chunk_id", F.col("text").alias("content"), "filing_date").dropDuplicates(["chunk_id"])
    ranked = {"PROD": hits, "CONTROL": take_within_budget(hits, budget)} | ({} if base is None else {"BASE": base})
    ranks = block_ranks(pack(hits, budget), golden).withColumn("system", F.lit("PACKED"))
    for system, rows in ranked.items():
        ranks = ranks.unionByName(first_hit_rank(rows, golden, chunks, k).withColumn("system", F.lit(system)))
    return retrieval_metrics(ranks, "system").drop("missed"), ranks


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """query_id, base_rank, other_rank, delta, in_both: two runs by query; queries of one run only stay, marked."""
    a = base.select("query_id", F.col("rank").alias("base_rank"), F.lit(True).alias("in_base"))
    b = other.select("query_id", F.col("rank").alias("other_rank"), F.lit(True).alias("in_other"))
    rows = a.join(b, "query_id", "full")
    return rows.select("query_id", "base_rank", "other_rank", (F.col("other_rank") - F.col("base_rank")).alias("delta"), (F.col("in_base").isNotNull() & F.col("in_other").isNotNull()).alias("in_both"))


def control_summary(kept: DataFrame) -> DataFrame:
    """One row: queries, mean kept chunks and mean characters of an unpacked control (query_id, used)."""
    each = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("chars"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("n"), 6).alias("mean_chunks"), F.round(F.avg("chars"), 6).alias("mean_chars"))


def _named(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.select(*(F.col(c).alias(f"{name}_{c}") for c in ("hit_at_1", "hit_at_5", "mrr")))


def run_verdict(base: DataFrame, prod: DataFrame, packed: DataFrame) -> DataFrame:
    """scorer_ok, verdict of one-row metrics: KEEP if the scorer reproduces the base and packing does not lose, else DROP or INVALID."""
    row = _named(base, "base").crossJoin(_named(prod, "prod")).crossJoin(_named(packed, "packed"))  # one row each
    same = (F.abs(F.col("base_hit_at_1") - F.col("prod_hit_at_1")) < 1e-6) & (F.abs(F.col("base_hit_at_5") - F.col("prod_hit_at_5")) < 1e-6) & (F.abs(F.col("base_mrr") - F.col("prod_mrr")) < 0.0005)
    keep = (F.col("packed_hit_at_5") >= F.col("prod_hit_at_5")) & (F.col("packed_mrr") >= F.col("prod_mrr"))
    return row.select(same.alias("scorer_ok"), F.when(~same, "INVALID").when(keep, "KEEP").otherwise("DROP").alias("verdict"))


def control_verdict(base: DataFrame, prod: DataFrame, control: DataFrame, packed: DataFrame) -> DataFrame:
    """scorer_ok, verdict: PACKING ADDS VALUE, NO DIFFERENCE, UNCLEAR or INVALID."""
    row = _named(base, "base").crossJoin(_named(prod, "prod")).crossJoin(_named(control, "control")).crossJoin(_named(packed, "packed"))  # one row each
    same = (F.abs(F.col("base_hit_at_5") - F.col("prod_hit_at_5")) < 1e-6) & (F.abs(F.col("base_mrr") - F.col("prod_mrr")) < 0.0005)
    gap, mrr = F.col("packed_hit_at_5") - F.col("control_hit_at_5"), F.col("packed_mrr") - F.col("control_mrr")
    verdict = F.when(~same, "INVALID").when((gap > 0) & (mrr > 0), "PACKING ADDS VALUE").when((gap == 0) & (F.abs(mrr) < 0.005), "NO DIFFERENCE").otherwise("UNCLEAR")
    return row.select(same.alias("scorer_ok"), verdict.alias("verdict"))
