"""Prompts out, completions in: from hits and model output to final answers, and how answers are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeqa.functions.text import REFUSAL, build_preview, citation_numbers, clean_section_label, is_refusal, normalize_answer, parse_completion


def format_sources(hits: DataFrame) -> DataFrame:
    """query_id, sources: ``[n] ticker | date | section`` and the content of each hit, by rank. A query has few hits."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), text("ticker"), F.lit(" | "), text("filing_date"), F.lit(" | "), clean_section_label(F.col("section"), True), F.lit("\n"), text("content"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return rows.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("sources"))


def build_prompt(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, prompt for the queries that have hits."""
    rows = queries.select("query_id", "question").join(format_sources(hits), "query_id")
    return rows.select("query_id", F.concat(F.lit("Context:\n"), "sources", F.lit("\n\nQuestion: "), "question", F.lit("\n\nAnswer:")).alias("prompt"))


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """One row for each query: the last attempt, with costs added up over all and the last balance that is known.

    attempts: query_id, attempt, and the fields of ``parse_completion``. An answer that is still empty or cut is an error.
    """
    last = F.max_by(F.struct("content", "reasoning_chars", "finish_reason", "prompt_tokens", "completion_tokens", "error"), "attempt").alias("last")
    rows = attempts.groupBy("query_id").agg(
        last, F.sum("cost").alias("cost"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("attempt"))).alias("balance"), F.count(F.lit(1)).alias("attempts")
    )
    rows = rows.select("query_id", "last.*", "cost", "balance", "attempts")
    unfit = F.when(F.col("finish_reason") == "length", "answer cut off").when(F.trim("content") == "", "empty answer")
    return rows.withColumn("error", F.coalesce("error", unfit))


def cite_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, number, ticker, filing_date, section, preview: the hits that an answer cites; numbers without a hit are dropped."""
    cited = answers.select("query_id", "answer", F.explode(citation_numbers(F.col("answer"))).alias("number"))
    rows = cited.join(hits.withColumnRenamed("rank", "number"), ["query_id", "number"])
    return rows.select("query_id", "number", "ticker", "filing_date", clean_section_label(F.col("section"), True).alias("section"), build_preview(F.col("answer"), F.coalesce("content", F.lit(""))).alias("preview"))


def apply_verification(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answers after the verifier: a failed answer is replaced by the refusal and kept as rejected_answer.

    answers: query_id, answer, refused, n_citations, cost, tokens. verdicts: query_id, verdict, verify_cost, verify_tokens.
    """
    rows = answers.join(verdicts, "query_id", "left")
    asked = ~F.col("refused") & (F.col("n_citations") > 0)
    state = F.when(~asked, "skipped").when(F.col("verdict") == "UNSUPPORTED", "failed").when(F.col("verdict") == "SUPPORTED", "passed").otherwise("inconclusive")
    rows = rows.withColumn("verification", state)
    failed = F.col("verification") == "failed"
    add = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return rows.select(
        "query_id",
        F.when(failed, REFUSAL).otherwise(F.col("answer")).alias("answer"),
        F.when(failed, F.col("answer")).alias("rejected_answer"),
        (F.col("refused") | failed).alias("refused"),
        F.when(failed, 0).otherwise(F.col("n_citations")).alias("n_citations"),
        "verification",
        F.when(asked, add("cost", "verify_cost")).otherwise(F.col("cost")).alias("cost"),
        F.when(asked, add("tokens", "verify_tokens")).otherwise(F.col("tokens")).alias("tokens"),
    )


def empty_context_answer(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, answer, finish_reason, cost, refused for the queries without hits."""
    rows = queries.select("query_id").join(hits.select("query_id"), "query_id", "left_anti")
    return rows.select("query_id", F.lit(REFUSAL).alias("answer"), F.lit("no_context").alias("finish_reason"), F.lit(0.0).alias("cost"), F.lit(True).alias("refused"))


def answer_passes(results: DataFrame) -> DataFrame:
    """results with ok and reason. results: type, any, all (null: no condition), answer, refused, n_citations, error."""
    text = F.translate(F.lower(F.coalesce("answer", F.lit(""))), "’‘", "''")
    has = lambda names: F.exists(names, lambda n: F.contains(F.col("_text"), n))
    rows = results.withColumn("_text", text)
    any_ok = F.col("any").isNull() | has("any")
    all_ok = F.col("all").isNull() | F.forall("all", lambda n: F.contains(F.col("_text"), n))
    refused = F.coalesce("refused", F.lit(False))
    reason = (
        F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("error: "), "error"))
        .when(F.col("type") == "not_found", F.when(refused, "").otherwise("no refusal"))
        .when(F.col("type") == "faithfulness", F.when(refused | F.coalesce(has("any"), F.lit(False)), "").otherwise("wrong figure"))
        .when(refused, "refused")
        .when(F.coalesce("n_citations", F.lit(0)) == 0, "no citations")
        .when(~any_ok, "none of the terms")
        .when(~all_ok, "not all of the terms")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason") == "").drop("_text")


def answer_suite_summary(results: DataFrame) -> DataFrame:
    """type, passed, total, stopped, passed / failed / skipped / inconclusive verifications and cost of each test type."""
    count = lambda v: F.count_if(F.coalesce(F.col("verification") == v, F.lit(False))).alias(f"verified_{v}")
    return results.groupBy("type").agg(
        F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("finish_reason") == "stop", F.lit(False))).alias("stopped"), *map(count, ("passed", "failed", "skipped", "inconclusive")), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost")
    )


def run_consistency(results: DataFrame) -> DataFrame:
    """question, runs, refusals, distinct answers and share of passes over several runs."""
    return results.groupBy("question").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("refused").alias("refusals"), F.count_distinct("answer").alias("answers"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("pass_share")
    )


def answer_batch(queries: DataFrame, hits: DataFrame, completions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final rows for a batch of queries from the model's raw output (query_id, attempt, raw) and the verifier's verdicts.

    query_id, answer, rejected_answer, refused, citations, verification, finish_reason, cost, tokens, error.
    """
    parsed = completions.select("query_id", "attempt", parse_completion(F.col("raw")).alias("c")).select("query_id", "attempt", "c.*")
    folded = fold_attempts(parsed)
    text = folded.select("*", normalize_answer(F.col("content")).alias("answer")).withColumn("refused", is_refusal(F.col("answer")))
    cites = cite_sources(text.filter("error IS NULL AND NOT refused"), hits)
    cites = cites.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "ticker", "filing_date", "section", "preview"))).alias("citations"))
    rows = text.join(cites, "query_id", "left").withColumn("n_citations", F.coalesce(F.size("citations"), F.lit(0)))
    rows = rows.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    checked = apply_verification(rows.select("query_id", "answer", "refused", "n_citations", "cost", "tokens"), verdicts)
    answered = checked.join(rows.select("query_id", "citations", "finish_reason", "error"), "query_id").select(
        "query_id", "answer", "rejected_answer", "refused", F.when(F.col("n_citations") > 0, F.col("citations")).alias("citations"), "verification", "finish_reason", "cost", "tokens", "error"
    )
    empty = empty_context_answer(queries, hits)
    return answered.join(empty.select("query_id"), "query_id", "left_anti").unionByName(empty, allowMissingColumns=True)
