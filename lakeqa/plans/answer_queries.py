"""Queries of prompts, answers and request logs."""

from pyspark.sql import functions as F

from lakeqa.functions import text as t
from lakeqa.operators import answers as a
from lakeqa.operators import logs as g
from lakeqa.operators import retrieval as r
from lakeqa.operators.replay import answer_cache_replay
from lakeqa.plans.feeds import ANSWERS, LOGS, answers, chunks, golden, index, kept, logs, table
from lakeqa.plans.retrieval_queries import INDEX, bm25_sql

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def hits(spark, sf, k=3):
    c = chunks(spark, sf)
    top = kept(r.bm25_topk(golden(spark, sf), index(spark, sf), k)).join(c, "chunk_id")
    section = F.concat(F.lit("Item 7 | "), "ticker", F.lit(" | 31"))
    return top.select("query_id", "rank", "chunk_id", "ticker", "filing_date", section.alias("section"), "content", "score")


HITS = f"""{INDEX}, {bm25_sql("top", 3)}, hits AS (SELECT query_id, rank, chunk_id, ticker, filing_date, 'Item 7 ' || ticker AS section, content, score FROM top JOIN chunks USING (chunk_id))"""
SOURCES = HITS + """, sources AS (SELECT query_id, string_agg('[' || rank || '] ' || ticker || ' | ' || filing_date || ' | ' || section || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS sources FROM hits GROUP BY query_id)"""


@query("format_sources", f"WITH {SOURCES} SELECT * FROM sources")
def _(spark, sf):
    return a.format_sources(hits(spark, sf))


@query("build_prompt", f"WITH {SOURCES} SELECT query_id, 'Context:' || chr(10) || sources || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt FROM sources JOIN golden USING (query_id)")
def _(spark, sf):
    return a.build_prompt(golden(spark, sf), hits(spark, sf))


def attempts(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 3).alias("query_id"),
        (i % 3).cast("int").alias("attempt"),
        F.when(i % 7 == 0, F.lit("")).otherwise(F.col("event_type")).alias("content"),
        F.length("event_type").alias("reasoning_chars"),
        F.when(i % 5 == 0, "length").otherwise("stop").alias("finish_reason"),
        i.alias("prompt_tokens"),
        F.col("user_id").alias("completion_tokens"),
        F.when(i % 11 == 0, "broken").alias("error"),
        F.when(i % 4 != 0, (i % 100).cast("double") / 4).alias("cost"),
        F.when(i % 6 != 0, (i % 50).cast("double")).alias("balance"),
    )


@query(
    "fold_attempts",
    """WITH a AS (SELECT event_id // 3 AS query_id, event_id % 3 AS attempt, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS content, CASE WHEN event_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, event_id AS prompt_tokens,
  CASE WHEN event_id % 11 = 0 THEN 'broken' END AS error, CASE WHEN event_id % 4 <> 0 THEN (event_id % 100)::DOUBLE / 4 END AS cost, CASE WHEN event_id % 6 <> 0 THEN (event_id % 50)::DOUBLE END AS balance FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY attempt DESC) AS k FROM a),
s AS (SELECT query_id, sum(cost) AS cost, arg_max(balance, attempt) FILTER (balance IS NOT NULL) AS balance, count(*) AS attempts FROM a GROUP BY query_id)
SELECT query_id, content, finish_reason, prompt_tokens, s.cost, s.balance, attempts, coalesce(error, CASE WHEN finish_reason = 'length' THEN 'answer cut off' WHEN content = '' THEN 'empty answer' END) AS error FROM l JOIN s USING (query_id) WHERE k = 1""",
)
def _(spark, sf):
    return a.fold_attempts(attempts(spark, sf)).drop("reasoning_chars", "completion_tokens")


def cited(spark, sf):
    return golden(spark, sf).select("query_id", F.concat(F.lit("see [1] and [2, 9]["), (F.col("query_id") % 5).cast("string"), F.lit("]")).alias("answer"))


@query(
    "cite_sources",
    f"""WITH {HITS}, c AS (SELECT query_id, unnest(list_distinct([1, 2, 9, query_id % 5]))::INT AS number FROM golden) SELECT query_id, number, ticker, filing_date, section FROM c JOIN hits ON hits.query_id = c.query_id AND rank = number""".replace(
        "SELECT query_id, number, ticker, filing_date, section FROM c JOIN", "SELECT c.query_id, number, ticker, filing_date, section FROM c JOIN"
    ),
)
def _(spark, sf):
    return a.cite_sources(cited(spark, sf), hits(spark, sf)).drop("preview")


def verified(spark, sf):
    i = F.col("answer_id")
    base = answers(spark, sf).select(i.alias("query_id"), "answer", t.is_refusal(F.col("answer")).alias("refused"), F.size(t.citation_numbers(F.col("answer"))).alias("n_citations"), F.when(i % 3 != 0, 0.5).alias("cost"), (i % 90).alias("tokens"))
    verdicts = base.filter("query_id % 4 <> 0").select(
        "query_id", F.when(F.col("query_id") % 4 == 1, "UNSUPPORTED").when(F.col("query_id") % 4 == 2, "SUPPORTED").alias("verdict"), F.lit(0.25).alias("verify_cost"), F.lit(7).cast("long").alias("verify_tokens")
    )
    return base, verdicts


VERIFIED = rf"""{ANSWERS}, b AS (SELECT answer_id AS query_id, answer, starts_with(regexp_replace(lower(answer), '^[^a-z]+|[^a-z]+$', '', 'g'), '{t.REFUSAL_START}') AS refused,
  len(list_distinct(flatten(list_transform(regexp_extract_all(answer, '\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]', 1), lambda g: regexp_extract_all(g, '\d+'))))) AS n, CASE WHEN answer_id % 3 <> 0 THEN 0.5::DOUBLE END AS cost, answer_id % 90 AS tokens FROM answers),
s AS (SELECT *, query_id % 4 AS q, NOT refused AND n > 0 AS asked FROM b),
v AS (SELECT *, CASE WHEN NOT asked THEN 'skipped' WHEN q = 1 THEN 'failed' WHEN q = 2 THEN 'passed' ELSE 'inconclusive' END AS verification FROM s)"""


@query(
    "apply_verification",
    f"""WITH {VERIFIED} SELECT query_id, CASE WHEN verification = 'failed' THEN '{t.REFUSAL}' ELSE answer END AS answer, CASE WHEN verification = 'failed' THEN answer END AS rejected_answer, refused OR verification = 'failed' AS refused,
  CASE WHEN verification = 'failed' THEN 0 ELSE n END::INT AS n_citations, verification, CASE WHEN asked AND q <> 0 THEN coalesce(cost, 0) + 0.25::DOUBLE ELSE cost END AS cost, CASE WHEN asked AND q <> 0 THEN tokens + 7 ELSE tokens END AS tokens FROM v""",
)
def _(spark, sf):
    return a.apply_verification(*verified(spark, sf))


@query("empty_context_answer", f"WITH {INDEX}, {bm25_sql('top', 1)} SELECT query_id, '{t.REFUSAL}' AS answer, 'no_context' AS finish_reason, 0.0::DOUBLE AS cost, true AS refused FROM golden WHERE query_id NOT IN (SELECT query_id FROM top WHERE chunk_id % 3 = 0)")
def _(spark, sf):
    return a.empty_context_answer(golden(spark, sf), hits(spark, sf, 1).filter("chunk_id % 3 = 0"))


def judged(spark, sf):
    i = F.col("answer_id")
    kind = F.when(i % 3 == 0, "answerable").when(i % 3 == 1, "faithfulness").otherwise("not_found")
    rows = answers(spark, sf).select(
        i.alias("query_id"),
        "question",
        kind.alias("type"),
        F.when(i % 2 == 0, F.array(F.lit("1,234.5"), F.lit("the"))).alias("any"),
        F.when(i % 5 == 1, F.array(F.lit("of"), F.lit("2024"))).alias("all"),
        "answer",
        t.is_refusal(F.col("answer")).alias("refused"),
        F.size(t.citation_numbers(F.col("answer"))).alias("n_citations"),
        F.when(i % 13 == 0, "boom").alias("error"),
        F.when(i % 4 == 0, "failed").when(i % 4 == 1, "passed").alias("verification"),
        F.when(i % 6 == 0, "length").otherwise("stop").alias("finish_reason"),
        ((i % 8).cast("double") / 8).alias("cost"),
    )
    return a.answer_passes(rows)


JUDGED = rf"""{ANSWERS}, b AS (SELECT answer_id AS query_id, question, answer_id AS i, answer, replace(replace(lower(answer), '’', ''''), '‘', '''') AS x, CASE answer_id % 3 WHEN 0 THEN 'answerable' WHEN 1 THEN 'faithfulness' ELSE 'not_found' END AS type,
  starts_with(regexp_replace(lower(answer), '^[^a-z]+|[^a-z]+$', '', 'g'), '{t.REFUSAL_START}') AS refused, len(regexp_extract_all(answer, '\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]')) AS n FROM answers),
c AS (SELECT *, i % 2 <> 0 OR contains(x, '1,234.5') OR contains(x, 'the') AS any_ok, i % 2 = 0 AND (contains(x, '1,234.5') OR contains(x, 'the')) AS any_has, i % 5 <> 1 OR (contains(x, 'of') AND contains(x, '2024')) AS all_ok FROM b),
judged AS (SELECT query_id, question, i, answer, type, refused, CASE WHEN i % 13 = 0 THEN 'error: boom' WHEN type = 'not_found' THEN CASE WHEN refused THEN '' ELSE 'no refusal' END WHEN type = 'faithfulness' THEN CASE WHEN refused OR any_has THEN '' ELSE 'wrong figure' END
  WHEN refused THEN 'refused' WHEN n = 0 THEN 'no citations' WHEN NOT any_ok THEN 'none of the terms' WHEN NOT all_ok THEN 'not all of the terms' ELSE '' END AS reason FROM c)"""


@query("answer_passes", f"WITH {JUDGED} SELECT query_id, type, reason = '' AS ok, reason FROM judged")
def _(spark, sf):
    return judged(spark, sf).select("query_id", "type", "ok", "reason")


@query(
    "answer_suite_summary",
    f"""WITH {JUDGED} SELECT type, count(*) FILTER (reason = '') AS passed, count(*) AS total, count(*) FILTER (i % 6 <> 0) AS stopped, count(*) FILTER (i % 4 = 1) AS verified_passed, count(*) FILTER (i % 4 = 0) AS verified_failed,
  0::BIGINT AS verified_skipped, 0::BIGINT AS verified_inconclusive, round(sum((i % 8)::DOUBLE / 8), 6) AS cost FROM judged GROUP BY type""",
)
def _(spark, sf):
    return a.answer_suite_summary(judged(spark, sf))


@query("run_consistency", f"WITH {JUDGED} SELECT question, count(*) AS runs, count(*) FILTER (refused) AS refusals, count(DISTINCT answer) AS answers, round(avg((reason = '')::INT), 6) AS pass_share FROM judged GROUP BY ALL")
def _(spark, sf):
    return a.run_consistency(judged(spark, sf))


@query("answer_batch")
def _(spark, sf):
    q = golden(spark, sf)
    h = hits(spark, sf).filter("query_id % 9 <> 4")
    text = F.concat("snippet", F.when(F.col("query_id") % 3 == 0, F.lit(" 12.5% [1][2]")).when(F.col("query_id") % 3 == 1, F.lit(" [3]")).otherwise(F.lit("")))
    body = F.struct(F.array(F.struct(F.struct(text.alias("content"), F.lit("x").alias("reasoning_content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens")).alias("usage"), F.lit(0.02).alias("cost_bdt"))
    completions = q.select("query_id", F.lit(0).alias("attempt"), F.to_json(body).alias("raw"))
    verdicts = q.select("query_id", F.when(F.col("query_id") % 2 == 0, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"), F.lit(0.01).alias("verify_cost"), F.lit(3).cast("long").alias("verify_tokens"))
    return a.answer_batch(q, h, completions, verdicts)


@query(
    "build_query_log",
    f"""WITH {HITS}, c AS (SELECT query_id, list({{'chunk_id': chunk_id, 'ticker': ticker, 'filing_date': filing_date, 'score': score}} ORDER BY rank) AS chunks FROM hits WHERE query_id % 4 <> 1 GROUP BY query_id)
SELECT query_id AS request_id, left(question, 2000) AS question, left(CASE WHEN query_id % 7 = 0 THEN 'request failed' WHEN query_id % 5 = 0 THEN repeat('no ', 200) END, 500) AS error, nullif(CASE WHEN query_id % 5 <> 0 THEN snippet ELSE '' END, '') AS answer, chunks
FROM golden LEFT JOIN c USING (query_id)""",
)
def _(spark, sf):
    q = golden(spark, sf)
    i = F.col("query_id")
    requests = q.select(i.alias("request_id"), "question", F.when(i % 7 == 0, "request failed").alias("error"))
    result = q.select(i.alias("request_id"), F.when(i % 5 != 0, F.col("snippet")).otherwise("").alias("answer"), F.when(i % 5 == 0, F.repeat(F.lit("no "), 200)).alias("error"))
    return g.build_query_log(requests, hits(spark, sf).filter("query_id % 4 <> 1").withColumnRenamed("query_id", "request_id"), result)


@query(
    "status_code",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN 503 WHEN event_id % 4 = 0 OR event_type = 'signup' THEN 502 ELSE 200 END AS status_code FROM events",
)
def _(spark, sf):
    i = F.col("event_id")
    stage = F.when(F.col("event_type") == "error", "retrieval").when(F.col("event_type") == "signup", "crash").otherwise("done")
    error = F.when(i % 8 == 0, "HTTP 402 payment").when(i % 4 == 0, "timeout")
    return table(spark, sf, "events").select("event_id", g.status_code(stage, error).alias("status_code"))


@query(
    "cacheable",
    "SELECT event_id, event_id % 5 <> 0 AND event_type <> 'error' AND event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 7 <> 2 AS cacheable FROM events",
)
def _(spark, sf):
    i = F.col("event_id")
    fit = g.cacheable(F.when(i % 5 == 0, "boom").when(i % 2 == 0, ""), F.when(F.col("event_type") != "error", F.when(i % 3 == 0, "length").otherwise("stop")), F.when(i % 4 != 0, "x"), F.when(i % 7 == 2, "inconclusive").when(i % 7 == 3, "passed"))
    return table(spark, sf, "events").select("event_id", fit.alias("cacheable"))


@query(
    "request_stats",
    f"""WITH {LOGS} SELECT count(*) AS requests, count(*) FILTER (status_code = 200) AS ok, count(*) FILTER (status_code >= 500) AS failed, count(*) FILTER (refused) AS refused, round(avg(total_ms), 0) AS avg_total_ms, round(avg(retrieval_ms), 0) AS avg_retrieval_ms,
  round(quantile_cont(total_ms, 0.5), 0) AS p50_total_ms, round(quantile_cont(total_ms, 0.95), 0) AS p95_total_ms, round(coalesce(sum(cost), 0), 4) AS cost, round(coalesce(sum(cost), 0) / count(*), 4) AS cost_per_request FROM logs""",
)
def _(spark, sf):
    return g.request_stats(logs(spark, sf))


@query("recent_errors", f"WITH {LOGS} SELECT id, status_code, left(error, 200) AS error FROM logs WHERE error IS NOT NULL ORDER BY id DESC LIMIT 5")
def _(spark, sf):
    return g.recent_errors(logs(spark, sf))


@query("daily_cap", f"WITH {LOGS} SELECT id, ip, created_at FROM (SELECT *, row_number() OVER (PARTITION BY created_at::DATE ORDER BY created_at, id) AS k FROM logs) WHERE k <= 200")
def _(spark, sf):
    return g.daily_cap(logs(spark, sf)).select("id", "ip", "created_at")


RATE = f"""WITH RECURSIVE {LOGS}, o AS (SELECT id, ip, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY ip ORDER BY created_at, id) AS k FROM logs),
r AS (SELECT id, ip, k, true AS allowed, [us] AS slots FROM o WHERE k = 1 UNION ALL
  SELECT o.id, o.ip, o.k, len(list_filter(slots, lambda s: us - s <= 43200000000)) < 2, CASE WHEN len(list_filter(slots, lambda s: us - s <= 43200000000)) < 2 THEN list_append(list_filter(slots, lambda s: us - s <= 43200000000), us) ELSE list_filter(slots, lambda s: us - s <= 43200000000) END
  FROM r JOIN o ON o.ip = r.ip AND o.k = r.k + 1)"""


@query("rate_limit", f"{RATE} SELECT id, ip, allowed FROM r")
def _(spark, sf):
    return g.rate_limit(logs(spark, sf), 2, 43_200.0).select("id", "ip", "allowed")


@query(
    "admission",
    f"""{RATE}, d AS (SELECT r.id, r.ip, allowed, created_at, row_number() OVER (PARTITION BY allowed, created_at::DATE ORDER BY created_at, r.id) AS k FROM r JOIN logs USING (id))
SELECT id, ip, CASE WHEN NOT allowed THEN 'rate_limited' WHEN k <= 100 THEN 'admitted' ELSE 'capped' END AS status FROM d""",
)
def _(spark, sf):
    return g.admit(logs(spark, sf), 2, 43_200.0, 100).select("id", "ip", "status")


def cached(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("cache_key"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 != 0).alias("cacheable"), (F.col("event_id") % 5 == 0).alias("refused"), (F.col("event_id") % 8).cast("double").alias("cost")
    )


@query(
    "answer_cache_replay",
    """WITH RECURSIVE o AS (SELECT event_id AS id, user_id || '/' || event_type AS key, epoch_us(ts) AS us, event_id % 3 <> 0 AS fit, CASE WHEN event_id % 5 = 0 THEN 3600000000 ELSE 86400000000 END AS ttl, (event_id % 8)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT id, key, k, 'miss' AS outcome, cost, CASE WHEN fit THEN us + ttl END AS expires FROM o WHERE k = 1 UNION ALL
  SELECT o.id, o.key, o.k, CASE WHEN expires >= us THEN 'hit' WHEN expires IS NULL THEN 'miss' ELSE 'expired' END, CASE WHEN expires >= us THEN 0 ELSE o.cost END, CASE WHEN expires >= us THEN expires WHEN fit THEN us + ttl END FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1)
SELECT id, key AS cache_key, outcome, cost FROM r""",
)
def _(spark, sf):
    return answer_cache_replay(cached(spark, sf))


@query("daily_request_counts", f"WITH {LOGS} SELECT created_at::DATE AS day, count(*) AS requests, count(*) >= 330 AS capped FROM logs GROUP BY ALL")
def _(spark, sf):
    return g.daily_request_counts(logs(spark, sf), 330)


@query(
    "windowed_stats",
    f"""WITH {LOGS} SELECT date_trunc('hour', created_at) AS start, count(*) AS requests, count(*) FILTER (status_code = 200) AS ok, count(*) FILTER (status_code >= 500) AS failed, count(*) FILTER (refused) AS refused, round(coalesce(sum(cost), 0), 4) AS cost, round(avg(total_ms), 4) AS avg_total_ms FROM logs GROUP BY ALL""",
)
def _(spark, sf):
    return g.windowed_stats(logs(spark, sf))
