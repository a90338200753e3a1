"""Queries of retrieval and its evaluation. The second ranked list is BM25 without length normalisation.

Each query writes the BM25 index of its chunks once and reads it from there; lists that are used twice are written too.
"""

from pyspark.sql import functions as F

from lakeqa.operators import retrieval as r
from lakeqa.operators.corpus import embed
from lakeqa.operators.routing import cell_dictionary, cells_of
from lakeqa.plans.feeds import CHUNKS, GOLDEN, chunks, golden, index, kept, table, tokens_sql

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


INDEX = f"""{CHUNKS}, {GOLDEN},
tok AS (SELECT chunk_id, {tokens_sql("content")} AS tokens FROM chunks),
post AS (SELECT chunk_id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, tokens, unnest(tokens) AS term FROM tok) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql("question")}) AS term FROM golden) GROUP BY ALL)"""


def bm25_sql(name: str, k: int, b: float = 0.75) -> str:
    return f"""{name}_s AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM post JOIN asked USING (term) JOIN idf USING (term), size GROUP BY ALL),
{name}_a AS (SELECT g.query_id, c.chunk_id, coalesce(score, 0) AS score FROM golden g CROSS JOIN chunks c LEFT JOIN {name}_s USING (query_id, chunk_id)),
{name} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {name}_a) WHERE rank <= {k})"""


@query("bm25_stats", f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    return r.bm25_stats(index(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {INDEX}, {bm25_sql('l', 10)} SELECT * FROM l")
def _(spark, sf):
    return r.bm25_topk(golden(spark, sf), index(spark, sf), 10)


@query(
    "bm25_topk_scoped",
    f"WITH {INDEX}, {bm25_sql('l', 10)} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM l_a WHERE chunk_id % 100 = query_id % 100) WHERE rank <= 10",
)
def _(spark, sf):
    q, c = golden(spark, sf), chunks(spark, sf)
    scope = q.select("query_id", F.pmod("query_id", F.lit(100)).alias("m")).join(c.select("chunk_id", F.pmod("chunk_id", F.lit(100)).alias("m")), "m").drop("m")
    return r.bm25_topk(q, index(spark, sf), 10, scope=scope)


@query(
    "bm25_topk_cells",
    f"""WITH {INDEX}, {bm25_sql('l', 10)} SELECT query_id, chunk_id, score, rank FROM (SELECT l_a.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM l_a JOIN chunks USING (chunk_id)
WHERE (query_id % 4 = 3 OR ticker = 'SRC' || (query_id % 21)) AND (query_id % 3 <> 0 OR filing_date IN (DATE '2024-01-01', DATE '2025-01-01'))) WHERE rank <= 10""",
)
def _(spark, sf):
    i, q = F.col("query_id"), golden(spark, sf)
    ticker = F.when(i % 4 != 3, F.concat(F.lit("SRC"), (i % 21).cast("string")))
    dates = F.when(i % 3 == 0, F.array(F.lit("2024-01-01").cast("date"), F.lit("2025-01-01").cast("date")))
    cells = cells_of(q.select("query_id", ticker.alias("ticker"), dates.alias("dates")), cell_dictionary(chunks(spark, sf)))
    return r.bm25_topk(q, index(spark, sf), 10, cells=cells)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("scope"))


DENSE = """SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance
    FROM embeddings q JOIN embeddings e ON {on} WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


@query("dense_topk", DENSE.format(on="true"))
def _(spark, sf):
    v = vectors(spark, sf)
    return r.dense_topk(v.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), v, 10)


@query("dense_topk_scoped", DENSE.format(on="q.label = e.label"))
def _(spark, sf):
    v = vectors(spark, sf)
    return r.dense_topk(v.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), v, 10, scope=True)


@query("dense_topk_cells", DENSE.format(on="e.label IN (q.label, (q.label + 3) % 10) OR q.vec_id % 3 = 0"))
def _(spark, sf):
    v = vectors(spark, sf)
    wanted = F.when(F.col("chunk_id") % 3 != 0, F.array("scope", (F.col("scope") + 3) % 10))
    return r.dense_topk(v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", wanted.alias("scope")), v, 10, scope=True)


def lists(spark, sf, k=50):
    q, i = golden(spark, sf), index(spark, sf)
    return q, chunks(spark, sf), [kept(r.bm25_topk(q, i, k)), kept(r.bm25_topk(q, i, k, b=0.0))]


LISTS = f"""WITH {INDEX}, {bm25_sql("l0", 50)}, {bm25_sql("l1", 50, 0.0)},
pair AS (SELECT query_id, chunk_id, rank, 0 AS list FROM l0 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM l1)"""


def fused_sql(key: str, k: int) -> str:
    return f"""keyed AS (SELECT b.*, {key} AS key FROM pair b JOIN chunks USING (chunk_id)),
sums AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, min(list * 1000 + rank) AS seen, arg_min(chunk_id, list * 1000 + rank) AS chunk_id FROM keyed GROUP BY ALL),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id)::INT AS rank FROM sums) WHERE rank <= {k})"""


PREFIX = "ticker || filing_date || left(content, 120)"


@query("rrf_fuse", f"{LISTS}, {fused_sql(PREFIX, 10)} SELECT * FROM fused")
def _(spark, sf):
    _, c, both = lists(spark, sf)
    return r.rrf_fuse(both, c, 10)


@query("rrf_fuse_chunk_id", f"{LISTS}, {fused_sql('chunk_id', 10)} SELECT * FROM fused")
def _(spark, sf):
    _, c, both = lists(spark, sf)
    return r.rrf_fuse(both, c, 10, key="chunk_id")


NEWEST = """newest AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY filing_date DESC, before)::INT AS rank
  FROM (SELECT f.query_id, f.chunk_id, rrf, f.rank AS before, filing_date, row_number() OVER (PARTITION BY query_id, left(content, 200) ORDER BY filing_date DESC, f.rank) AS k
    FROM fused f JOIN chunks USING (chunk_id)) WHERE k = 1)"""


@query("dedupe_newest", f"{LISTS}, {fused_sql('chunk_id', 40)}, {NEWEST} SELECT * FROM newest")
def _(spark, sf):
    _, c, both = lists(spark, sf)
    return r.dedupe_newest(r.rrf_fuse(both, c, 40, key="chunk_id"), c)


def score_sql(a: str, b: str) -> str:
    return f"round(len(list_intersect(list_distinct({tokens_sql(a)}), {tokens_sql(b)})) / greatest(1, len(list_distinct({tokens_sql(a)}))), 3)"


RERANK = f"""scored AS (SELECT n.query_id, n.chunk_id, n.rank AS before, {score_sql("question", "content")} AS score FROM newest n JOIN chunks USING (chunk_id) JOIN golden USING (query_id)),
reranked AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INT AS rank FROM scored) WHERE rank <= 10)"""


@query("rerank_topk", f"{LISTS}, {fused_sql('chunk_id', 40)}, {NEWEST}, {RERANK} SELECT * FROM reranked")
def _(spark, sf):
    q, c, both = lists(spark, sf)
    return r.rerank_topk(r.dedupe_newest(r.rrf_fuse(both, c, 40, key="chunk_id"), c), q, c, 10)


@query("search_rerank", f"{LISTS}, {fused_sql(PREFIX, 50)}, {NEWEST}, {RERANK} SELECT query_id, chunk_id, rank FROM reranked")
def _(spark, sf):
    q, c, both = lists(spark, sf)
    return r.search(q, c, both[0], "rerank", 10, 50, bm25=both[1])


@query("search_hybrid", f"{LISTS}, {fused_sql(PREFIX, 10)} SELECT query_id, chunk_id, rank FROM fused")
def _(spark, sf):
    q, c, both = lists(spark, sf)
    return r.search(q, c, both[0], "hybrid", 10, 50, bm25=both[1])


def entries(spark, sf):
    g = golden(spark, sf)
    return g.select("query_id", "type", F.array("snippet").alias("snippets"), F.lit(None).cast("date").alias("filing_date"))


RANKS = """ranks AS (SELECT g.query_id, g.type, min(h.rank) FILTER (contains(content, snippet)) AS rank
  FROM golden g LEFT JOIN hits h USING (query_id) LEFT JOIN chunks USING (chunk_id) WHERE h.rank <= 10 OR h.rank IS NULL GROUP BY ALL)"""
BM25_RANKS = f"WITH {INDEX}, {bm25_sql('hits', 10)}, {RANKS}"
METRICS = """count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5,
  count(*) FILTER (rank <= 5) AS hits_at_5, round(coalesce(sum(1.0::DOUBLE / rank), 0) / count(*), 6) AS mrr"""


def bm25_ranks(spark, sf):
    c = chunks(spark, sf)
    return r.first_hit_rank(r.bm25_topk(golden(spark, sf), index(spark, sf), 10), entries(spark, sf), c)


@query("first_hit_rank", f"{BM25_RANKS} SELECT * FROM ranks")
def _(spark, sf):
    return bm25_ranks(spark, sf)


@query("retrieval_metrics", f"{BM25_RANKS} SELECT {METRICS} FROM ranks WHERE type <> 'not_found'")
def _(spark, sf):
    return r.retrieval_metrics(bm25_ranks(spark, sf).filter("type <> 'not_found'"))


@query("retrieval_metrics_by_type", f"{BM25_RANKS} SELECT type, {METRICS}, coalesce(list_sort(list(query_id) FILTER (rank IS NULL)), []) AS missed FROM ranks GROUP BY type")
def _(spark, sf):
    return r.retrieval_metrics(bm25_ranks(spark, sf), "type")


@query(
    "evaluate",
    f"""{LISTS}, {fused_sql(PREFIX, 50)}, {NEWEST}, {RERANK},
hits_all AS (SELECT 'bm25' AS mode, query_id, chunk_id, rank FROM l1 WHERE rank <= 10 UNION ALL SELECT 'first', query_id, chunk_id, rank FROM l0 WHERE rank <= 10
  UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fused WHERE rank <= 10 UNION ALL SELECT 'rerank', query_id, chunk_id, rank FROM reranked),
ranks AS (SELECT mode, g.query_id, min(h.rank) FILTER (contains(content, snippet)) AS rank FROM golden g JOIN hits_all h USING (query_id) JOIN chunks USING (chunk_id) WHERE type <> 'not_found' GROUP BY ALL)
SELECT mode, {METRICS} FROM ranks GROUP BY mode""",
)
def _(spark, sf):
    q, c, (first, second) = lists(spark, sf)
    hits = {mode: r.search(q, c, first, {"first": "dense"}.get(mode, mode), 10, 50, bm25=second) for mode in ("first", "bm25", "hybrid", "rerank")}
    return r.evaluate(entries(spark, sf), c, hits)[1].drop("missed")


@query(
    "not_found_top_scores",
    f"WITH {INDEX}, {bm25_sql('hits', 10)} SELECT g.query_id, score, replace(left(content, 150), chr(10), ' ') AS start FROM golden g LEFT JOIN hits h ON h.query_id = g.query_id AND h.rank = 1 LEFT JOIN chunks USING (chunk_id) WHERE type = 'not_found'",
)
def _(spark, sf):
    c, g = chunks(spark, sf), golden(spark, sf)
    return r.not_found_top_scores(r.bm25_topk(g, index(spark, sf), 10), g, c)


@query(
    "pool_sweep",
    f"""{LISTS}, {fused_sql("chunk_id", 100)},
s AS (SELECT f.query_id, f.chunk_id, f.rank, contains(content, snippet) AS match, {score_sql("question", "content")} AS score FROM fused f JOIN chunks USING (chunk_id) JOIN golden USING (query_id)),
p AS (SELECT s.*, pool, row_number() OVER (PARTITION BY query_id, pool ORDER BY score DESC, rank)::INT AS reranked FROM s JOIN (SELECT unnest([10, 30, 60])::INT AS pool) ON rank <= pool)
SELECT query_id, pool, count(*) FILTER (match) AS matches, (min(rank) FILTER (match)) - 1 AS fused_rank, (min(reranked) FILTER (match)) - 1 AS reranked_rank, max(score) FILTER (match) AS score FROM p GROUP BY ALL""",
)
def _(spark, sf):
    q, c, both = lists(spark, sf)
    fused = kept(r.rrf_fuse(both, c, 100, key="chunk_id"))
    return r.pool_sweep(fused, r.rerank_topk(fused, q, c, 100), q.select("query_id", F.col("snippet").alias("needle")), c, (10, 30, 60))


@query(
    "top_sections_report",
    f"""WITH {INDEX}, {bm25_sql("hits", 5)} SELECT query_id, list({{'rank': rank, 'section': replace(left(ticker || chr(10) || content, 35), chr(10), ' '), 'content': replace(left(content, 400), chr(10), ' ')}} ORDER BY rank) AS rows
FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id""",
)
def _(spark, sf):
    c, g = chunks(spark, sf), golden(spark, sf)
    return r.top_sections_report(r.bm25_topk(g, index(spark, sf), 5), c.select("chunk_id", "content", F.concat("ticker", F.lit("\n"), "content").alias("section")))


@query(
    "evaluate_not_found",
    f"""{LISTS}, n AS (SELECT 'bm25' AS mode, * FROM l1 UNION ALL SELECT 'first', * FROM l0)
SELECT m.mode, g.query_id, n.score, replace(left(content, 150), chr(10), ' ') AS start FROM golden g CROSS JOIN (SELECT unnest(['bm25', 'first']) AS mode) m
LEFT JOIN n ON n.query_id = g.query_id AND n.mode = m.mode AND n.rank = 1 LEFT JOIN chunks USING (chunk_id) WHERE type = 'not_found'""",
)
def _(spark, sf):
    _, c, (first, second) = lists(spark, sf)
    return r.evaluate(entries(spark, sf), c, {"first": first, "bm25": second})[2]


@query("embed")
def _(spark, sf):
    return embed(chunks(spark, sf).select("chunk_id", "content"))


def dense_list(spark, sf, k=50):
    """The real dense list: questions and chunks through the default encoder."""
    q = embed(golden(spark, sf).select("query_id", F.col("question").alias("content")))
    return r.dense_topk(q, embed(chunks(spark, sf).select("chunk_id", "content")), k)


@query("search_dense")
def _(spark, sf):
    return dense_list(spark, sf, 10)


@query("search_hybrid_dense")
def _(spark, sf):
    q, c = golden(spark, sf), chunks(spark, sf)
    return r.search(q, c, kept(dense_list(spark, sf)), "hybrid", 10, 50, bm25=kept(r.bm25_topk(q, index(spark, sf), 50)))


@query("search_rerank_dense")
def _(spark, sf):
    q, c = golden(spark, sf), chunks(spark, sf)
    return r.search(q, c, kept(dense_list(spark, sf)), "rerank", 10, 50, bm25=kept(r.bm25_topk(q, index(spark, sf), 50)))


@query("evaluate_dense")
def _(spark, sf):
    """The four modes with a real dense list: both lists are made once, and each mode is derived from them."""
    q, c = golden(spark, sf), chunks(spark, sf)
    dense, bm25 = kept(dense_list(spark, sf)), kept(r.bm25_topk(q, index(spark, sf), 50))
    hits = {mode: r.search(q, c, dense, mode, 10, 50, bm25=bm25) for mode in ("dense", "bm25", "hybrid", "rerank")}
    return r.evaluate(entries(spark, sf), c, hits)[1].drop("missed")
