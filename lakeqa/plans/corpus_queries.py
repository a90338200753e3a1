"""Queries of corpus building, packing and the checks on both."""

from pyspark.sql import functions as F

from lakeqa.functions import text as t
from lakeqa.operators import corpus as c
from lakeqa.operators import packing as k
from lakeqa.operators import retrieval as r
from lakeqa.plans.feeds import CHUNKS, GOLDEN, PIECES, chunks, golden, index, kept, piece_count, pieces, table, tokens_sql
from lakeqa.plans.retrieval_queries import METRICS

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("clean_html")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", c.clean_html("html").alias("text"))


# Filings: item headings around each document's text; every third has none, every fifth repeats an item.
def filings(spark, sf):
    i, text = F.col("doc_id"), F.col("text")
    body = F.concat(F.lit("Intro\nItem 1. Business | 3\n"), text, F.lit("\nITEM 1A - Risk\n"), F.left(text, F.lit(900)), F.lit("\nItem 7.\nShort"), F.when(i % 5 == 0, F.lit("\nitem 1: Again\nmore")).otherwise(""))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.when(i % 3 == 0, text).otherwise(body).alias("text"))


FILINGS = r"""filings AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Intro' || chr(10) || 'Item 1. Business | 3' || chr(10) || text || chr(10) || 'ITEM 1A - Risk' || chr(10) || left(text, 900)
  || chr(10) || 'Item 7.' || chr(10) || 'Short' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'item 1: Again' || chr(10) || 'more' ELSE '' END END AS text FROM documents),
lines AS (SELECT document_id, i - 1 AS line_no, s[i] AS line FROM (SELECT document_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM filings)),
heads AS (SELECT *, CASE WHEN length(line) < 200 AND regexp_matches(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)\s*[\.\:\-–—]?\s*(.*)$') THEN upper(regexp_extract(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)', 1)) END AS key,
  trim(regexp_extract(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)\s*[\.\:\-–—]?\s*(.*)$', 2)) AS title FROM lines),
spans AS (SELECT *, count(key) OVER (PARTITION BY document_id ORDER BY line_no) AS span FROM heads)"""
SECTIONS = FILINGS + """,
bodies AS (SELECT document_id, span, max(key) AS key, min(line_no) AS first_line, min(title) FILTER (key IS NOT NULL AND title <> '') AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (key IS NULL), '') AS body FROM spans GROUP BY ALL),
merged AS (SELECT document_id, key, min(first_line) AS first_line, arg_min(title, span) FILTER (title IS NOT NULL) AS title, string_agg(body, chr(10) ORDER BY span) AS body, count(*) OVER (PARTITION BY document_id) AS n FROM bodies GROUP BY document_id, key),
sections AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY first_line) - 1)::INT AS section_order, CASE WHEN key IS NULL THEN 'Unsectioned' ELSE trim('Item ' || key || '. ' || coalesce(title, ''), '. ') END AS section, body
  FROM merged WHERE key IS NOT NULL OR n = 1 OR regexp_matches(body, '\\S'))"""


@query("split_sections", f"WITH {SECTIONS} SELECT * FROM sections")
def _(spark, sf):
    return c.split_sections(filings(spark, sf))


@query("section_spans", f"WITH {FILINGS} SELECT document_id, span, max(key) AS key, min(line_no)::INT AS first_line, count(*) AS lines FROM spans GROUP BY document_id, span")
def _(spark, sf):
    return c.section_spans(filings(spark, sf))


@query(
    "section_report",
    rf"""WITH {SECTIONS}, s AS (SELECT *, CASE WHEN split_part(section, ' ', 1) = 'Item' THEN regexp_replace(split_part(section, ' ', 2), '\.+$', '') END AS key FROM sections),
k AS (SELECT document_id, key, arg_max(length(body), section_order) AS chars FROM s WHERE key IN ('1', '1A', '7', '8') GROUP BY ALL),
l AS (SELECT document_id, count(*) AS n_sections FROM s GROUP BY document_id),
g AS (SELECT document_id, any_value(n_sections) AS n_sections, list(key ORDER BY key) FILTER (key IS NOT NULL) AS present, list(key ORDER BY key) FILTER (chars < 500) AS thin FROM l LEFT JOIN k USING (document_id) GROUP BY document_id),
m AS (SELECT document_id, n_sections, list_filter(['1', '1A', '7', '8'], lambda x: NOT list_contains(coalesce(present, []), x)) AS missing, coalesce(thin, []) AS thin FROM g)
SELECT *, CASE WHEN len(missing) > 0 OR len(thin) > 0 THEN 'CHECK' ELSE 'OK' END AS status FROM m""",
)
def _(spark, sf):
    return c.section_report(c.split_sections(filings(spark, sf))).drop("sizes")


@query("chunk_text")
def _(spark, sf):
    return c.chunk_text(c.split_sections(filings(spark, sf)))


@query(
    "chunk_index",
    f"WITH {SECTIONS}, p AS (SELECT document_id, section_order, i AS piece FROM (SELECT *, unnest(range(0, 1 + length(body) // 800)) AS i FROM sections)) SELECT document_id, section_order, piece::INT AS piece, (row_number() OVER (PARTITION BY document_id ORDER BY section_order, piece) - 1)::INT AS chunk_index FROM p",
)
def _(spark, sf):
    s = c.split_sections(filings(spark, sf))
    p = s.select("document_id", "section_order", F.explode(F.sequence(F.lit(0), F.floor(F.length("body") / 800).cast("int"))).alias("piece"))
    return c.chunk_index(p)


@query("build_corpus")
def _(spark, sf):
    p = table(spark, sf, "pages")
    manifest = p.select(
        F.col("page_id").alias("document_id"), F.lit("Acme").alias("company"), F.concat(F.lit("SRC"), (F.col("page_id") % 20).cast("string")).alias("ticker"), F.lit("10-K").alias("form_type"), F.lit("2024-01-01").cast("date").alias("filing_date"), F.concat("url", F.lit(" "), F.col("page_id").cast("string")).alias("source_path")
    )
    pages = p.select(F.concat("url", F.lit(" "), F.col("page_id").cast("string")).alias("source_path"), "html")
    return c.build_corpus(manifest, pages)


@query("adjacent_overlap", f"""WITH {PIECES}, w AS (SELECT document_id, chunk_index, left(content, 150) AS head, lag(chunk_index) OVER o AS before, lag(right(content, 150)) OVER o AS tail FROM pieces WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index))
SELECT document_id, chunk_index, coalesce(before = chunk_index - 1, false) AS adjacent, coalesce(before = chunk_index - 1, false) AND tail = head AS matches FROM w""")
def _(spark, sf):
    return c.adjacent_overlap(pieces(spark, sf), F.col("content"))


@query("adjacent_overlap_all", f"""WITH {PIECES}, w AS (SELECT document_id, chunk_index, left(content, 150) AS head, lag(chunk_index) OVER o AS before, lag(right(content, 150)) OVER o AS tail FROM pieces WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index))
SELECT document_id, chunk_index, coalesce(before = chunk_index - 1, false) AS adjacent, coalesce(before = chunk_index - 1, false) AND tail = head AS matches FROM w""")
def _(spark, sf):
    return c.adjacent_overlap(pieces(spark, sf), F.col("content"))


HEADED = f"""{PIECES}, h AS (SELECT document_id, chunk_index, CASE WHEN chunk_index % 5 <> 4 THEN 'Acme (SRC) 10-K | x' ELSE '' END AS header, content AS body FROM pieces)"""


@query("overlap_report", f"""WITH {HEADED}, w AS (SELECT *, lag(chunk_index) OVER o AS before, lag(right(body, 150)) OVER o AS tail FROM h WINDOW o AS (PARTITION BY document_id ORDER BY chunk_index)),
s AS (SELECT count(*) AS chunks, count(*) FILTER (header <> '') AS with_header, count(*) FILTER (before = chunk_index - 1) AS pairs, count(*) FILTER (before = chunk_index - 1 AND tail = left(body, 150)) AS matches FROM w)
SELECT *, round(100.0::DOUBLE * matches / pairs, 2) AS match_rate FROM s""")
def _(spark, sf):
    text = F.when(F.col("chunk_index") % 5 != 4, F.concat(F.lit("Acme (SRC) 10-K | x\n"), "content")).otherwise(F.col("content"))
    p = pieces(spark, sf).withColumn("s", t.split_header(text))
    return c.overlap_report(p, F.col("s.header"), F.col("s.body"))


@query("chunk_counts", f"WITH {PIECES}, n AS (SELECT document_id, count(*) AS n_chunks FROM pieces GROUP BY document_id) SELECT *, (SELECT median(n_chunks) FROM n) AS median, n_chunks < 0.25 * (SELECT median(n_chunks) FROM n) AS low FROM n")
def _(spark, sf):
    return c.chunk_counts(pieces(spark, sf))


# Hits: ten of all pieces of the five documents that BM25 ranks highest, in an order by hash; ids hold any number of pieces.
def hits(spark, sf):
    from pyspark.sql import Window

    top = kept(r.bm25_topk(golden(spark, sf), index(spark, sf), 5)).select("query_id", F.col("chunk_id").alias("document_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    # ranks are settled by numbers of pieces; texts are joined and cut for ten of them
    counts = docs.select("document_id", piece_count().alias("n"))
    rows = top.join(counts, "document_id").select("query_id", "document_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    rows = rows.withColumn("id", F.col("document_id") * 2**22 + F.col("chunk_index"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("id") * 7919) % 1009, "id"))
    rows = rows.withColumn("rank", rank).filter("rank <= 10").join(docs, "document_id")
    rows = kept(rows.withColumn("content", F.substr("text", 650 * F.col("chunk_index") + 1, F.lit(800))).drop("text"))
    date = F.make_date(F.lit(2024) + (F.col("document_id") % 3).cast("int"), F.lit(1), F.lit(1))
    return rows.select("query_id", "rank", F.col("id").alias("chunk_id"), F.col("document_id").alias("filing_id"), F.col("chunk_index").alias("position"), F.lit("Acme (SRC) 10-K | x").alias("header"), F.col("content").alias("text"), date.alias("filing_date"))


from lakeqa.plans.retrieval_queries import INDEX, bm25_sql  # noqa: E402

HITS = f"""{INDEX}, {bm25_sql("top", 5)}, {PIECES},
hits AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 1009, id)::INT AS rank, id AS chunk_id, document_id AS filing_id, chunk_index AS position, text,
    make_date(2024 + (document_id % 3)::INT, 1, 1) AS filing_date
  FROM (SELECT query_id, p.document_id, chunk_index, content AS text, p.document_id * 4194304 + chunk_index AS id FROM top JOIN pieces p ON p.document_id = top.chunk_id)) WHERE rank <= 10)"""
RUNS = HITS + """,
opens AS (SELECT *, coalesce(position <> lag(position) OVER o + 1, true)::INT AS opens FROM hits WINDOW o AS (PARTITION BY query_id, filing_id ORDER BY position, rank)),
blocks AS (SELECT *, sum(opens) OVER (PARTITION BY query_id, filing_id ORDER BY position, rank) AS block FROM opens),
runs AS (SELECT query_id, filing_id, block, list(chunk_id ORDER BY position) AS chunk_ids, any_value(filing_date) AS filing_date, min(rank) AS best,
  list_reduce(list(text ORDER BY position), lambda a, b: CASE WHEN right(a, 150) = left(b, 150) THEN a || substring(b, 151) ELSE a || chr(10) || b END) AS text FROM blocks GROUP BY query_id, filing_id, block)"""


@query("merge_runs", f"WITH {RUNS} SELECT query_id, filing_id, chunk_ids, filing_date, best, text FROM runs")
def _(spark, sf):
    return k.merge_runs(hits(spark, sf)).select("query_id", "filing_id", "chunk_ids", "filing_date", "best", "text")


NUMBERED = RUNS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best)::INT AS number, list_distinct({tokens_sql("text")}) AS t FROM runs),
pairs AS (SELECT a.query_id, a.number, b.number AS other, len(a.t) > 0 AND len(list_intersect(a.t, b.t)) / greatest(1, len(a.t)) >= 0.8 AS duplicate FROM n a JOIN n b ON a.query_id = b.query_id AND b.number < a.number)"""


PACKED = f"""{NUMBERED},
like_ AS (SELECT n.query_id, n.number, coalesce(list(other) FILTER (duplicate), []) AS others FROM n LEFT JOIN pairs p ON p.query_id = n.query_id AND p.number = n.number GROUP BY ALL),
fold AS (SELECT query_id, 1 AS number, [1] AS kept FROM n WHERE number = 1 UNION ALL
  SELECT f.query_id, l.number, CASE WHEN len(list_intersect(others, kept)) > 0 THEN kept ELSE list_append(kept, l.number) END FROM fold f JOIN like_ l ON l.query_id = f.query_id AND l.number = f.number + 1),
stay AS (SELECT query_id, arg_max(kept, number) AS kept FROM fold GROUP BY query_id),
full_ AS (SELECT n.query_id, number, chunk_ids, filing_date::VARCHAR AS filing_date, 'Acme (SRC) 10-K | x' || chr(10) || text AS text FROM n JOIN stay USING (query_id) WHERE list_contains(kept, number)),
cut_ AS (SELECT * REPLACE (CASE WHEN number = 1 THEN left(text, 6000) ELSE text END AS text), number = 1 AND length(text) > 6000 AS truncated FROM full_),
sums AS (SELECT *, sum(length(text) + CASE WHEN number = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY query_id ORDER BY number) AS used, row_number() OVER (PARTITION BY query_id ORDER BY number)::INT AS place FROM cut_)"""


@query(
    "pack",
    f"""WITH RECURSIVE {PACKED}
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS context,
  list({{'number': place, 'chunk_ids': chunk_ids, 'text': text, 'filing_date': filing_date, 'truncated': truncated}} ORDER BY place) AS blocks FROM sums WHERE used <= 6000 GROUP BY query_id""",
)
def _(spark, sf):
    return k.pack(hits(spark, sf))


@query(
    "near_duplicate",
    f"WITH a AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS t FROM documents) SELECT a.doc_id, b.doc_id AS other, len(list_intersect(a.t, b.t)) / len(a.t) >= 0.8 AS duplicate FROM a JOIN a b ON b.doc_id = a.doc_id + 1 WHERE len(a.t) > 0 UNION ALL SELECT a.doc_id, b.doc_id, false FROM a JOIN a b ON b.doc_id = a.doc_id + 1 WHERE len(a.t) = 0",
)
def _(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.array_distinct(t.tokenize(F.col("text"))).alias("t"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("t").alias("u"))
    return a.join(b, "doc_id").select("doc_id", "other", k.near_duplicate(F.col("t"), F.col("u")).alias("duplicate"))


@query("near_duplicate_blocks", f"WITH {NUMBERED} SELECT * FROM pairs")
def _(spark, sf):
    return k.duplicate_pairs(hits(spark, sf))


BUDGET = HITS + """, used AS (SELECT *, sum(length(text) + CASE WHEN rank = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM hits), kept AS (SELECT * FROM used WHERE rank = 1 OR used <= 3000)"""


@query("take_within_budget", f"WITH {BUDGET} SELECT query_id, rank, chunk_id, used::BIGINT AS used FROM kept")
def _(spark, sf):
    return k.take_within_budget(hits(spark, sf), 3000).select("query_id", "rank", "chunk_id", "used")


@query("control_summary", f"WITH {BUDGET}, e AS (SELECT query_id, count(*) AS n, max(used) AS chars FROM kept GROUP BY query_id) SELECT count(*) AS queries, round(avg(n), 6) AS mean_chunks, round(avg(chars), 6) AS mean_chars FROM e")
def _(spark, sf):
    return k.control_summary(k.take_within_budget(hits(spark, sf), 3000))


def entries(spark, sf):
    g = golden(spark, sf)
    i = F.col("query_id")
    snippet = F.when(i % 6 == 5, F.concat(F.lit("no such "), "snippet")).otherwise(F.col("snippet"))
    ticker = F.when(i % 4 == 0, F.concat(F.lit("SRC"), (i % 20).cast("string")))
    date = F.when(i % 8 == 1, F.lit("2024-01-01").cast("date"))
    return g.select("query_id", "type", ticker.alias("ticker"), date.alias("filing_date"), F.array(snippet, F.left("snippet", F.lit(20))).alias("snippets"))


ENTRIES = f"""{CHUNKS}, {GOLDEN}, entries AS (SELECT query_id, type, CASE WHEN query_id % 4 = 0 THEN 'SRC' || (query_id % 20) END AS ticker, CASE WHEN query_id % 8 = 1 THEN DATE '2024-01-01' END AS wanted,
  [CASE WHEN query_id % 6 = 5 THEN 'no such ' || snippet ELSE snippet END, left(snippet, 20)] AS snippets FROM golden),
matches AS (SELECT query_id, snippet, chunk_id, filing_date FROM (SELECT *, unnest(snippets) AS snippet FROM entries) e JOIN chunks c ON contains(content, snippet) AND (e.ticker IS NULL OR e.ticker = c.ticker) AND (wanted IS NULL OR wanted = filing_date))"""


@query("snippet_match", f"WITH {ENTRIES} SELECT * FROM matches")
def _(spark, sf):
    return k.snippet_match(entries(spark, sf), chunks(spark, sf))


@query(
    "snippet_audit",
    f"""WITH {ENTRIES}, n AS (SELECT query_id, count(*) AS matches, count(DISTINCT snippet) AS found, list_sort(list(DISTINCT filing_date)) AS dates FROM matches GROUP BY query_id)
SELECT query_id, coalesce(matches, 0) AS matches, coalesce(found, 0) AS found, coalesce(dates, []) AS dates, CASE WHEN type = 'not_found' THEN 'SKIP' WHEN found = len(list_distinct(snippets)) THEN 'OK' ELSE 'BROKEN' END AS status FROM entries LEFT JOIN n USING (query_id)""",
)
def _(spark, sf):
    return k.snippet_audit(entries(spark, sf), chunks(spark, sf))


def ranks(spark, sf, b=0.75, ix=None):
    q, ch = golden(spark, sf), chunks(spark, sf)
    e = q.filter("type <> 'not_found'").select("query_id", "type", F.array("snippet").alias("snippets"), F.lit(None).cast("date").alias("filing_date"))
    return kept(r.first_hit_rank(r.bm25_topk(q, index(spark, sf) if ix is None else ix, 10, b=b), e, ch))


def ranks_sql(name, b):
    return f"""{bm25_sql("l_" + name, 10, b)}, {name} AS (SELECT g.query_id, min(h.rank) FILTER (contains(content, snippet)) AS rank FROM golden g JOIN l_{name} h USING (query_id) JOIN chunks USING (chunk_id) WHERE type <> 'not_found' GROUP BY g.query_id)"""


COMPARED = f"WITH {INDEX}, {ranks_sql('base', 0.75)}, {ranks_sql('other', 0.0)}"


@query("compare_runs", f"{COMPARED} SELECT query_id, b.rank AS base_rank, o.rank AS other_rank, o.rank - b.rank AS delta, b.query_id IS NOT NULL AND o.query_id IS NOT NULL AS in_both FROM base b FULL JOIN (SELECT * FROM other WHERE query_id % 5 <> 0) o USING (query_id)")
def _(spark, sf):
    ix = index(spark, sf)
    return k.compare_runs(ranks(spark, sf, ix=ix), ranks(spark, sf, 0.0, ix).filter("query_id % 5 <> 0"))


@query(
    "run_verdict",
    f"""{COMPARED}, m AS (SELECT 'b' AS w, {METRICS} FROM base UNION ALL SELECT 'o', {METRICS} FROM other)
SELECT 'same' AS run, true AS scorer_ok, CASE WHEN o.hit_at_5 >= b.hit_at_5 AND o.mrr >= b.mrr THEN 'KEEP' ELSE 'DROP' END AS verdict FROM m b, m o WHERE b.w = 'b' AND o.w = 'o'
UNION ALL SELECT 'missed', false, 'INVALID'""",
)
def _(spark, sf):
    ix = index(spark, sf)
    base, other = (kept(r.retrieval_metrics(ranks(spark, sf, b, ix))) for b in (0.75, 0.0))
    missed = base.withColumn("mrr", F.col("mrr") + 0.001)  # a scorer that does not reproduce the base
    same = k.run_verdict(base, base, other).withColumn("run", F.lit("same"))
    return same.unionByName(k.run_verdict(base, missed, other).withColumn("run", F.lit("missed")))


@query(
    "control_verdict",
    f"""{COMPARED}, m AS (SELECT 'b' AS w, {METRICS} FROM base UNION ALL SELECT 'o', {METRICS} FROM other)
SELECT 'same' AS run, true AS scorer_ok, CASE WHEN b.hit_at_5 > o.hit_at_5 AND b.mrr > o.mrr THEN 'PACKING ADDS VALUE' WHEN b.hit_at_5 = o.hit_at_5 AND abs(b.mrr - o.mrr) < 0.005 THEN 'NO DIFFERENCE' ELSE 'UNCLEAR' END AS verdict FROM m b, m o WHERE b.w = 'b' AND o.w = 'o'
UNION ALL SELECT 'missed', false, 'INVALID'""",
)
def _(spark, sf):
    ix = index(spark, sf)
    base, other = (kept(r.retrieval_metrics(ranks(spark, sf, b, ix))) for b in (0.75, 0.0))
    missed = base.withColumn("mrr", F.col("mrr") + 0.001)
    same = k.control_verdict(base, base, other, base).withColumn("run", F.lit("same"))
    return same.unionByName(k.control_verdict(base, missed, other, base).withColumn("run", F.lit("missed")))


@query(
    "packed_vs_control",
    f"""WITH RECURSIVE {PACKED},
found AS (SELECT 'PROD' AS system, query_id, rank, text FROM hits UNION ALL SELECT 'BASE', query_id, rank, text FROM hits WHERE rank <= 5 UNION ALL SELECT 'PACKED', query_id, place, text FROM sums WHERE used <= 6000
  UNION ALL SELECT 'CONTROL', query_id, rank, text FROM (SELECT *, sum(length(text) + CASE WHEN rank = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM hits) WHERE rank = 1 OR used <= 6000),
ranks AS (SELECT s.system, g.query_id, min(rank) FILTER (contains(text, snippet)) AS rank FROM golden g CROSS JOIN (SELECT unnest(['BASE', 'PROD', 'CONTROL', 'PACKED']) AS system) s
  LEFT JOIN found f ON f.system = s.system AND f.query_id = g.query_id WHERE type <> 'not_found' GROUP BY ALL)
SELECT system, {METRICS} FROM ranks GROUP BY system""",
)
def _(spark, sf):
    h = hits(spark, sf)
    e = golden(spark, sf).filter("type <> 'not_found'").select("query_id", "type", F.array("snippet").alias("snippets"), F.lit(None).cast("date").alias("filing_date"))
    return k.packed_vs_control(e, h, base=h.filter("rank <= 5"))[0]


@query("audit_counts", f"""WITH {ENTRIES}, n AS (SELECT query_id, count(DISTINCT snippet) AS found FROM matches GROUP BY query_id),
s AS (SELECT CASE WHEN type = 'not_found' THEN 'SKIP' WHEN found = len(list_distinct(snippets)) THEN 'OK' ELSE 'BROKEN' END AS status FROM entries LEFT JOIN n USING (query_id))
SELECT count(*) AS entries, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'BROKEN') AS broken, count(*) FILTER (status = 'SKIP') AS skipped FROM s""")
def _(spark, sf):
    return k.audit_counts(k.snippet_audit(entries(spark, sf), chunks(spark, sf)))


@query(
    "tokenizer_counts",
    f"SELECT count(*) AS rows, count(*) FILTER ({tokens_sql('text')} <> regexp_extract_all(lower(text), '[a-z0-9]+')) AS mismatches FROM conversations",
)
def _(spark, sf):
    d = table(spark, sf, "conversations")
    return t.tokenizer_diff(d, ["conv_id", "turn"], F.col("text"), t.tokenize, t.plain_tokens, sample=None)[0]


@query(
    "tokenizer_diff",
    f"SELECT conv_id, turn, {tokens_sql('text')} AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM conversations WHERE {tokens_sql('text')} <> regexp_extract_all(lower(text), '[a-z0-9]+')",
)
def _(spark, sf):
    return t.tokenizer_diff(table(spark, sf, "conversations"), ["conv_id", "turn"], F.col("text"), t.tokenize, t.plain_tokens, sample=None)[1]


@query(
    "tokenizer_report",
    f"""WITH c AS (SELECT doc_id AS id, text FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 500), q AS (SELECT item_id AS id, text FROM benchmark),
r AS (SELECT 'corpus' AS part, id, {tokens_sql('text')} AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM c UNION ALL SELECT 'questions', id, {tokens_sql('text')}, regexp_extract_all(lower(text), '[a-z0-9]+') FROM q),
d AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS k FROM r WHERE a <> b)
SELECT part, count(*) AS rows, count(*) FILTER (a <> b) AS mismatches, (SELECT coalesce(list({{'id': id, 'a': a, 'b': b}} ORDER BY id), []) FROM d WHERE d.part = r.part AND k <= 10) AS examples FROM r GROUP BY part""",
)
def _(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return t.tokenizer_report(c, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), t.tokenize, t.plain_tokens)
