"""Queries of routing and scopes. Questions are benchmark questions with a source and sometimes a year appended."""

from pyspark.sql import functions as F

from lakeqa.operators import corpus
from lakeqa.operators import routing as r
from lakeqa.plans.feeds import CHUNKS, GOLDEN, PIECES, chunks, golden, pieces, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def asked(spark, sf):
    i = F.col("query_id")
    ticker = F.when(i % 4 != 3, F.concat(F.lit("SRC"), (i % 21).cast("string")))
    year = F.when(i % 3 == 0, F.concat(F.lit(" in "), (2023 + i % 5).cast("string"))).otherwise("")
    named = F.when(i % 5 == 4, F.lit(" src2")).otherwise("")
    text = F.concat("question", F.lit(" of src"), (i % 21).cast("string"), year, named)
    return golden(spark, sf).select("query_id", text.alias("question"), ticker.alias("ticker"), "snippet", "type")


ASKED = f"""{GOLDEN}, asked AS (SELECT query_id, question || ' of src' || (query_id % 21) || CASE WHEN query_id % 3 = 0 THEN ' in ' || (2023 + query_id % 5) ELSE '' END
  || CASE WHEN query_id % 5 = 4 THEN ' src2' ELSE '' END AS question, CASE WHEN query_id % 4 <> 3 THEN 'SRC' || (query_id % 21) END AS ticker, snippet, type FROM golden)"""


def registry(spark, sf):
    return chunks(spark, sf).select("ticker", F.year("filing_date").alias("fiscal_year"), "filing_date").distinct()


REGISTRY = f"{CHUNKS}, registry AS (SELECT DISTINCT ticker, year(filing_date)::INT AS fiscal_year, filing_date FROM chunks)"
DATES = rf"""{REGISTRY}, {ASKED},
y AS (SELECT *, list_transform(regexp_extract_all(question, '\b(?:19|20)\d{{2}}\b'), lambda y: y::INT) AS years FROM asked),
k AS (SELECT ticker, list(filing_date) AS every, list({{'y': fiscal_year, 'd': filing_date}}) AS filings FROM registry GROUP BY ticker),
m AS (SELECT y.*, list_reverse_sort(every) AS every, list_reverse_sort(list_distinct(list_transform(list_filter(filings, lambda f: list_contains(years, f.y)), lambda f: f.d))) AS matched FROM y LEFT JOIN k USING (ticker)),
resolved AS (SELECT query_id, question, ticker, CASE WHEN every IS NULL THEN NULL WHEN len(matched) > 0 THEN matched WHEN len(years) > 0 THEN every ELSE every[1:1] END AS dates FROM m)"""


@query("resolve_filing_dates", f"WITH {DATES} SELECT query_id, dates FROM resolved")
def _(spark, sf):
    return r.resolve_filing_dates(asked(spark, sf), registry(spark, sf)).select("query_id", "dates")


@query("scope_join", f"WITH {DATES} SELECT query_id, chunk_id FROM resolved q JOIN chunks c ON (q.ticker IS NULL OR q.ticker = c.ticker) AND (q.dates IS NULL OR list_contains(q.dates, c.filing_date))")
def _(spark, sf):
    return r.scope_join(r.resolve_filing_dates(asked(spark, sf), registry(spark, sf)), chunks(spark, sf))


@query("cells_of", f"WITH {DATES} SELECT q.query_id, CASE WHEN ticker IS NULL AND dates IS NULL THEN NULL ELSE (SELECT count(*) FROM registry r WHERE (q.ticker IS NULL OR q.ticker = r.ticker) AND (q.dates IS NULL OR list_contains(q.dates, r.filing_date))) END AS n_cells FROM resolved q")
def _(spark, sf):
    routed = r.resolve_filing_dates(asked(spark, sf), registry(spark, sf))
    cells = r.cells_of(routed, r.cell_dictionary(chunks(spark, sf)))
    return cells.select("query_id", F.when(F.col("cells").isNotNull(), F.size("cells")).cast("long").alias("n_cells"))


ALIASES = "aliases AS (SELECT DISTINCT upper(source) AS ticker, unnest([source, replace(source, 'src', 'source ')]) AS alias FROM documents)"
DETECTED = rf"""{ASKED}, {ALIASES}, h AS (SELECT query_id, list_distinct(list(aliases.ticker)) AS found FROM asked JOIN aliases ON regexp_matches(lower(question), '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') GROUP BY query_id),
detected AS (SELECT asked.query_id, CASE WHEN len(found) = 1 THEN found[1] END AS ticker, CASE WHEN found IS NULL THEN 'zero' WHEN len(found) = 1 THEN 'single' ELSE 'multiple' END AS status FROM asked LEFT JOIN h USING (query_id))"""


def detected(spark, sf):
    sources = table(spark, sf, "documents").select("source").distinct()
    alias = F.explode(F.array("source", F.replace("source", F.lit("src"), F.lit("source "))))
    return r.detect_ticker(asked(spark, sf), sources.select(F.upper("source").alias("ticker"), alias.alias("alias")))


@query("detect_ticker", f"WITH {DETECTED} SELECT * FROM detected")
def _(spark, sf):
    return detected(spark, sf)


@query(
    "resolve_ticker",
    f"WITH {DETECTED} SELECT query_id, coalesce(a.ticker, d.ticker) AS ticker, CASE WHEN a.ticker IS NOT NULL THEN 'request' WHEN d.ticker IS NOT NULL THEN 'detected' ELSE 'none' END AS ticker_source FROM asked a JOIN detected d USING (query_id)",
)
def _(spark, sf):
    return r.resolve_ticker(asked(spark, sf), detected(spark, sf))


@query("filter_scope", f"WITH {CHUNKS} SELECT chunk_id, ticker, filing_date FROM chunks WHERE ticker = 'SRC3' AND filing_date IN (DATE '2024-01-01', DATE '2026-01-01')")
def _(spark, sf):
    import datetime

    days = [datetime.date(2024, 1, 1), datetime.date(2026, 1, 1)]
    return r.filter_scope(chunks(spark, sf), "src3", days).select("chunk_id", "ticker", "filing_date")


@query(
    "validate_requests",
    """WITH r AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN '  ' || left(text, 2) ELSE text END) AS question,
  nullif(upper(trim(CASE conv_id % 4 WHEN 0 THEN ' src1 ' WHEN 1 THEN '  ' WHEN 2 THEN 'xyz' END)), '') AS ticker FROM conversations)
SELECT *, CASE WHEN length(question) < 3 THEN 'question too short' WHEN length(question) > 1000 THEN 'question too long' WHEN ticker IS NOT NULL AND ticker NOT IN ('SRC1', 'SRC2') THEN 'unknown ticker' END AS reason FROM r""",
)
def _(spark, sf):
    k = F.col("conv_id") % 4
    c = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.left("text", F.lit(2)))).otherwise(F.col("text")).alias("question"),
        F.when(k == 0, F.lit(" src1 ")).when(k == 1, F.lit("  ")).when(k == 2, F.lit("xyz")).alias("ticker"),
    )
    return r.validate_requests(c, ["SRC1", "SRC2"])


PHRASES = f"""{CHUNKS}, phrases AS (SELECT item_id AS phrase_id, upper(substring(text, 5, 8)) AS phrase, 'SRC' || (item_id % 20) AS ticker, CASE WHEN item_id % 2 = 0 THEN DATE '2024-01-01' END AS wanted FROM benchmark)"""


@query(
    "find_text",
    f"""WITH {PHRASES}, f AS (SELECT phrase_id, filing_date, chunk_id, content, length(phrase) AS n, instr(lower(content), lower(phrase)) AS pos FROM chunks JOIN phrases USING (ticker)
  WHERE contains(lower(content), lower(phrase)) AND (wanted IS NULL OR wanted = filing_date)),
s AS (SELECT phrase_id, filing_date, chunk_id, replace(substring(content, greatest(1, pos - 150), pos - greatest(1, pos - 150) + n + 150), chr(10), ' ') AS snippet,
  row_number() OVER (PARTITION BY phrase_id ORDER BY filing_date DESC, chunk_id)::INT AS rank, count(*) OVER (PARTITION BY phrase_id) AS total FROM f)
SELECT * FROM s WHERE rank <= 10""",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    p = b.select(
        F.col("item_id").alias("phrase_id"), F.upper(F.substring("text", 5, 8)).alias("phrase"), F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")).alias("ticker"), F.when(F.col("item_id") % 2 == 0, F.lit("2024-01-01").cast("date")).alias("filing_date")
    )
    return r.find_text(chunks(spark, sf), p)


@query("chunks_with_documents", f"WITH {PIECES} SELECT document_id, chunk_index, content, lang, source FROM pieces JOIN documents ON doc_id = document_id")
def _(spark, sf):
    return r.chunks_with_documents(pieces(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source"))


@query("new_filings", "SELECT page_id, url AS source_path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("source_path"))
    return corpus.new_filings(p, p.filter("page_id % 3 = 0")).select("page_id", "source_path")


def listing(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("form"), F.col("o_orderkey").alias("pos"), "o_totalprice")


@query(
    "latest_filings",
    "SELECT o_custkey AS ticker, o_orderkey AS pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k <= 2",
)
def _(spark, sf):
    return r.latest_filings(listing(spark, sf), "O").select("ticker", "pos")


@query(
    "explode_listing",
    "SELECT o_custkey AS ticker, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_orderstatus AS form, o_orderkey::VARCHAR AS accession, o_orderdate::DATE AS filing_date, o_orderpriority AS document FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    row = F.struct("o_orderkey", F.col("o_orderstatus").alias("form"), F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderdate").cast("date").cast("string").alias("d"), F.col("o_orderpriority").alias("p"))
    g = o.groupBy(F.col("o_custkey").alias("ticker")).agg(F.array_sort(F.collect_list(row)).alias("f"))
    part = lambda name: F.transform("f", lambda x: x[name])
    return r.explode_listing(g.select("ticker", part("form").alias("form"), part("a").alias("accessionNumber"), part("d").alias("filingDate"), part("p").alias("primaryDocument")))


@query("ticker_cik_join", "SELECT c_custkey AS ticker, lpad(n_regionkey::VARCHAR, 10, '0') AS cik, n_regionkey IS NOT NULL AS found FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 4 <> 1")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("ticker"))
    n = table(spark, sf, "nation").filter("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("ticker"), F.col("n_regionkey").alias("cik"))
    return r.ticker_cik_join(c, n).select(F.col("id").alias("ticker"), "cik", "found")
