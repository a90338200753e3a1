"""Queries of the column functions."""

from pyspark.sql import functions as F

from lakeqa.functions import text as t
from lakeqa.plans.feeds import ANSWERS, answers, table, tokens_sql

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("tokenize", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.tokenize(F.col("text")).alias("tokens"))


@query("normalize_question", r"SELECT conv_id, turn, lower(trim(regexp_replace('  ' || text || chr(160) || ' Now?  ', '[\s\x{00A0}\x0B\x{0085}]+', ' ', 'g'))) AS q FROM conversations")
def _(spark, sf):
    q = t.normalize_question(F.concat(F.lit("  "), "text", F.lit("  Now?  ")))
    return table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"))


@query(
    "cache_key",
    r"""SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[\s\x{00A0}\x0B\x{0085}]+', ' ', 'g'))) || chr(1) || CASE WHEN turn % 2 = 0 THEN 'SRC1' ELSE '' END
  || chr(1) || 'v4' || chr(1) || 'm' || chr(1) || 'c1') AS key FROM conversations""",
)
def _(spark, sf):
    ticker = F.when(F.col("turn") % 2 == 0, F.lit("src1"))
    key = t.cache_key(F.col("text"), ticker, F.lit("v4"), F.lit("m"), F.lit("c1"))
    return table(spark, sf, "conversations").select("conv_id", "turn", key.alias("key"))


HEADED = "CASE doc_id % 3 WHEN 0 THEN 'Acme (SRC) 10-K | Item 1' || chr(10) || text WHEN 1 THEN 'Acme (SRC)  20-F | x' || chr(10) || text ELSE text END"


def headed():
    k = F.col("doc_id") % 3
    return F.when(k == 0, F.concat(F.lit("Acme (SRC) 10-K | Item 1\n"), "text")).when(k == 1, F.concat(F.lit("Acme (SRC)  20-F | x\n"), "text")).otherwise(F.col("text"))


@query(
    "split_header",
    f"""SELECT doc_id, h AS header, CASE WHEN h = '' THEN c ELSE substring(c, length(h) + 2) END AS body
FROM (SELECT doc_id, c, regexp_extract(c, '^([^\\n]*\\([A-Z.\\-]+\\) 10-K \\| [^\\n]*)\\n', 1) AS h FROM (SELECT doc_id, {HEADED} AS c FROM documents))""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.split_header(headed()).alias("s")).select("doc_id", "s.header", "s.body")


@query(
    "strip_header",
    f"""SELECT doc_id, CASE WHEN contains(c, chr(10)) AND regexp_matches(split_part(c, chr(10), 1), '\\([A-Z][A-Z.\\-]{{0,7}}\\)\\s+[^|]*\\|')
  THEN substring(c, length(split_part(c, chr(10), 1)) + 2) ELSE c END AS body FROM (SELECT doc_id, {HEADED} AS c FROM documents)""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.strip_header(headed()).alias("body"))


LABEL = "CASE doc_id % 4 WHEN 0 THEN 'Item 7. | Results  of ' || lang || ' | 31' WHEN 1 THEN '12 | 13-15' WHEN 2 THEN ' Item  1A ' || source ELSE 'A || ' || doc_id END"


@query(
    "clean_section_label",
    rf"""WITH l AS (SELECT doc_id, {LABEL} AS l FROM documents),
p AS (SELECT *, list_transform(string_split(l, '|'), lambda x: trim(x)) AS p FROM l),
n AS (SELECT *, coalesce(list_max(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN regexp_full_match(p[i], '\d+(-\d+)?') THEN 0 ELSE i END)), 0) AS n FROM p)
SELECT doc_id, trim(regexp_replace(CASE WHEN contains(l, '|') THEN array_to_string(p[1:n], ' ') ELSE l END, '\s+', ' ', 'g')) AS ingest,
  trim(regexp_replace(CASE WHEN contains(l, '|') THEN array_to_string(list_filter(p[1:greatest(n, 1)], lambda x: x <> ''), ' ') ELSE l END, '\s+', ' ', 'g')) AS answer FROM n""",
)
def _(spark, sf):
    k = F.col("doc_id") % 4
    label = F.when(k == 0, F.concat(F.lit("Item 7. | Results  of "), "lang", F.lit(" | 31"))).when(k == 1, "12 | 13-15").when(k == 2, F.concat(F.lit(" Item  1A "), "source"))
    d = table(spark, sf, "documents").select("doc_id", label.otherwise(F.concat(F.lit("A || "), F.col("doc_id").cast("string"))).alias("l"))
    return d.select("doc_id", t.clean_section_label(F.col("l")).alias("ingest"), t.clean_section_label(F.col("l"), True).alias("answer"))


@query("context_header", "SELECT doc_id, 'Acme (' || upper(source) || ') 10-K | ' || left(text, 200) || chr(10) || text AS content FROM documents")
def _(spark, sf):
    header = t.context_header(F.lit("Acme"), F.upper("source"), F.lit("10-K"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.with_header(header, F.col("text")).alias("content"))


@query(
    "parse_item_heading",
    r"""WITH l AS (SELECT doc_id, 'item ' || (doc_id % 16) || CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ' – ' END || left(split_part(text, chr(10), 1), 220) AS line FROM documents)
SELECT doc_id, upper(regexp_extract(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)\s*[\.\:\-–—]?\s*(.*)$', 1)) AS key, trim(regexp_extract(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)\s*[\.\:\-–—]?\s*(.*)$', 2)) AS title
FROM l WHERE length(line) < 200 AND regexp_matches(line, '(?i)^\s*item\s+(\d{1,2}[ABC]?)\s*[\.\:\-–—]?\s*(.*)$')""",
)
def _(spark, sf):
    line = F.concat(
        F.lit("item "), (F.col("doc_id") % 16).cast("string"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise(""), F.when(F.col("doc_id") % 2 == 0, ". ").otherwise(" – "), F.left(F.substring_index("text", "\n", 1), F.lit(220))
    )
    d = table(spark, sf, "documents").select("doc_id", t.parse_item_heading(line).alias("h")).filter("h IS NOT NULL")
    return d.select("doc_id", "h.key", "h.title")


@query(
    "extract_years",
    r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all('in ' || (1890 + doc_id % 300) || ', ' || (2000 + doc_id % 7) || '-2003 x' || (1990 + doc_id % 5), '\b(?:19|20)\d{2}\b'), lambda y: y::INT))) AS years FROM documents",
)
def _(spark, sf):
    i = F.col("doc_id")
    text = F.concat(F.lit("in "), (1890 + i % 300).cast("string"), F.lit(", "), (2000 + i % 7).cast("string"), F.lit("-2003 x"), (1990 + i % 5).cast("string"))
    return table(spark, sf, "documents").select("doc_id", t.extract_years(text).alias("years"))


@query("normalize_answer")
def _(spark, sf):
    return answers(spark, sf).select("answer_id", t.normalize_answer(F.col("answer")).alias("answer"))


@query(
    "citation_numbers",
    rf"WITH {ANSWERS} SELECT answer_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(answer, '\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]', 1), lambda g: list_transform(regexp_extract_all(g, '\d+'), lambda n: n::INT))))) AS numbers FROM answers",
)
def _(spark, sf):
    return answers(spark, sf).select("answer_id", t.citation_numbers(F.col("answer")).alias("numbers"))


@query("is_refusal", f"WITH {ANSWERS} SELECT answer_id, starts_with(regexp_replace(lower(answer), '^[^a-z]+|[^a-z]+$', '', 'g'), '{t.REFUSAL_START}') AS refused FROM answers")
def _(spark, sf):
    return answers(spark, sf).select("answer_id", t.is_refusal(F.col("answer")).alias("refused"))


RAW = "CASE conv_id % 5 WHEN 0 THEN 'Supported.' WHEN 1 THEN 'not  supported' WHEN 2 THEN 'UNSUPPORTED' WHEN 3 THEN answer ELSE NULL END"


@query(
    "parse_verdict",
    rf"""WITH {ANSWERS}, r AS (SELECT answer_id, upper(coalesce({RAW}, '')) AS r FROM answers)
SELECT answer_id, CASE WHEN contains(r, 'UNSUPPORTED') OR regexp_matches(r, '\bNOT\s+SUPPORTED\b') THEN 'UNSUPPORTED' WHEN contains(r, 'SUPPORTED') THEN 'SUPPORTED' END AS verdict FROM r""",
)
def _(spark, sf):
    return answers(spark, sf).select("answer_id", t.parse_verdict(F.expr(RAW)).alias("verdict"))


@query("build_preview")
def _(spark, sf):
    return answers(spark, sf).select("answer_id", t.build_preview(F.col("answer"), F.concat(F.lit("Acme (SRC) 10-K | x\n"), "question", F.lit(" 1,234.5 "), "question")).alias("preview"))


@query(
    "parse_completion",
    f"""WITH {ANSWERS}, a AS (SELECT *, conv_id % 5 AS k FROM answers) SELECT answer_id, CASE WHEN k = 3 THEN '' ELSE coalesce(answer, '') END AS content,
  CASE WHEN k = 1 THEN coalesce(length(question), 0) ELSE 0 END::INT AS reasoning_chars, CASE k WHEN 3 THEN NULL WHEN 2 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN k <> 3 THEN length(question) END AS prompt_tokens, CASE WHEN k <> 3 THEN length(answer) END AS completion_tokens, CASE WHEN k <> 3 THEN length(answer) / 1000 END AS cost,
  NULL::DOUBLE AS balance, CASE WHEN k = 3 THEN 'malformed completion' END AS error FROM a""",
)
def _(spark, sf):
    k = F.col("conv_id") % 5
    message = F.struct(F.col("answer").alias("content"), F.when(k == 1, F.col("question")).alias("reasoning_content"))
    body = F.struct(
        F.array(F.struct(message.alias("message"), F.when(k == 2, "length").otherwise("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.length("question").alias("prompt_tokens"), F.length("answer").alias("completion_tokens")).alias("usage"),
        (F.length("answer") / 1000).alias("cost_bdt"),
    )
    raw = F.when(k == 3, F.lit("{broken")).otherwise(F.to_json(body))
    return answers(spark, sf).select("answer_id", t.parse_completion(raw).alias("c")).select("answer_id", "c.*")


@query(
    "filing_url",
    """SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(o_orderdate::DATE::VARCHAR, '-', '') || '/' || o_orderkey || '.htm' AS url,
  'https://data.sec.gov/submissions/CIK' || lpad(o_custkey::VARCHAR, 10, '0') || '.json' AS lookup FROM orders""",
)
def _(spark, sf):
    url = t.filing_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.col("o_orderdate").cast("date").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".htm")))
    return table(spark, sf, "orders").select("o_orderkey", url.alias("url"), t.lookup_url(F.col("o_custkey")).alias("lookup"))
