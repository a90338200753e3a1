"""Which chunks a question may see: tickers, fiscal years, scopes, and checks of requests and filings lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeqa.functions.text import extract_years, strip
from lakeqa.operators.substrings import substring_join


def latest_filings(listing: DataFrame, form: str = "10-K", n: int = 2) -> DataFrame:
    """The first n filings of a form of each company, in the order of the listing. listing: ticker, form, pos, and others."""
    order = Window.partitionBy("ticker").orderBy("pos")
    return listing.filter(F.col("form") == form).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)


def explode_listing(responses: DataFrame) -> DataFrame:
    """Rows of a filing list that came as parallel arrays: ticker, pos, form, accession, filing_date, document."""
    zipped = F.arrays_zip(F.col("form"), F.col("accessionNumber"), F.col("filingDate"), F.col("primaryDocument"))
    rows = responses.select("ticker", F.posexplode(zipped).alias("pos", "f"))
    return rows.select("ticker", "pos", "f.form", F.col("f.accessionNumber").alias("accession"), F.to_date("f.filingDate").alias("filing_date"), F.col("f.primaryDocument").alias("document"))


def validate_requests(requests: DataFrame, tickers: list[str], shortest: int = 3, longest: int = 1000) -> DataFrame:
    """requests with a trimmed question, an upper-case ticker (blank: null) and the reason why it is refused, or null."""
    rows = requests.withColumn("question", strip(F.col("question"))).withColumn("ticker", F.nullif(F.upper(strip(F.col("ticker"))), F.lit("")))
    length = F.length(F.coalesce("question", F.lit("")))
    reason = F.when(length < shortest, "question too short").when(length > longest, "question too long").when(F.col("ticker").isNotNull() & ~F.col("ticker").isin(tickers), "unknown ticker")
    return rows.withColumn("reason", reason)


def filter_scope(chunks: DataFrame, ticker: str | None = None, dates: list | None = None) -> DataFrame:
    """Chunks of a ticker and of some filing dates; what is absent does not restrict."""
    rows = chunks if not ticker else chunks.filter(F.col("ticker") == ticker.upper())
    return rows if not dates else rows.filter(F.col("filing_date").isin(dates))


def find_text(chunks: DataFrame, phrases: DataFrame, limit: int = 10, around: int = 150) -> DataFrame:
    """phrase_id, total, rank, filing_date, chunk_id, snippet: chunks of a ticker that hold a phrase in any case, newest filing first.

    phrases: phrase_id, ticker, phrase, filing_date (null: any). Chunks are found by q-grams in lower case; snippets are cut
    from those only. The total is summed apart, so the window keeps limit rows a task.
    """
    asked = phrases.select("phrase_id", F.col("ticker").alias("of"), F.col("filing_date").alias("only"), F.lower("phrase").alias("needle"))
    fits = (F.col("of") == F.col("ticker")) & (F.col("only").isNull() | (F.col("only") == F.col("filing_date")))
    lowered = chunks.withColumn("lowered", F.lower("content"))
    rows = substring_join(asked, lowered, "lowered", ("ticker", "filing_date"), fits, ("content",))
    rows = rows.withColumn("pos", F.expr("instr(lower(content), needle)"))
    begin = F.greatest(F.lit(1), F.col("pos") - around)
    snippet = F.translate(F.substr("content", begin, F.col("pos") - begin + F.length("needle") + around), "\n", " ")
    found = rows.select("phrase_id", "filing_date", "chunk_id", snippet.alias("snippet"))
    order = Window.partitionBy("phrase_id").orderBy(F.desc("filing_date"), F.asc("chunk_id"))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(found.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("total")), "phrase_id")


def chunks_with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the columns of their documents."""
    return chunks.join(docs, "document_id")


def cell_of(ticker: str, filing_date: str) -> Column:
    """The cell of a chunk: a 64-bit number for its ticker and filing date, either of which may be null."""
    return F.xxhash64(F.struct(F.col(ticker), F.col(filing_date).isNull(), F.col(filing_date)), F.col(ticker).isNull())


def cell_dictionary(chunks: DataFrame) -> DataFrame:
    """cell, ticker, filing_date: a row for each filing that chunks come from."""
    return chunks.select("ticker", "filing_date").distinct().select(cell_of("ticker", "filing_date").alias("cell"), "ticker", "filing_date")


def cells_of(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query_id, cells: the cells that each query's ticker and dates allow; null for a query without any restriction.

    queries: query_id, ticker, dates (null: any). Queries meet cells, of which there is one for each filing, never chunks.
    Each kind of restriction is an equi-join of its own.
    """
    q = queries.select("query_id", "ticker", "dates").withColumn("date", F.explode_outer(F.array_distinct("dates")))
    dated = F.col("dates").isNotNull()
    c = dictionary.select("cell", F.col("ticker").alias("own"), F.col("filing_date").alias("filed"))
    both = q.filter(dated & F.col("ticker").isNotNull()).join(c, (F.col("ticker") == F.col("own")) & (F.col("date") == F.col("filed")))
    ticker = q.filter(~dated & F.col("ticker").isNotNull()).join(c, F.col("ticker") == F.col("own"))
    date = q.filter(dated & F.col("ticker").isNull()).join(c, F.col("date") == F.col("filed"))
    found = both.unionByName(ticker).unionByName(date).groupBy("query_id").agg(F.collect_set("cell").alias("found"))
    free = F.col("ticker").isNull() & F.col("dates").isNull()
    rows = queries.select("query_id", "ticker", "dates").join(found, "query_id", "left")
    return rows.select("query_id", F.when(~free, F.coalesce("found", F.array().cast("array<bigint>"))).alias("cells"))


def scope_join(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id for the chunks that each query's ticker and dates allow; null allows all.

    A table of all pairs, for those who want one; ``bm25_topk`` and ``dense_topk`` take the cells of queries instead.
    Queries are joined with the dictionary of cells, those without a restriction to all of it, and cells with chunks.
    """
    dictionary = cell_dictionary(chunks)
    cells = cells_of(queries, dictionary)
    free = cells.filter("cells IS NULL").select("query_id", F.lit(True).alias("free")).join(dictionary.select("cell", F.lit(True).alias("free")), "free")
    asked = cells.select("query_id", F.explode("cells").alias("cell")).unionByName(free.select("query_id", "cell"))
    return asked.join(chunks.select(cell_of("ticker", "filing_date").alias("cell"), "chunk_id"), "cell").select("query_id", "chunk_id")


def resolve_filing_dates(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """queries with dates: of the fiscal years that the question names, else all if it names others, else the newest; null without filings.

    queries: query_id, question, ticker. registry: ticker, fiscal_year, filing_date.
    """
    known = registry.groupBy(F.upper("ticker").alias("upper")).agg(F.collect_list(F.struct("fiscal_year", "filing_date")).alias("filings"))
    rows = queries.withColumn("upper", F.upper("ticker")).withColumn("years", extract_years(F.coalesce("question", F.lit("")))).join(known, "upper", "left")
    date = lambda xs: F.sort_array(F.array_distinct(F.transform(xs, lambda f: f["filing_date"])), False)
    matched = date(F.filter("filings", lambda f: F.array_contains("years", f["fiscal_year"])))
    every = F.sort_array(F.transform("filings", lambda f: f["filing_date"]), False)
    dates = F.when(F.col("filings").isNull(), None).when(F.size(matched) > 0, matched).when(F.size("years") > 0, every).otherwise(F.slice(every, 1, 1))
    return rows.withColumn("dates", dates).drop("upper", "years", "filings")


def detect_ticker(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, ticker, status (single, zero, multiple) by whole-word aliases. queries: query_id, question; aliases: ticker, alias.

    An alias is looked for in questions that have its first run of letters and digits: a join on that word, whatever the
    number of aliases.
    """
    text = F.lower(F.coalesce("question", F.lit("")))
    alias = F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower("alias"), F.lit("\\E(?![a-z0-9])"))
    words = F.array_distinct(F.array_append(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), F.lit("")))
    asked = queries.select("query_id", "question", F.explode(words).alias("word"))
    known = aliases.select("ticker", "alias", F.regexp_extract(F.lower("alias"), "[a-z0-9]+", 0).alias("word"))
    hits = asked.join(known, "word").filter(F.regexp_like(text, alias)).groupBy("query_id").agg(F.collect_set("ticker").alias("found"))
    rows = queries.select("query_id").join(hits, "query_id", "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    status = F.when(n == 1, "single").when(n > 1, "multiple").otherwise("zero")
    return rows.select("query_id", F.when(n == 1, F.get("found", F.lit(0))).alias("ticker"), status.alias("status"))


def resolve_ticker(requests: DataFrame, detections: DataFrame) -> DataFrame:
    """query_id, ticker, ticker_source: the request's ticker (request), else the only one detected (detected), else none."""
    rows = requests.select("query_id", F.col("ticker").alias("asked")).join(detections.select("query_id", "ticker"), "query_id", "left")
    source = F.when(F.col("asked").isNotNull(), "request").when(F.col("ticker").isNotNull(), "detected").otherwise("none")
    return rows.select("query_id", F.coalesce("asked", "ticker").alias("ticker"), source.alias("ticker_source"))


def ticker_cik_join(tickers: DataFrame, lookup: DataFrame) -> DataFrame:
    """tickers with cik (ten digits) and found; tickers that the lookup lacks stay, to be reported."""
    rows = tickers.join(lookup.select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")), "ticker", "left")
    return rows.withColumn("found", F.col("cik").isNotNull())
