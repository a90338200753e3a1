"""URL filters (operator 3), with DataFrame functions only.

Explicit rules come first: a rule (host, path, verdict) fits its host and all subdomains where the
url's path starts with the rule's, and the longest rule that fits wins. All other urls are judged by a
logistic regression on hashed character n-grams of host and path, trained from a small labelled table.

The labelled table (at most ``max_labelled`` rows, an error beyond) is turned into features by Spark
and collected; a few thousand steps of gradient descent fit the weights, which become one array in the
plan. Scoring is a plain projection without a shuffle.

A null url, or one without ``://``, has an empty host and path; such urls have no n-grams, get the
prior and are allowed. Repeated rows give repeated rows, an empty table an empty one; other columns pass
through, except those with the name of an output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeqa.llm.common import clear_of, read

#: Rules: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Buckets of the hash; n-gram lengths.
BUCKETS, SIZES = 4096, (3, 4, 5)

#: Labelled hosts and paths, made up for this purpose without a look at any page: unwanted ones, then wanted ones.
UNWANTED = """cheap-meds.store/order best-pills.biz/discount pills-online.info/cheap discount-pills.shop/buy casino-royal.games/bonus
online-casino.win/slots lucky-casino.bet/play sport-bets.live/free bets-bonus.top/today free-spins.club/odds adult-cams.live/x
x-adult.club/free adult-clips.site/videos link-farm.click/spam seo-spam.biz/farm spam-mails.click/links track-ads.io/click
adserver.click/track ad-tracker.net/pixel track-click.biz/ads ads-pixel.click/track popunder-ads.click/track win-prize.top/free
free-money.win/claim quick-loans.biz/apply payday-loan.club/cheap replica-watch.store/cheap weight-loss-pills.shop/now
hot-singles.club/adult poker-win.bet/casino lottery-win.top/claim crypto-double.win/free cheap-viagra.store/pills
pharma-pills.biz/cheap xxx-adult.site/x slots-casino.win/free bets-win.live/casino link-spam.farm/seo farm-links.top/x
cheap-loans.top/now free-bonus.bet/claim spam-blast.biz/seo farm-clicks.click/ads""".split()
WANTED = """the-times.press/news library.edu/catalogue research.edu/papers weather.gov/forecast museum.art/exhibits history.wiki/article
blog.science.press/post math.edu/notes recipes.kitchen/soup gardening.blog/roses travel.guide/lisbon northern.press/local
thunder.weather.blog/storms theatre.art/programme thread.forum/topic action.blog/entry forum.linux.dev/thread
docs.python.dev/library developer.web.dev/guide news.radio/world school.edu/timetable hospital.health/visit council.gov/minutes
blog.hiking.guide/trail m.theatre.art/tickets www.herald.press/sport thinking.blog/essay thesis.edu/archive nation.press/en
mention.blog/de motherhood.blog/fr together.guide/es weathering.wiki/en authentic.kitchen/es method.edu/papers health.gov/advice
gathering.guide/events another.press/local earth.museum/halls fraction.edu/math station.travel/lines heritage.museum/visit
mountain.guide/huts orchestra.art/season veterinary.health/cats pottery.blog/glazes""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, label (1: unwanted), name. Each name also stands under a neutral domain and path, so that neither decides."""
    rows = []
    for label, urls in ((1, UNWANTED), (0, WANTED)):
        for i, u in enumerate(urls):
            name = u.partition("/")[0].rpartition(".")[0]
            last = name.rpartition(".")[2]
            rows += [(f"https://{u}", label, last), (f"https://{name}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i % 4]}/{37 * i % 999}", label, last)]
    return spark.createDataFrame(rows, "url string, label int, name string")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(mark: str, text: Column, n: int) -> Column:
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # overlapping, in time that grows with the text
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))


def buckets_of(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of ^host$ and of the path."""
    grams = [_grams(mark, text, n) for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)) for n in SIZES]
    return F.when(host == "", F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*grams)))


def train(labelled: DataFrame, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, max_labelled: int = 10_000) -> tuple[list[float], float]:
    """Weights of the buckets and the bias: stochastic gradient descent in a fixed order."""
    rows = labelled.select(F.col("label"), buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("x")).limit(max_labelled + 1).collect()
    if len(rows) > max_labelled:
        raise ValueError(f"over {max_labelled} labelled urls")
    rows = sorted((r for r in rows if r["x"] and r["label"] is not None), key=lambda r: (len(r["x"]), r["x"]))
    weights, bias = [0.0] * BUCKETS, 0.0
    for epoch in range(epochs):
        for k in range(len(rows)):
            r = rows[(k * 7919 + epoch * 104_729) % len(rows)]
            x, share = r["x"], 1 / math.sqrt(len(r["x"]))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + share * sum(weights[i] for i in x)))))
            step = rate * (r["label"] - p) / (1 + epoch / 10)
            bias += 0.1 * step
            for i in x:
                weights[i] += share * step - decay * weights[i]
    return weights, bias


def _ruled(df: DataFrame, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict, or null: an array of the rules, longest first, is asked in the row."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[1]), r[1]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    known = F.array(*(F.struct(F.lit(text.partition("/")[0]).alias("host"), F.lit(text[len(text.partition("/")[0]) :]).alias("path"), F.lit(text).alias("text"), F.lit(what).alias("what")) for what, text in ordered))
    fits = lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"])
    first = F.get(F.filter(known, fits), F.lit(0))
    return first["text"], first["what"]


def judge(df: DataFrame, model: tuple[list[float], float], rules: tuple = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, score (chance that the url is unwanted) and verdict; columns of these names are replaced, also if one is the url."""
    h = clear_of(df)
    df = df.withColumn(h + "url", F.col(url))
    df = df.drop(*(c for c in df.columns if c.lower() in ("host", "path", "rule", "score", "verdict")))
    df = df.withColumn("host", host_of(F.col(h + "url"))).withColumn("path", path_of(F.col(h + "url"))).drop(h + "url")
    rule, verdict = _ruled(df, rules)
    weights, bias = model
    df = df.withColumn("rule", rule).withColumn(h + "x", buckets_of(F.col("host"), F.col("path")))
    table = F.lit([float(w) for w in weights])
    total = F.aggregate(F.col(h + "x"), F.lit(0.0), lambda s, i: s + F.get(table, i))
    df = df.withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.lit(1), F.size(h + "x")))))))
    learned = F.when((F.size(h + "x") > 0) & (F.col("score") > threshold), "block").otherwise("allow")
    return df.withColumn("verdict", F.coalesce(verdict, learned)).drop(h + "x")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of each url."""
    pages = read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = _ruled(pages, RULES)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


#: The same in SQL.
OP3_RULES_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) AS t(what, rh, rp, text)),
m AS (SELECT p.page_id, arg_max(text, length(text)) AS rule, arg_max(what, length(text)) AS ruled FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, ruled FROM p LEFT JOIN m ON m.page_id = p.page_id
"""


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")
