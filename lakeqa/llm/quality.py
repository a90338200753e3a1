"""Line-first cleaning of documents (operator 1), with DataFrame functions only.

Every line is judged on its own by three kinds of rule; lines that fail are removed, and a document
that loses too much of its text is rejected as a whole:

* punctuation: characters of ``#*$%&|<>!?`` are more than ``max_symbol_share`` of the line;
* navigation: a line with at least ``min_separators`` separators (``|``, ``»``, ``›``, ``·``), these
  being at least a fifth of its parts between spaces;
* boilerplate: a line of up to ``MAX_BOILERPLATE`` characters that holds a phrase of BOILERPLATE.

A document is rejected if its base counts fail (under 20 words, or more than 30 % of the words in
repeated 8-word windows), or if the removed lines hold more than ``max_lost`` of its characters.

A null text counts as empty, has no words and fails the base. A repeated row gives a repeated result
row. An empty table gives an empty result. Other columns of the input stay as they are; those that
have the name of an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeqa.llm.common import clear_of, read, text_of, words_of

#: Words of a window, and of a document at least; percentage of words in repeated windows at most.
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Characters of a line that can be boilerplate at most.
MAX_BOILERPLATE = 200

#: Phrases of page furniture, matched in either case.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|notice)|"
    r"(accept|use|uses) (all )?cookies|sign (in|up) (to|for)|log in to|subscribe to|click here|"
    r"skip to (main )?content|back to top|read more|share (this|on)|powered by|enable javascript|"
    r"page not found|lorem ipsum|licensed under the|released under the|work is licensed under)\b"
)
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_share", "clean_text"]


def line_fails(line: Column, max_symbol_share: float = 0.25, min_separators: int = 3) -> Column:
    """Whether a line fails the rule for punctuation, navigation or boilerplate."""
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>!?]")) > F.length(line) * F.lit(max_symbol_share)
    separators = F.regexp_count(line, F.lit("[|»›·]"))
    navigation = (separators >= min_separators) & (5 * separators >= 1 + F.regexp_count(line, F.lit(" +")))
    return symbols | navigation | ((F.length(line) <= MAX_BOILERPLATE) & F.regexp_like(line, F.lit(BOILERPLATE)))


def clean_documents(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """df with OUTPUTS: the counts of whole texts, the verdict and the text without the lines that fail.

    Everything happens inside a row, so there is no shuffle. Windows are compared by 64-bit hashes
    inside one document; only documents in which a window occurs twice sort theirs. All steps are
    linear or n log n in the words of the document.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in OUTPUTS and c.lower() != text.lower()))
    h = clear_of(df)
    of = lambda name: F.col(h + name)
    df = df.withColumn(h + "text", text_of(text)).withColumn(h + "words", words_of(of("text")))
    n_words = F.size(of("words"))
    windows = F.transform(F.sequence(F.lit(1), n_words - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(of("words"), i, WINDOW)))
    df = df.withColumn(h + "windows", F.when(n_words > WINDOW, windows))
    # windows in order of (hash, place); one that equals a neighbour occurs twice or more
    in_order = F.array_sort(F.transform(of("windows"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn(h + "order", F.when(F.size(F.array_distinct(of("windows"))) < F.size(of("windows")), in_order))
    twice = lambda w, i: F.get(of("order"), i - 1)["x"].eqNullSafe(w["x"]) | F.get(of("order"), i + 1)["x"].eqNullSafe(w["x"])
    df = df.withColumn(h + "places", F.array_sort(F.transform(F.filter(of("order"), twice), lambda w: w["i"])))
    # each place covers eight words, or as many as there are up to the next place
    steps = F.zip_with(of("places"), F.slice(of("places"), 2, F.size(of("places"))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0))
    df = df.withColumn(h + "lines", F.split(of("text"), "\n", -1))
    df = df.withColumn(h + "good", F.filter(of("lines"), lambda x: ~line_fails(x)))
    df = df.withColumn(h + "full", F.filter(of("lines"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.withColumns(
        {
            "n_words": n_words.cast("long"),
            "word_chars": F.length(F.array_join(of("words"), "")).cast("long"),
            "n_symbols": F.regexp_count(of("text"), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(of("full")) - F.size(F.array_distinct(of("full")))).cast("long"),
            "n_repeat_words": repeated.cast("long"),
            "n_removed_lines": (F.size(of("lines")) - F.size(of("good"))).cast("long"),
            "clean_text": F.array_join(of("good"), "\n"),
        }
    )
    lost = 1 - F.length("clean_text") / F.greatest(F.lit(1), F.length(of("text")))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    # a filter on the verdict is to stay above these projections: pushed down, it would hold all their expressions many times
    stay = F.monotonically_increasing_id() >= 0
    df = df.withColumn("lost_share", lost).withColumn("kept", stay & ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    return df.drop(*(c for c in df.columns if c.startswith(h)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"
    )


#: The same in SQL: lines and windows as rows.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8),
g AS (SELECT rid, i, md5(array_to_string(words[i:i + 7], ' ')) AS x FROM p),
t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(8, coalesce(following - i, 8))) AS n_repeat_words
      FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM t) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT rid, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled,
        len(regexp_extract_all(line, '[#*$%&|<>!?]')) > length(line) * 0.25
        OR (len(regexp_extract_all(line, '[|»›·]')) >= 3
            AND 5 * len(regexp_extract_all(line, '[|»›·]')) >= 1 + len(regexp_extract_all(line, ' +')))
        OR (length(line) <= 200 AND regexp_matches(line, '{boilerplate}')) AS fails FROM l),
s AS (SELECT rid, count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS n_dup_lines,
        count(*) FILTER (fails) AS n_removed_lines,
        greatest(0, sum(length(line) + 1) FILTER (NOT fails) - 1) AS left_chars FROM f GROUP BY rid),
c AS (SELECT w.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, n_removed_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        1 - coalesce(left_chars, 0) / greatest(1, length(text)) AS lost
      FROM w JOIN s USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= 0.5 AS kept, n_removed_lines::BIGINT AS n_removed_lines FROM b
""".replace("{boilerplate}", BOILERPLATE).replace("\\\\", "\\")
