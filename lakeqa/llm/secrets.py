"""Secret scans over a ledger of blobs (operator 5), with DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its content. The ledger is a table with a row for each
(blob, rule version) already scanned: blob, rule_version, spans. ``record`` adds what a table of documents brings:

1. the documents' names are reduced to distinct blobs, and the pairs of blob and rule version that the ledger has are
   left out: names move, texts do not;
2. texts of the blobs that are left are met once each: those of other blobs are dropped where they stand as long as the
   names left fit ``most`` bytes on every executor, and are dealt by blob beyond, where joined ones are dropped;
3. they are scanned, rule version by rule version, inside the row, and appended to the ledger.

``findings`` joins the ledger back to all documents that hold a blob. The query records the documents in two batches,
those of even ids as an earlier version of the corpus, and looks all of them up in the ledger.

Positions come from splitting: the parts between the matches of a rule and the matches themselves, in
turn, add up to the offsets. So matches are leftmost and do not overlap for each rule; offsets are code
points, ends exclusive.

A null text counts as empty. Repeated rows give repeated rows; null ids are kept; an empty table gives
an empty result. Only the named columns are used, so clashing names of others do no harm.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeqa.llm.common import Tables, new_path, read, text_of

#: Rules in the order in which spans at one place are listed: kind, pattern, group that is measured, its least length.
#: The first three are the base (fixed values); for the runs of access and hex the length stands in the pattern, which
#: finds the same runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "base-1": (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32)),
    "more-1": (
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
        ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
        ("login", r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$-]{4,64}@", 0, 12),
    ),
}
KINDS = [kind for rules in RULES.values() for kind, *_ in rules]
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _ends(lengths: Column) -> Column:
    """Running sums of an array of lengths."""
    add = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
    return F.aggregate(lengths, F.array().cast("array<int>"), add)


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule in a text: array of (start, kind, end)."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # a part and the match behind it make one step, so a step's end is the match's end
    steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
    spans = F.zip_with(
        _ends(steps),
        F.arrays_zip(found.alias("f"), measured.alias("m")),
        lambda end, x: F.struct((end - F.length(x["f"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.length(x["m"]).alias("n")),
    )
    kept = F.transform(F.filter(spans, lambda s: s["n"] >= least), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), kept.cast(SPANS)).otherwise(F.array().cast(SPANS))


def _versions(rules: dict) -> Column:
    return F.explode(F.array(*(F.lit(v) for v in rules))).alias("rule_version")


def unseen(docs: DataFrame, ledger: DataFrame, rules: dict = RULES, text: str = "text") -> DataFrame:
    """Blobs of docs that the ledger lacks under some rule version: blob, seen (the versions that it has; null: none)."""
    names = docs.select(F.sha2(text_of(text), 256).alias("blob")).distinct()
    seen = ledger.filter(F.col("rule_version").isin(*rules)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    return names.join(seen, "blob", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))


def scan(docs: DataFrame, left: DataFrame | None = None, rules: dict = RULES, text: str = "text") -> DataFrame:
    """New rows of the ledger: blob, rule_version, spans, for each blob of docs and rule version that is left (as ``unseen``
    gives them; None: all)."""
    blobs = docs.select(F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("body"))
    if left is None:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    else:
        blobs = blobs.join(left, "blob")
    blobs = blobs.groupBy("blob").agg(F.any_value("body").alias("body"), F.any_value("seen").alias("seen"))
    fresh = lambda v: ~F.coalesce(F.array_contains("seen", v), F.lit(False))
    found = [
        F.when(fresh(v), F.struct(F.lit(v).alias("rule_version"), reduce(F.concat, [spans_of(F.col("body"), *rule) for rule in rules[v]]).alias("spans")))
        for v in rules
    ]
    rows = blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("row"))
    return rows.select("blob", "row.rule_version", "row.spans")


#: Bytes of names of blobs that are sent to every executor at most, at NAME_BYTES each.
MOST = 64 << 20
NAME_BYTES = 200
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the ledger under path."""
    return spark.read.schema(LEDGER).parquet(f"{path}/*")


def record(docs: DataFrame, path: str, rules: dict = RULES, text: str = "text", most: int = MOST) -> int:
    """Scan what the ledger under path lacks and append it, as a batch of its own; how many rows that were."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    batch = f"{path}/{uuid.uuid4().hex}"
    with Tables(spark) as tables:
        left = None
        if known:
            left = tables.cut(unseen(docs, read_ledger(spark, path), rules, text))
            left = F.broadcast(left) if left.count() * NAME_BYTES <= most else left.hint("merge")
        scan(docs, left, rules, text).write.parquet(batch)
    return spark.read.schema(LEDGER).parquet(batch).count()


def findings(docs: DataFrame, ledger: DataFrame, rules: dict = RULES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each row of docs with the spans of all rule versions, in order: the id column, blob, spans. An id column named blob or
    spans comes back as id.

    Only blobs with findings are joined; a blob with many copies is a hot key on the side of the documents only,
    which adaptive execution splits.
    """
    known = ledger.filter(F.col("rule_version").isin(*rules) & (F.size("spans") > 0)).groupBy("blob")
    known = known.agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # at most one row for each rule version
    blobs = docs.select(F.col(id_column).alias("_id"), F.sha2(text_of(text), 256).alias("blob"))
    rows = blobs.join(known, "blob", "left").select("_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return rows.withColumnRenamed("_id", id_column) if id_column.lower() not in ("blob", "spans") else rows.select(F.col("_id").alias("id"), "blob", "spans")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """The query. ledger: path of a ledger that is kept for later runs; None is a new one for this run."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path, older = ledger or new_path(spark, "ledger"), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    record(docs.filter(older), path)
    record(docs.filter(~older), path)
    found = findings(docs, read_ledger(spark, path))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
