"""Line dedup over levelled sorted runs (operator 11), with DataFrame functions only.

A line's key is the line without white space at both ends, A-Z in lower case; keys of at least ``LEAST`` code points count.
The first holder of a key, the document with the smallest id, keeps its lines; lines of all others with that key go.

What is known of the lines of earlier documents lies in runs: tables of (hash, holder), a row a key, dealt to buckets
by the hash and sorted by it. A run has a level. For each batch of documents, in order of their ids,

1. the batch's lines are reduced to (hash, smallest id) before they are shuffled, so a line that a third of all
   documents has is a row a task;
2. what is left is merged with the runs by anti joins. Runs are bucketed tables, so neither they nor the batch are
   shuffled again; keys that no run has are the batch's own run, of level 0;
3. where a level has ``fanout`` runs, they are merged into one of the level above, bucket by bucket, without a shuffle.

So a batch reads as many runs as ``fanout`` times the logarithm of the batches, and a key is written once a level. At
the end, a line goes if no run has its hash together with its own document: an anti join on both, which no common line
makes uneven. Positions of lines that go, and nothing else, are joined to the texts; a text is put together of the slices
between them.

A batch that is added again finds its own keys and changes nothing, so a failed batch is simply run again; runs that were
merged already and not yet deleted do no harm. Hashes are the first 16 bytes of SHA-256.

A null or empty text has one empty line. Rows of one id are one document, each with its own text; null ids together are
the last document. Lines repeated inside the first holder stay. An empty table gives an empty result. Other columns pass
through; one named like an output is replaced. Ids that are no numbers make one batch of all documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lakeqa.llm.common import Tables, clear_of, delete, new_path, read, text_of

#: Code points of the shortest key that counts.
LEAST = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUTS = ("n_lines", "n_dropped", "clean_text")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is the same and much faster where all characters are ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class Runs:
    """Levelled sorted runs of (hash, holder) under a path, kept from one session to the next."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[str, str] = {}

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folders(self) -> list[tuple[int, int, str]]:
        """(level, serial, folder) of the runs that are complete, oldest first."""
        fs, at = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [name for name in found if name.startswith("run-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))]
        return sorted((int(level), int(serial), name) for name in done for _, level, serial, _, _ in [name.split("-")])

    def table(self, folder: str, holder: str) -> DataFrame:
        """A run as a bucketed table; the folder's name says of how many buckets."""
        if folder not in self.names:
            self.names[folder] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.names[folder]} (hash BINARY, holder {holder}) USING parquet "
                f"CLUSTERED BY (hash) SORTED BY (hash) INTO {folder.split('-')[3]} BUCKETS LOCATION '{self.path}/{folder}'"
            )
        return self.spark.table(self.names[folder])

    def _write(self, keys: DataFrame, level: int, serial: int) -> None:
        folder = f"run-{level}-{serial}-{self.buckets}-{uuid.uuid4().hex[:8]}"
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.path}/{folder}").format("parquet").saveAsTable(name)
        self.names[folder] = name

    def add(self, lines: DataFrame) -> None:
        """Record the lines (hash, holder) of a batch: keys that no run has make a run of their own, then full levels are merged."""
        kind, known = dict(lines.dtypes)["holder"], self.folders()
        keys = lines.groupBy("hash").agg(F.min("holder").alias("holder"))
        fresh = reduce(lambda left, run: left.join(self.table(run[2], kind).select("hash"), "hash", "left_anti"), known, keys)
        self._write(fresh, 0, 1 + max((serial for _, serial, _ in known), default=0))
        self._merge(kind)

    def _merge(self, kind: str) -> None:
        level = 0
        while known := self.folders():
            full = [run for run in known if run[0] == level]
            if len(full) >= self.fanout:
                rows = reduce(DataFrame.unionByName, [self.table(name, kind) for *_, name in full])
                self._write(rows.groupBy("hash").agg(F.min("holder").alias("holder")), level + 1, full[-1][1])
                for *_, name in full:
                    self._forget(name)
                    delete(self.spark, f"{self.path}/{name}")
            elif level >= max(run[0] for run in known):
                return
            level += 1

    def holders(self, kind: str) -> DataFrame:
        """All runs together: hash, holder."""
        return reduce(DataFrame.unionByName, [self.table(name, kind) for *_, name in self.folders()])

    def _forget(self, folder: str) -> None:
        if folder in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(folder)}")

    def close(self) -> None:
        """Take the tables' names out of the session; the files stay."""
        for folder in list(self.names):
            self._forget(folder)


def _batch_of(docs: DataFrame, id_column: str, batches: int) -> Column:
    """Number of a row's batch: ranges of ids with about as many rows each, null ids last."""
    if batches < 2 or not isinstance(docs.schema[id_column].dataType, NumericType):
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx(id_column, [i / batches for i in range(1, batches)], 1000)).head()[0] or []
    number = sum(((F.col(id_column) > F.lit(cut)).cast("int") for cut in sorted(set(cuts))), F.lit(0))
    return F.when(F.col(id_column).isNull(), len(set(cuts))).otherwise(number)


def drop_lines(
    docs: DataFrame, batches: int = 8, fanout: int = 4, least: int = LEAST, text: str = "text", id_column: str = "doc_id", path: str | None = None
) -> DataFrame:
    """docs with n_lines, n_dropped and clean_text: lines go whose key an earlier document has.

    path: where the runs lie and stay, so that a later call drops what the documents of this one have; documents recorded
    there before come first, whatever their ids. Without it the runs last as long as the call.
    """
    spark, h = docs.sparkSession, clear_of(docs)
    rows = docs.withColumns({h + "text": text_of(text), h + "id": F.col(id_column)})
    rows = rows.withColumns({h + "row": F.xxhash64(h + "text"), h + "batch": _batch_of(rows, h + "id", batches)})
    with Tables(spark) as tables:
        lines = rows.select(h + "batch", F.col(h + "id").alias("holder"), F.col(h + "row").alias("row"), F.posexplode(F.split(h + "text", "\n", -1)).alias("at", "line"))
        lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least)
        lines = lines.select(F.col(h + "batch").alias("batch"), "holder", "row", "at", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash"))
        lines.write.partitionBy("batch").parquet(f"{tables.path}/lines")
        lines = spark.read.schema(lines.schema).parquet(f"{tables.path}/lines")
        kind, runs = dict(lines.dtypes)["holder"], Runs(spark, path or f"{tables.path}/runs", fanout)
        try:
            for batch in range(batches):
                runs.add(lines.filter(F.col("batch") == batch).select("hash", "holder"))
            first = runs.holders(kind).select(F.col("hash").alias("known"), F.col("holder").alias("first"))
            gone = lines.join(first, (F.col("hash") == F.col("known")) & F.col("holder").eqNullSafe(F.col("first")), "left_anti")
            gone = gone.groupBy(F.col("holder").alias(h + "holder"), F.col("row").alias(h + "hash")).agg(F.array_sort(F.collect_set("at")).alias(h + "gone"))
            gone = tables.result(gone)
        finally:
            runs.close()
    rows = rows.join(gone, rows[h + "id"].eqNullSafe(gone[h + "holder"]) & (rows[h + "row"] == gone[h + "hash"]), "left")
    rows = rows.withColumn(h + "lines", F.split(h + "text", "\n", -1)).withColumn(h + "n", F.coalesce(F.size(h + "gone"), F.lit(0)))
    edges = F.concat(F.array(F.lit(-1)), F.col(h + "gone"), F.array(F.size(h + "lines")))
    between = F.transform(F.sequence(F.lit(1), F.col(h + "n") + 1), lambda i: F.slice(h + "lines", F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
    clean = F.when(F.col(h + "n") == 0, F.col(h + "text")).otherwise(F.array_join(F.flatten(between), "\n"))
    outputs = {"n_lines": F.size(h + "lines").cast("long"), "n_dropped": F.col(h + "n").cast("long"), "clean_text": clean}
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUTS]
    return rows.select(*others, *(value.alias(name) for name, value in outputs.items()))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
