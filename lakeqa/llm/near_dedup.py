"""Near-duplicates by DartMinHash (operator 10).

A document is the multiset of its five-word shingles, a shingle weighing as often as it occurs (with
``weights="set"`` once). Every element throws hashed darts at a plane of weight and rank: in each dyadic region
of weights they arrive along the rank as a Poisson process that the element's hash alone decides. A document of
total weight W keeps the darts below its elements' weights and below the rank DARTS / W, so about DARTS darts
whatever its length. Each dart hits one of BANDS * ROWS coordinates; the earliest dart of a coordinate is its
entry of the signature (documents with an empty coordinate go on to twice the rank). Two documents agree in a
coordinate with a chance equal to their weighted Jaccard similarity.

Signatures are cut into bands; documents that share a band lie in one bucket. Classes are the connected
components of the links: pairs with a bucket in common whose exact similarity is at least ``similarity``. With
32 bands of 8 rows a pair at 0.8 shares no bucket with a chance of 0.003, a pair at 0.85 of 6e-5.

A bucket is never expanded into its pairs. Documents of equal multisets become one node first, with partial sums
before the shuffle. Then, level by level:

1. each bucket has a leader, its member with the most company in all buckets, and a center, a still better connected
   node near the leader; each member is compared with the leaders and centers of its buckets, whole sets against whole
   sets, and components are made of the links found; from the second level on, the center is the member
   nearest to the center before and there are more leaders, 8, 64 and so on, with whom members of other components are compared, if sizes do not rule it out;
2. a bucket whose members are all in one component is settled, and one that is not larger than its number of leaders;
3. in the others, take two members A and B and the center C. What they have in common outside C is at least what
   a link needs of them, t / (1 + t) * (|A| + |B|), less the smaller of |A & C| and |B & C|. So either they share an
   element outside C, or both overlap so much with C that sizes alone leave the link open. Each member but the leaders
   is dealt to a smaller bucket for each of its first elements outside C (a prefix as long as that bound asks for), and
   to one more if it is of the second kind. These buckets, without those that are settled and but one of those with
   the same members, are the next level.

As the number of leaders grows, levels end after log8 of the largest bucket (three or four as a rule); no pair with a bucket in common is left out. The rows of a level are at most a fifth of the
elements of unsettled members, and mostly their differences from a center. Joins on a hot bucket, center or set have
one side with few rows a key, which adaptive execution splits. Components come from rounds of least labels with
pointer jumping; what is used twice is written to the shared folder and deleted at the end, also after a failure.
Nothing but counts reaches the driver.

A text of one to four words is a single shingle; texts without words (null, empty) are equal to each other
and to no other. Repeated rows are copies; null ids come last. An empty table gives an empty result. Other columns
are not looked at by ``near_groups``, whatever their names, and pass through ``drop_near_copies``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeqa.llm.common import Tables, read
from lakeqa.llm.exact_dedup import keep_rows

WORDS, BANDS, ROWS = 5, 32, 8
#: Darts of a document, about: enough that few documents have an empty coordinate.
DARTS = BANDS * ROWS * (np.log(BANDS * ROWS) + 2)
CACHE = 300_000
#: Leaders of a bucket at the second level; at the third as many times more, and so on.
LEADERS = 8
#: Elements that are worked on together; darts that are thrown together.
BATCH, WIDE = 100_000, 1 << 15

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


class Shingles:
    """Hashed shingles of texts; hashes of words are kept."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self.cache) < CACHE:
            self.cache[word] = h
        return h

    def weighted(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles, rising, and how often each occurs."""
        get, word = self.cache.get, self._word
        ws = text.split()  # bytes split at U+0020 and U+0009 to U+000D
        h = np.fromiter([get(w) or word(w) for w in ws], U, len(ws))
        width = min(WORDS, len(h))
        if not width:
            return h, np.empty(0, np.int64)
        acc = np.full(len(h) - width + 1, width, U)
        for i in range(width):
            acc = acc * U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
        s = np.sort(mix(acc))
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[starts], np.diff(np.append(starts, len(s)))


def numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A multiset as a set, rising: the k-th occurrence of an element is an element of its own."""
    if (weights == 1).all():
        return elements
    nth = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    more = np.repeat(elements, weights)
    return np.sort(np.where(nth == 0, more, mix(more + nth.astype(U) * U(0xD1B54A32D192ED03))))


@functools.lru_cache(maxsize=1)
def shingles() -> Shingles:
    """Those of this worker."""
    return Shingles()


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from 64 bits each."""
    return ((x >> U(11)).astype(float) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = BANDS * ROWS, darts: float = DARTS) -> np.ndarray:
    """Signatures (n x k) of n weighted sets: elements and weights with the number of the set that owns each."""
    out, earliest = np.zeros(n * k, U), np.full(n * k, np.inf)
    total = np.bincount(owner, weights, n)
    todo, reach = np.flatnonzero(total > 0), darts
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
        limits = reach / np.where(total > 0, total, 1.0)
        region = 0
        while len(at := np.flatnonzero(mine & (weights > 2.0**region - 1))):
            low, rate = 2.0**region - 1, 2.0**region
            key = mix(elements[at] ^ mix(np.full(1, region + 1, U)))
            own, limit, weight, rank, step = owner[at], limits[owner[at]], weights[at], np.zeros(len(at)), 0
            while len(key):
                ahead = min(64, max(1, WIDE // len(key)))  # darts of each element that are thrown together
                seed = mix(key[:, None] + np.arange(step + 1, step + 1 + ahead).astype(U) * U(0xA24BAED4963EE407))
                arrival = -np.log(_uniform(seed)) / rate
                arrival[:, 0] += rank
                arrival = np.cumsum(arrival, axis=1)
                inside = arrival < limit[:, None]
                hit = np.flatnonzero(inside)
                thrower, seed, ranks = hit // ahead, seed.ravel()[hit], arrival.ravel()[hit]
                if region or (weight < 1).any():  # else every dart of the region is below its element's weight
                    below = low + rate * _uniform(mix(seed ^ U(0x5851F42D4C957F2D))) < weight[thrower]
                    thrower, seed, ranks = thrower[below], seed[below], ranks[below]
                dart = mix(seed ^ U(0x2545F4914F6CDD1D))
                mark = own[thrower] * k + (dart % U(k)).astype(np.int64)
                first = np.flatnonzero(ranks < earliest[mark])
                mark, dart, ranks = mark[first], dart[first], ranks[first]
                np.minimum.at(earliest, mark, ranks)
                won = earliest[mark] == ranks
                out[mark[won]] = dart[won]
                on = inside[:, -1]
                key, own, limit, weight, rank, step = key[on], own[on], limit[on], weight[on], arrival[on, -1], step + ahead
            region += 1
        todo, reach = todo[~np.isfinite(earliest.reshape(n, k)[todo]).all(1)], 2 * reach
    return out.reshape(n, k)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Band keys (n x BANDS) of signatures; a key has its band's number mixed in."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1).astype(U), (len(signature), BANDS)).copy()
    for i in range(ROWS):
        acc = mix(acc * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return acc.view(np.int64)


def _signed(df: DataFrame, count: bool) -> DataFrame:
    """row, id, text_hash, and of the text: set_id, n_shingles, bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingles().weighted
        for batch in batches:
            texts = batch.column("body").cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                sets, size, begin = [], 0, at
                while at < batch.num_rows and size < BATCH:
                    elements, weights = of(texts[at].as_py())
                    sets.append((elements, weights if count else np.ones(len(elements), np.int64)))
                    size, at = size + len(elements), at + 1
                n = len(sets)
                owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
                keys = bands_of(signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(float), owner, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(begin, n) for c in ("row", "id", "text_hash")),
                        pa.array([hashlib.blake2b(numbered(e, w).tobytes(), digest_size=16).digest() for e, w in sets], pa.binary()),
                        pa.array([int(w.sum()) for _, w in sets], pa.int32()),
                        pa.array([x if len(e) else x[:0] for x, (e, _) in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["row", "id", "text_hash", "set_id", "n_shingles", "bands"],
                )

    return df.mapInArrow(run, "row long, id long, text_hash long, set_id binary, n_shingles int, bands array<long>")


def _sets(df: DataFrame, count: bool) -> DataFrame:
    """node and the elements of its text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingles().weighted
        for batch in batches:
            texts = batch.column("body").cast(pa.binary())
            for at in range(0, batch.num_rows, 500):
                found = (of(t.as_py()) for t in texts.slice(at, 500))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, 500), pa.array([(numbered(e, w) if count else e).tobytes() for e, w in found], pa.binary())], names=["node", "elements"])

    return df.mapInArrow(run, "node long, elements binary")


def compare(a: np.ndarray, leader: np.ndarray, t: float) -> tuple[bool, float, np.ndarray]:
    """Of two sets, rising: whether they are linked; up to which size another set may be linked to a that shares nothing
    with it outside the leader; and the elements of a outside the leader of which all others that are linked share one."""
    inside = leader[np.minimum(np.searchsorted(leader, a), len(leader) - 1)] == a
    common = int(inside.sum())
    linked = common >= t * (len(a) + len(leader) - common) - 1e-9
    outside = a[~inside]
    needed = max(1, int(np.ceil(t * len(a) - common - 1e-9)))  # a partner has t * len(a) elements or more
    return linked, common * (1 + t) / t - len(a) + 1e-6, outside[: max(0, len(outside) - needed + 1)]


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, leader) with linked, reach and outside. The leader may be a hot key: its side is joined last, with one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            found = [compare(np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U), similarity) for i in range(batch.num_rows)]
            linked, reach, outside = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(linked, pa.bool_()), pa.array(reach, pa.float64()), pa.array([e.view(np.int64) for e in outside], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader"), *columns], names=["node", "leader", "linked", "reach", "outside"])

    left = pairs.join(sets.select("node", F.col("elements").alias("x")), "node")
    both = left.join(sets.select(F.col("node").alias("leader"), F.col("elements").alias("y")), "leader")
    return both.select("node", "leader", "x", "y").mapInArrow(run, "node long, leader long, linked boolean, reach double, outside array<long>")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node and label (the least node of its component) for each node of links (a, b)."""
    both = tables.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = tables.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "node").join(hop, "label").select("node", "label", F.least("label", "theirs", "jump").alias("new"))
        new = tables.cut(new)
        if new.filter("new < label").isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("label"))


def _several(rows: DataFrame) -> DataFrame:
    """rows (with key, node and label) of buckets with several components, with size; of buckets with the same members, told
    by 128 bits, one stays."""
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members{i}") for i in (0, 1)]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), *members)
    keys = keys.filter("low < high").groupBy("size", "members0", "members1").agg(F.min("key").alias("key"))
    return rows.join(keys.select("key", "size"), "key")


def _led(buckets: DataFrame, tables: Tables) -> DataFrame:
    """buckets (key, node, n, size) of the first level with the leader and the center of each.

    The leader is the member with the most company in all its buckets. The center is what is found by going twice from a
    leader to the best leader that its own buckets have.
    """
    degrees = buckets.join(buckets.groupBy("node").agg(F.sum("size").alias("degree")), "node")
    leaders = degrees.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"))
    led = tables.cut(buckets.join(leaders, "key"))
    best = tables.cut(led.groupBy("node").agg(F.max("top").alias("best")).select("node", (-F.col("best.minus")).alias("best")))
    again = best.select(F.col("node").alias("best"), F.col("best").alias("center"))
    centers = best.join(again, "best").select(F.col("node").alias("leader"), "center")
    return led.select("key", "node", "n", (-F.col("top.minus")).alias("leader")).join(centers, "leader")


def _headed(buckets: DataFrame, tables: Tables, most: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of buckets (key, node, n, reach, label, size) of a later level: pairs (node, leader) to compare, and the rows that go on.

    A bucket has up to most leaders, those nearest to the center before first; the first is its center. Members in another
    component that sizes do not rule out are compared with all of them, so a bucket not larger than that is done with, and
    leaders leave the others.
    """
    order = Window.partitionBy("key").orderBy(F.desc("reach"), "node")
    heads = buckets.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    heads = tables.cut(heads.select("key", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("label").alias("other"), "place"))
    rows = buckets.filter(F.col("size") > most).join(heads.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti")
    rows = tables.cut(rows.join(heads.filter("place = 1").select("key", F.col("leader").alias("center")), "key").select("key", "node", "n", "center"))
    alike = (F.col("label") != F.col("other")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
    pairs = buckets.join(heads, "key").filter((F.col("node") != F.col("leader")) & alike).select("node", "leader")
    return pairs.union(rows.select("node", "center")).distinct(), rows


def _narrower(led: DataFrame, compared: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets of the next level: key, node, n, reach, label, size. Buckets of one center are worked on together."""
    named = led.select("key", "node", "n", "center").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).filter("low < high").select("key", "least")
    members = named.filter("node <> center").join(mixed, "key").join(compared.withColumnRenamed("leader", "center"), ["node", "center"])
    shared = members.dropDuplicates(["node", "center"]).select("center", "node", "n", "reach", "label", F.explode("outside").alias("element"))
    shared = shared.select(F.xxhash64("center", "element").alias("key"), "node", "n", "reach", "label")
    # members that may be linked to another by what the center has alone; of the center's component those small enough
    close = members.filter("reach >= least").join(labels.select(F.col("node").alias("center"), F.col("label").alias("led_by")), "center", "left")
    own = F.coalesce(F.col("label") == F.col("led_by"), F.lit(False))
    close = close.withColumn("own", own)
    reaches = close.groupBy("key").agg(F.max(F.when(~F.col("own"), F.col("reach"))).alias("most"))
    close = close.join(reaches, "key").filter(~F.col("own") | (F.col("n") <= F.col("most"))).select(F.xxhash64("center", F.lit("size")).alias("key"), "node", "n", "reach", "label").distinct()
    return _several(shared.unionByName(close))


def near_groups(df: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text", weights: str = "count") -> DataFrame:
    """One row for each row of df: its id, class_id, class_size, kept, n_shingles, text_hash.

    class_id is the smallest id of the class; of each class the row with that id stays, of repeated rows one.
    """
    if weights not in ("set", "count"):
        raise ValueError("weights: set or count")
    count = weights == "count"
    with Tables(df.sparkSession) as tables:
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        docs = df.select(F.col(id_column).cast("long").alias("id"), body.alias("body"), F.xxhash64(body).alias("text_hash"))
        signed = tables.cut(_signed(docs.withColumn("row", F.monotonically_increasing_id()), count))

        best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("text_hash").alias("text_hash"))
        nodes = signed.groupBy("set_id").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
        nodes = tables.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
        rows = nodes.select("node", "n", F.explode("bands").alias("key"))
        buckets = tables.cut(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "key"))

        # sets of all nodes in buckets; a text is found by the id and hash of the row that stands for the node
        wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("best.id").alias("id"), F.col("best.text_hash").alias("text_hash"))
        found = wanted.join(docs.withColumnRenamed("id", "own"), (wanted["text_hash"] == docs["text_hash"]) & wanted["id"].eqNullSafe(F.col("own"))).select("node", "body")
        sets = tables.cut(_sets(found.dropDuplicates(["node"]) if _repeats(signed) else found, count))

        links, labels, level = None, df.sparkSession.createDataFrame([], "node long, label long"), 0
        while not buckets.isEmpty():
            if level == 0:
                led = tables.cut(_led(buckets, tables))
                pairs = led.select("node", "leader").union(led.select("node", "center")).filter("node <> leader").distinct()
            else:
                pairs, led = _headed(buckets, tables, LEADERS**level, similarity)
            compared = tables.cut(_compared(pairs, sets, similarity))
            new = compared.filter("linked").select(F.col("node").alias("a"), F.col("leader").alias("b"))
            if not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                labels = components(links, tables)
            buckets, level = tables.cut(_narrower(led, compared, labels)), level + 1

        named = nodes.select("set_id", "node", "best", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        classes = tables.cut(named.groupBy("label").agg(F.min("best").alias("first"), F.sum("copies").alias("class_size")))
        of_set = tables.cut(named.select("set_id", "label").join(classes, "label").select("set_id", "first", "class_size"))
        out = signed.join(of_set, "set_id").select(
            F.col("id").alias(id_column),
            F.col("first.id").alias("class_id"),
            "class_size",
            (F.col("row") == F.col("first.row")).alias("kept"),
            "n_shingles",
            "text_hash",
        )
        return tables.result(out)


def drop_near_copies(df: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each class."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    groups = near_groups(df, similarity, id_column, text)
    return keep_rows(df, groups.filter("kept").select(id_column, "text_hash"), id_column, F.xxhash64(body), F.length(body))


def _repeats(signed: DataFrame) -> bool:
    """Whether some row is there more than once (repeated rows of one id and text)."""
    return not signed.groupBy("id", "text_hash").count().filter("count > 1").isEmpty()


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).drop("text_hash")
