"""Token ids in binary files, compressed by Re-Pair grammars (operator 6).

Documents are range-sorted by id and tokenised; each document ends with an end id. A task cuts its run of
documents into shards of about SHARD ids and compresses each shard by a grammar: pairs of neighbouring ids are
replaced by new symbols, the most frequent ones first, until no pair is left that occurs LEAST times, which is where a
rule costs more bytes than it saves. The pairs of a round are those about an eighth as frequent as the most frequent one or more;
where they overlap, the more frequent one wins, and counts are taken anew after each round.

File format: Parquet, written and read by Spark, so it may lie in any store. A row is a shard:

* part, shard: place in the order of documents; doc_ids, lengths: its documents and their numbers of ids;
* base: the first symbol that is not an id; rules: pairs of unsigned 32-bit integers, little-endian, rule
  k standing for symbol base + k and made of smaller symbols only;
* expansions: for each rule the number of ids it stands for (unsigned 32-bit);
* width, symbols: the compressed sequence, in 2 or 4 bytes a symbol.

``decode_range`` finds the symbols that cover any range of ids from the running sum of expansion lengths
and expands those only.

A null text counts as empty and has the end id alone. Null ids come first; repeated rows are documents of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeqa.llm.common import new_path, read

#: Ids of a shard, about; occurrences that a pair needs: a rule takes 12 bytes and saves 2 or 4 at each.
SHARD, LEAST = 1 << 17, 12
#: Units whose ids a worker keeps.
CACHE = 300_000
#: Bytes of text that are worked on together.
STRETCH = 8 << 20
END = 2
FORMAT = "part int, shard int, doc_ids array<long>, lengths array<long>, base long, rules binary, expansions binary, width int, symbols binary"

#: Letters that lower-casing and composition treat one by one, then marks that the splitting pattern keeps apart from letters.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:;=?@\[-`{}~]*)$"
STEM = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How the byte-level alphabet writes the letters beyond ASCII that STEM has: a letter for each of their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class Words:
    """Ids of texts by the tokenizers library. White space always ends a token, so words are encoded apart.

    A word of plain letters is cut into its letters in lower case and the marks behind them, which are encoded apart too:
    these and all other words are the units whose ids are kept. Units of letters go through the library's model many at a
    time, without its splitting and normalising, which leave them as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that end a unit
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.place: dict[str, int] = {"": 0}
        self.ids, self.begins, self.lengths = np.empty(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of letters, in a row, and how many each has: cut where a unit ends."""
        joined = " ".join(stems)
        ids = np.array(self.bare.encode_batch_fast([joined if joined.isascii() else joined.translate(self.letters)], add_special_tokens=False)[0].ids, np.uint32)
        lengths = np.diff(np.append(0, np.flatnonzero(self.ends[ids]) + 1))
        if len(lengths) == len(stems):
            return ids, lengths
        found = self._library(stems)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _learn(self, units: list[str]) -> None:
        """Put new units behind those that are known."""
        stems, odd = [], []
        for u in units:
            (stems if STEM.fullmatch(u) else odd).append(u)
        parts, lengths = [self.ids], [self.lengths.astype(np.int64)]
        if stems:
            ids, many = self._stems(stems)
            parts.append(ids)
            lengths.append(many)
        if odd:
            found = self._library(odd)
            parts += found
            lengths.append(np.array([len(x) for x in found], np.int64))
        self.ids, self.lengths = np.concatenate(parts), np.concatenate(lengths).astype(np.int32)
        self.begins = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        n = len(self.place)
        self.place.update(zip(stems, range(n, n + len(stems)), strict=True))
        self.place.update(zip(odd, range(n + len(stems), n + len(units)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends. Each distinct word is looked up once."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy()
        found = pc.extract_regex(words, PLAIN)
        stems, tails = pc.utf8_lower(pc.struct_field(found, "stem")), pc.fill_null(pc.struct_field(found, "tail"), "")
        units = pa.concat_arrays([pc.coalesce(stems, words), tails]).dictionary_encode()
        if len(self.place) > CACHE:  # begin anew: the frequent ones are soon back
            self.place = {"": 0}
            self.ids, self.begins, self.lengths = self.ids[:0], self.begins[:1], self.lengths[:1]
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.place.get, names))
        new = [u for u, i in zip(names, at, strict=True) if i is None]
        if new:
            self._learn(new)
            at = list(map(self.place.__getitem__, names))
        # ids of each word: its first unit, then its tail
        pairs = np.array(at, np.int32)[units.indices.to_numpy()].reshape(2, -1).T
        table, _ = _gathered(self.ids, self.begins, self.lengths, pairs.ravel())
        lengths = self.lengths[pairs].sum(1, dtype=np.int32)
        ids, ends = _gathered(table, np.cumsum(lengths, dtype=np.int32) - lengths, lengths, places)
        return ids, np.append(0, ends)[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]


def _gathered(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units in a row, and where each ends. Numbers of ids fit 32 bits: there are fewer than bytes of an Arrow column."""
    many = lengths[units]
    ends = np.cumsum(many, dtype=np.int32)
    at = np.repeat(begins[units] - ends + many, many)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _slots(codes: np.ndarray) -> np.ndarray:
    """A slot of 18 bits for each code."""
    bits = 8 * codes.dtype.itemsize
    kind = codes.dtype.type
    return (codes * kind(0x9E3779B1 if bits == 32 else 0x9E3779B97F4A7C15)) >> kind(bits - 18)


def _frequent(codes: np.ndarray, slots: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a round, rising, and their ranks by frequency: those that occur at least an eighth as often as the
    fullest slot counts, or the most frequent of the others, and least times. Slots leave out most places before the sort."""
    full = np.bincount(slots, minlength=1 << 18)
    bound = max(least, int(full.max()) // 8)
    while True:
        pairs = np.sort(codes[full[slots] >= bound])
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]]))
        counts = np.diff(np.append(starts, len(pairs)))
        often = np.flatnonzero(counts >= bound)
        if len(often) or bound == least:
            rank = np.empty(len(often), np.int64)
            rank[np.argsort(-counts[often], kind="stable")] = np.arange(len(often))
            return pairs[starts[often]], rank
        bound = max(least, bound // 8)


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (k x 2) of a sequence of ids below base, in which no pair occurs least times."""
    s, rules, n, kind, half = ids.astype(np.uint32), [], 0, np.uint32, 16
    while len(s) >= 2:
        if base + n + len(s) // least >= 1 << 16:  # new symbols may take more than two bytes from now on
            kind, half = np.uint64, 32
        codes = (s[:-1].astype(kind) << kind(half)) | s[1:].astype(kind)
        slots = _slots(codes)
        chosen, order = _frequent(codes, slots, least)
        if not len(chosen):
            break
        table = np.zeros(1 << 18, bool)
        table[_slots(chosen)] = True
        places = np.flatnonzero(table[slots])
        at = np.minimum(np.searchsorted(chosen, codes[places]), len(chosen) - 1)
        right = chosen[at] == codes[places]
        places, rank = places[right], order[at[right]]
        # of chosen pairs that overlap, the more frequent one; of a run of one pair, every second
        near = np.diff(places) == 1
        lower = np.concatenate([[False], near & (rank[1:] > rank[:-1])])
        higher = np.concatenate([near & (rank[:-1] > rank[1:]), [False]])
        number = np.arange(len(places))
        opens = np.concatenate([[True], ~(near & (rank[1:] == rank[:-1]))])
        free = ~(lower | higher) & ((number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0)
        taken, rank = places[free], rank[free]
        used = np.flatnonzero(np.bincount(rank, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        by_rank = np.empty_like(chosen)
        by_rank[order] = chosen
        s[taken] = base + n + number[rank]
        rules.append(np.stack([by_rank[used] >> kind(half), by_rank[used] & kind((1 << half) - 1)], 1).astype(np.uint32))
        n += len(used)
        left = np.ones(len(s), bool)
        left[taken + 1] = False
        s = s[left]
    return s, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules are made of ids and earlier rules."""
    out = np.zeros(len(rules), np.int64)
    for k, pair in enumerate(rules.tolist()):
        out[k] = sum(1 if x < base else int(out[x - base]) for x in pair)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of a sequence of symbols: every symbol's ids lie in one table, from which the sequence is gathered."""
    left, right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    of_rules = np.arange(base, base + len(rules))
    while (new := of_rules >= base).any():  # a pass for each level of the grammar, over the rules alone
        places = np.cumsum(1 + new) - 1 - new
        out = np.empty(int(places[-1]) + 1 + int(new[-1]), np.int64)
        out[places[~new]] = of_rules[~new]
        out[places[new]], out[places[new] + 1] = left[of_rules[new] - base], right[of_rules[new] - base]
        of_rules = out
    table = np.concatenate([np.arange(base), of_rules]).astype(np.uint32)
    lengths = np.concatenate([np.ones(base, np.int64), expansion_lengths(rules, base)])
    starts = np.concatenate([np.arange(base), base + np.cumsum(lengths[base:]) - lengths[base:]])
    many = lengths[symbols]
    ends = np.cumsum(many)
    return table[np.repeat(starts[symbols] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard, expanding only the symbols that cover them."""
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
    rules, base = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["base"]
    lengths = np.append(np.ones(1, np.int64), np.frombuffer(row["expansions"], "<u4").astype(np.int64))
    ends = np.cumsum(lengths[np.maximum(0, symbols - base + 1)])
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    first = int(ends[a - 1]) if a else 0
    return expand(symbols[a : b + 1], rules, base)[start - first : stop - first]


def _shard(part: int, shard: int, doc_ids: list, chunks: list[bytes], base: int) -> pa.RecordBatch:
    symbols, rules = compress(np.frombuffer(b"".join(chunks), "<u4"), base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    lengths = expansion_lengths(rules, base)
    values = [part, shard, doc_ids, [len(c) // 4 for c in chunks], base, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), width, symbols.astype(f"<u{width}").tobytes()]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in FORMAT.split(", ")])


def write_ids(df: DataFrame, path: str, tokenizer: str | None = None, end: int = END, base: int = 49_408, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the ids of df's texts, in order of the ids, as files under path. base: above all ids of the vocabulary."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, size, doc_ids, chunks = TaskContext.get().partitionId(), 0, 0, [], []
        encode = words(tokenizer).encode
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("id").to_pylist()
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:  # some megabytes at a time
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), STRETCH, "right")))
                ids, ends = encode(texts.slice(at, n))
                before = 0
                for key, end_at in zip(keys[at : at + n], ends.tolist(), strict=True):
                    doc_ids.append(key)
                    chunks.append(ids[before:end_at].tobytes() + tail)
                    size, before = size + end_at - before + 1, end_at
                    if size >= SHARD:
                        yield _shard(part, shard, doc_ids, chunks, base)
                        shard, size, doc_ids, chunks = shard + 1, 0, [], []
                at += n
        if doc_ids:
            yield _shard(part, shard, doc_ids, chunks, base)

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # the hash parts rows of one id, so that no id is too large for a task
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(run, FORMAT).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(FORMAT).parquet(path)
    n_ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = shards.select("part", "shard", n_ids.alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each task that wrote
    offset, starts = 0, []
    for r in sorted(parts):
        starts.append((r["part"], offset))
        offset += r["n"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", "shard", before.alias("inside")).join(F.broadcast(spark.createDataFrame(starts, "part int, first long")), "part")
    starts = starts.select("part", "shard", (F.col("first") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["symbols"], f"<u{row['width']}"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["base"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                places = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(places, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(places, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    spread = shards.repartition("part", "shard")  # small compressed rows; a file may hold many shards
    docs = spread.mapInArrow(run, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(starts) if _few(spark, starts) else starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _few(spark: SparkSession, starts: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of shards is small enough to broadcast; above that the join is by part and shard."""
    return starts.limit(most + 1).count() <= most


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
