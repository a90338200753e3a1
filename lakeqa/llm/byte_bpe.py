"""Byte-level BPE encoding and decoding (operator 4).

A text is split by a pattern; each piece is merged on its own. Merging keeps a segment tree over the
byte positions of the piece: a leaf holds the rank of the pair that starts at its position, an inner
node the leftmost smallest rank below it. A merge takes the root's pair, joins it with its live right
neighbour and updates two leaves, each in logarithmic time; so a piece of n bytes takes O(n log n),
however long it is.

Documents are independent: there is no shuffle. Pieces repeat, so every worker keeps the results of up
to CACHE pieces (further ones are merged each time). Ids are kept as little-endian unsigned 32-bit
integers. Decoding reads nothing but those ids.

A null text counts as empty and has no ids. Repeated rows, null ids and other columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeqa.llm.common import read

CACHE = 300_000
NONE = 2**31 - 1


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece. Every single byte is to have a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    ends, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here: its end, its left neighbour
    tree = [NONE] * (2 * width)
    tree[width : width + n - 1] = [ranks.get(piece[i : i + 2], NONE) for i in range(n - 1)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(place: int, rank: int) -> None:
        i = place + width
        tree[i] = rank
        while i > 1:
            i //= 2
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    while (least := tree[1]) < NONE:
        i = 1
        while i < width:  # down to the leftmost leaf with the smallest rank
            i = 2 * i if tree[2 * i] == least else 2 * i + 1
        at = i - width
        gone = ends[at]  # the right neighbour starts here
        end = ends[gone]
        ends[at] = end
        if end < n:
            left[end] = at
        put(gone, NONE)
        put(at, ranks.get(piece[at : ends[end]], NONE) if end < n else NONE)
        if (before := left[at]) >= 0:
            put(before, ranks.get(piece[before:end], NONE))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks, self.pieces, self.cache = load_ranks(path), regex.compile(pattern), {}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def _packed(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(self.cache) < CACHE and len(piece) < 100:
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, packed = self.cache.get, self._packed
        return b"".join([get(p) or packed(p) for p in self.pieces.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def vocabulary() -> tuple[str, str]:
    """Path of the default ranks, and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _rows(batches: Iterator[pa.RecordBatch], text: str, names: list[str], types: list[pa.DataType], row) -> Iterator[pa.RecordBatch]:
    """Batches with a column for each value of row(text)."""
    for batch in batches:
        values = [row(t.as_py() or "") for t in batch.column(text)]
        columns = [pa.array(x, t) for x, t in zip(zip(*values, strict=True), types, strict=True)] if values else [pa.array([], t) for t in types]
        kept = [i for i, f in enumerate(batch.schema) if f.name != text and f.name.lower() not in names]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*(batch.schema.names[i] for i in kept), *names])


def _schema(df: DataFrame, text: str, more: list[T.StructField]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != text and f.name.lower() not in {m.name for m in more}] + more)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df without the text, with ids (binary) and n_tokens."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        yield from _rows(batches, text, ["ids", "n_tokens"], [pa.binary(), pa.int64()], lambda t: (x := c.encode(t), len(x) // 4))

    return df.mapInArrow(run, _schema(df, text, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with ids replaced by decoded (binary)."""
    path, pattern = path or vocabulary()[0], vocabulary()[1]
    df = df.drop(*(c for c in df.columns if c.lower() == "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            i = batch.schema.get_field_index("ids")
            texts = pa.array([c.decode(x.as_py() or b"") for x in batch.column(i)], pa.binary())
            yield batch.set_column(i, "decoded", texts)

    return df.mapInArrow(run, T.StructType([T.StructField("decoded", T.BinaryType()) if f.name == "ids" else f for f in df.schema]))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """df without the text, with n_tokens, ids_sha256, decoded_sha256 (and ids): the digests of encoding and of decoding those ids, in one pass."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    more = {"n_tokens": (pa.int64(), T.LongType()), "ids_sha256": (pa.string(), T.StringType()), "decoded_sha256": (pa.string(), T.StringType())}
    more |= {"ids": (pa.binary(), T.BinaryType())} if keep_ids else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def row(t: str) -> tuple:
            ids = c.encode(t)
            return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), ids)[: len(more)]

        yield from _rows(batches, text, list(more), [t for t, _ in more.values()], row)

    return df.mapInArrow(run, _schema(df, text, [T.StructField(n, t) for n, (_, t) in more.items()]))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
