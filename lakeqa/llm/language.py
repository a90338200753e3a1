"""Language identification (operator 7).

A text is the average of embeddings of its hashed subwords, over all its words, followed by a linear
softmax. Subwords are the whole word ``<word>`` and its character n-grams. Both layers are trained by
stochastic gradient descent in numpy.

Training takes a bounded sample: at most ``per_language`` different texts of each language, those with the smallest
hash, and at most ``max_rows`` in all (fewer of each, if there are many languages; more languages than that are an
error). Each text is read whole in tasks and becomes shares of BUCKETS buckets, so what the driver gets is bounded too;
it trains there in seconds. A fifth of the sample is kept from training and calibrates the temperature of the softmax
and the rejection: how probable, on average, the subwords of a text are in the language that is predicted. The least
value that is accepted is the one that best tells texts in their own language from the same texts looked at as if their
language were not among those learned.

Prediction needs no shuffle. As the model is linear in the averaged subwords, each distinct word of some megabytes of
text is looked at once, all of them together in numpy.

A text without a letter (also null or empty) is ``und`` with score 0. Words are runs of letters, in lower
case. Null ids and repeated rows pass through; a table without labelled rows gives ``und`` throughout. Columns of the
input with the name of an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeqa.llm.common import read

BUCKETS, DIMENSIONS, SIZES = 1 << 15, 16, (2, 3, 4)
#: Bytes of text, and words, that are worked on together.
STRETCH, WORDS = 8 << 20, 20_000
BETWEEN = r"\P{L}+"

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit numbers."""
    x = x ^ (x >> U(29))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return (x % U(BUCKETS)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words of letters, and the number of the word that each belongs to, rising."""
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    starts = np.flatnonzero(marked == ord("<"))
    lengths = np.diff(np.append(starts, len(marked)))
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(marked)) - starts[word]
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, U))
    whole = np.add.reduceat(marked * powers[place], starts) if len(starts) else np.empty(0, U)
    buckets, owners = [_mixed(whole)], [np.arange(len(words))]
    for n in SIZES:
        at = np.flatnonzero(lengths[word] - place >= n)
        h = np.full(len(at), n, U)
        for k in range(n):
            h = h * U(0xD6E8FEB86659FD93) + marked[at + k]
        buckets.append(_mixed(h))
        owners.append(word[at])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def summed(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; ends: where each run ends."""
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=float)])
    return total[ends] - total[np.append(0, ends[:-1])]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts in lower case (with an empty one perhaps), the number of each word in order, where each text ends."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), BETWEEN)
    coded = pc.utf8_lower(lists.flatten()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, rising, and their shares."""
    words, places, _ = words_of(pa.array([text], pa.string()))
    counts = np.bincount(places, minlength=len(words)) * np.array([w != "" for w in words])
    total = np.zeros(BUCKETS)
    for i in range(0, len(words), WORDS):
        bucket, owner = subwords(words[i : i + WORDS])
        total += np.bincount(bucket, counts[i : i + WORDS][owner], BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1.0, total.sum())).astype(np.float32)


def training_sample(labelled: DataFrame, per_language: int = 600, max_rows: int = 20_000, max_bytes: int = 1 << 30) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, shares) of a bounded sample of labelled rows (text, lang): texts in order of a hash, as many as the
    bounds of rows and of bytes of all bags leave to each language, one at least."""
    rows = labelled.filter("lang IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    languages = rows.select("lang").distinct().limit(max_rows + 1).count()
    if languages > max_rows:
        raise ValueError(f"over {max_rows} languages")
    most = min(per_language, max_rows // max(1, languages))
    # copies of a text are one before they are ranked; the group limit is applied before the shuffle by language
    ranked = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    top = ranked.filter(F.col("k") <= most)
    bounds = top.groupBy("lang").agg(F.max("h").alias("bound"))
    chosen = rows.join(F.broadcast(bounds), "lang").filter("h <= bound").dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *(pa.array([x[i].tobytes() for x in bags], pa.binary()) for i in (0, 1))], names=["lang", "h", "buckets", "shares"])

    bags = chosen.mapInArrow(run, "lang string, h long, buckets binary, shares binary")
    before = F.sum(F.length("buckets") + F.length("shares")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    bags = bags.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < max_bytes // max(1, languages)).drop("before", "h")
    got = sorted((r["lang"], bytes(r["buckets"]), bytes(r["shares"])) for r in bags.collect())
    return [(lang, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for lang, b, s in got if b]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Languages; by bucket, the scores of the languages and then the log-probabilities in them; the temperature and the
    least mean log-probability that is accepted."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, accept: float) -> None:
        self.languages, self.table, self.temperature, self.accept = languages, table, temperature, accept

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row for each word: the sums of its subwords' rows and their number; zeros for the empty word."""
        out = np.zeros((len(words), self.table.shape[1] + 1))
        for i in range(0, len(words), WORDS):
            bucket, owner = subwords(words[i : i + WORDS])
            ends = np.cumsum(np.bincount(owner, minlength=len(words[i : i + WORDS])))
            out[i : i + WORDS, :-1] = summed(self.table[bucket], ends)
            out[i : i + WORDS, -1] = np.diff(np.append(0, ends))
        out[[i for i, w in enumerate(words) if w == ""]] = 0
        return out

    def predict(self, texts: pa.Array) -> list[tuple[str, float, bool]]:
        """Language, score and whether the prediction is accepted, of each text."""
        if not len(texts):
            return []
        if not self.languages:
            return [("und", 0.0, False)] * len(texts)
        words, places, ends = words_of(texts)
        total = summed(self.vectors(words)[places], ends)
        n, k = total[:, -1:], len(self.languages)
        mean = total[:, :-1] / np.maximum(n, 1)
        p = softmax(mean[:, :k] / self.temperature)
        best = p.argmax(1)
        row = np.arange(len(best))
        typical = mean[row, k + best] >= self.accept
        return [(self.languages[b], float(s), bool(t)) if m else ("und", 0.0, False) for b, s, t, m in zip(best, p[row, best], typical, n[:, 0], strict=True)]


def fit(sample: list, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Embeddings and softmax by stochastic gradient descent, then calibration on the fifth of the sample kept back."""
    languages = sorted({s[0] for s in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    kept_back, training = order[: len(sample) // 5], order[len(sample) // 5 :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    data = [(place[a], b, c.astype(float)) for a, b, c in sample]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(training):
            y, b, s = data[i]
            mean = s @ embedding[b]
            error = softmax(mean @ weights)
            error[y] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            embedding[b] -= step * np.outer(s * min(len(b), 200), back)
    scores_of = embedding @ weights
    # a text counts for 1,000 subwords in the probabilities of its language
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for i in training:
        y, b, s = data[i]
        counts[b, y] += 1000 * s
    typical_of = np.log(counts / counts.sum(0))
    check = [data[i] for i in kept_back] or data
    scores, typical, truth = np.array([s @ scores_of[b] for _, b, s in check]), np.array([s @ typical_of[b] for _, b, s in check]), np.array([y for y, *_ in check])
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.005, 20, 80)), key=loss)
    own = typical[np.arange(len(truth)), truth]
    # without its own language a text gets the one that the scores put second
    others = np.where(np.arange(len(languages)) == truth[:, None], -np.inf, scores)
    without = typical[np.arange(len(truth)), others.argmax(1)] if len(languages) > 1 else np.empty(0)
    share = lambda t: (own >= t).mean() + ((without < t).mean() if len(without) else -abs((own < t).mean() - 0.01))
    accept = max(map(float, np.unique(np.concatenate([own, without]))), key=share)
    return Model(languages, np.hstack([scores_of, typical_of]).astype(np.float32), temperature, accept)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the text, with lang_pred, score, accepted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the data
    kept = [f for f in df.schema if f.name != text and f.name.lower() not in ("lang_pred", "score", "accepted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            texts = batch.column(text)
            sizes, rows, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), [], 0
            while at < batch.num_rows:  # some megabytes at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, "right")))
                rows += predict(texts.slice(at, end - at))
                at = end
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), "lang_pred", "score", "accepted"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 1 when divided by 3; null ids do not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(training_sample(docs.filter(~held_out()).select("text", "lang")))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
