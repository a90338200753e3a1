"""From filings to chunks: cleaning, sections, chunks, headers, embeddings, and checks on the result."""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeqa.functions.text import clean_section_label, context_header, parse_item_heading, with_header
from lakeqa.operators.selection import exact_percentiles


class _Text(HTMLParser):
    """Text nodes a line each; table rows a line each, cells joined by pipes; scripts, styles and hidden data left out."""

    DROPPED = frozenset(("script", "style", "ix:header"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.dropped, self.tables = [], 0
        self.cells: list[str] = []
        self.cell: list[str] | None = None

    def _end_cell(self) -> None:
        if self.cell:
            self.cells.append(" ".join(self.cell))
        self.cell = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.cells:
            self.lines.append(" | ".join(self.cells))
        self.cells = []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.dropped.append(tag)
        elif tag == "table":
            self.tables += 1
        elif self.tables == 1 and tag == "tr":
            self._end_row()
        elif self.tables == 1 and tag in ("td", "th"):
            self._end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.dropped.remove(tag)
        elif tag == "table" and self.tables:
            if self.tables == 1:
                self._end_row()
            self.tables -= 1
        elif self.tables == 1 and tag == "tr":
            self._end_row()
        elif self.tables == 1 and tag in ("td", "th"):
            self._end_cell()

    def handle_data(self, data):
        if self.dropped or not data.strip():
            return
        if self.tables:
            if self.cell is not None:
                self.cell.append(data.strip())
        else:
            self.lines.extend(data.splitlines())


def html_to_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = (re.sub(r"[ \t]+", " ", line.replace("\xa0", " ")).strip() for line in parser.lines)
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def clean_html(page: pd.Series) -> pd.Series:
    """Text of HTML pages, a line for each text node and table row."""
    return page.map(html_to_text)


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """document_id, section_order, section, body: the text between item headings; spans of one item are joined.

    Lines become rows; a running count of headings makes the spans. Both windows and the grouping are by document.
    """
    lines = docs.select("document_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("head", parse_item_heading(F.col("line")))
    order = Window.partitionBy("document_id").orderBy("line_no")
    lines = lines.withColumn("span", F.count("head").over(order))
    spans = lines.withColumn("key", F.last(F.col("head.key"), ignorenulls=True).over(order))
    spans = spans.withColumn("key", F.coalesce("key", F.lit("")))
    grouped = spans.groupBy("document_id", "key").agg(
        F.min("line_no").alias("first_line"),
        F.min(F.when(F.col("head.title") != "", F.struct("line_no", F.col("head.title").alias("title")))).alias("named"),
        F.max("span").alias("last_span"),
        F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("line_no", "span", "line")))).alias("body"),
        F.array_sort(F.collect_set("span")).alias("spans"),
    )
    # an empty span between two headings still is a line of its own
    of_span = lambda s: F.array_join(F.transform(F.filter("body", lambda x: x["span"] == s), lambda x: x["line"]), "\n")
    body = F.array_join(F.transform("spans", of_span), "\n")
    name = F.regexp_replace(F.concat(F.lit("Item "), "key", F.lit(". "), F.coalesce("named.title", F.lit(""))), r"^[. ]+|[. ]+$", "")
    named = grouped.select("document_id", "key", "first_line", F.when(F.col("key") == "", "Unsectioned").otherwise(name).alias("section"), body.alias("body"))
    kept = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("document_id"))).filter((F.col("key") != "") | (F.col("n") == 1) | F.col("body").rlike(r"\S"))
    numbered = F.row_number().over(Window.partitionBy("document_id").orderBy("first_line")) - 1
    return kept.select("document_id", numbered.alias("section_order"), "section", "body")


def section_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """document_id, span, key, first_line, lines: headings start spans; span 0 is what comes before the first."""
    lines = docs.select("document_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("head", parse_item_heading(F.col("line")))
    lines = lines.withColumn("span", F.count("head").over(Window.partitionBy("document_id").orderBy("line_no")))
    return lines.groupBy("document_id", "span").agg(F.max("head.key").alias("key"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines"))


def _long_cuts(start: int, stop: int, size: int, overlap: int) -> list[int]:
    """Where a line's windows of ``size`` characters begin, overlapping, and behind them where the rest begins that fits."""
    step = size - overlap
    windows = max(0, -(-(stop - start - size) // step))
    return [start + step * i for i in range(windows + 1)]


def chunk_spans(text: str, size: int = 800, overlap: int = 150) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: as many whole lines as fit, begun ``overlap`` characters before the last end.

    Lines longer than size are windows of their own; what is left of one begins the next chunk. A run of lines between
    such windows is cut by looking up, among the ends of its lines, the last one within reach of the chunk's start.
    """
    spans: list[tuple[int, int]] = []
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    lines = list(zip([0, *(i + 1 for i in breaks)], [*breaks, len(text)], strict=True))
    # a run begins at the text's start or at the rest of a long line
    number = list(itertools.accumulate(int(b - a > size) for a, b in lines))
    for _, run in itertools.groupby(zip(number, lines, strict=True), key=lambda x: x[0]):
        run = [line for _, line in run]
        *windows, first = _long_cuts(*run[0], size, overlap)
        spans += [(w, w + size) for w in windows]
        starts, ends = [first, *(a for a, _ in run[1:])], [b for _, b in run]
        blank = next((i for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if b > a), len(ends))
        begin, at = (starts[blank] if blank < len(ends) else first), blank
        while at < len(ends):
            last = max(at, bisect.bisect_right(ends, begin + size) - 1)  # a chunk has one new line at least
            spans.append((begin, ends[last]))
            begin, at = max(begin, ends[last] - overlap), last + 1
    return spans


def chunks_of(text: str | None, size: int = 800, overlap: int = 150, least: int = 40) -> list[str]:
    """The stripped texts of ``chunk_spans``, without those of least characters or fewer."""
    text = text or ""
    return [c for a, b in chunk_spans(text, size, overlap) if len(c := text[a:b].strip()) > least]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunked(text: pd.Series) -> pd.Series:
    return text.map(chunks_of)


def chunk_text(sections: DataFrame) -> DataFrame:
    """document_id, section_order, section, piece, content from sections. Chunks never cross a section."""
    return sections.select("document_id", "section_order", "section", F.posexplode(_chunked("body")).alias("piece", "content"))


def chunk_index(pieces: DataFrame) -> DataFrame:
    """Pieces with chunk_index, from 0 over the whole document, in order of section and piece."""
    order = Window.partitionBy("document_id").orderBy("section_order", "piece")
    return pieces.withColumn("chunk_index", F.row_number().over(order) - 1)


def hash_encode(texts: list[str], dim: int = 384) -> np.ndarray:
    """The default encoder: signed feature hashing of words, of unit length."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[i, h % dim] += 1 if h & 0x80000000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(chunks: DataFrame, encode_fn: Callable[[list[str]], np.ndarray] = hash_encode, batch: int = 64) -> DataFrame:
    """chunks with embedding; encode_fn gets up to batch texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):  # vectors go on batch by batch, not a whole frame's at once
                part = frame.iloc[i : i + batch]
                yield part.assign(embedding=list(encode_fn(part["content"].tolist())))

    return chunks.mapInPandas(run, T.StructType([*chunks.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def new_filings(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """Filings of the manifest that are not loaded yet."""
    return manifest.join(docs.select("source_path"), "source_path", "left_anti")


def build_corpus(manifest: DataFrame, pages: DataFrame, docs: DataFrame | None = None, encode_fn: Callable | None = hash_encode) -> DataFrame:
    """Chunks of new filings: document_id, ticker, filing_date, chunk_index, section, content, embedding.

    manifest: document_id, company, ticker, form_type, filing_date, source_path. pages: source_path, html. Filings
    without a chunk yield no rows; ``empty_filings`` reports them.
    """
    fresh = manifest if docs is None else new_filings(manifest, docs)
    texts = fresh.join(pages, "source_path").repartition("document_id").select("document_id", clean_html("html").alias("text"))
    pieces = chunk_index(chunk_text(split_sections(texts))).join(fresh, "document_id")
    section = F.left(clean_section_label(F.col("section")), F.lit(200))
    header = context_header(F.col("company"), F.col("ticker"), F.col("form_type"), section)
    out = pieces.select("document_id", "ticker", "filing_date", "chunk_index", section.alias("section"), with_header(header, F.col("content")).alias("content"))
    return out if encode_fn is None else embed(out, encode_fn)


def empty_filings(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Filings of the manifest without any chunk."""
    return manifest.join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def adjacent_overlap(chunks: DataFrame, body: Column, n: int = 150) -> DataFrame:
    """document_id, chunk_index, adjacent, matches: whether the chunk before ends with this one's first n characters."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.select("document_id", "chunk_index", F.left(body, F.lit(n)).alias("head"), F.right(body, F.lit(n)).alias("tail"))
    rows = rows.withColumn("adjacent", F.coalesce(F.lag("chunk_index").over(order) == F.col("chunk_index") - 1, F.lit(False)))
    return rows.select("document_id", "chunk_index", "adjacent", (F.col("adjacent") & (F.lag("tail").over(order) == F.col("head"))).alias("matches"))


def overlap_report(chunks: DataFrame, header: Column, body: Column, n: int = 150) -> DataFrame:
    """One row: chunks, with_header, pairs, matches, match_rate in %."""
    pairs = adjacent_overlap(chunks, body, n).agg(F.count_if("adjacent").alias("pairs"), F.count_if("matches").alias("matches"))
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(header != "").alias("with_header"))
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.col("matches"), F.col("pairs")), F.lit(0.0)), 2)
    return counts.crossJoin(pairs).withColumn("match_rate", rate)  # one row each


def section_report(sections: DataFrame, key_items: tuple[str, ...] = ("1", "1A", "7", "8"), min_chars: int = 500) -> DataFrame:
    """document_id, n_sections, sizes (by key item), missing, thin, status. A key that occurs twice has the later size."""
    first, second = F.split("section", r"\s+").getItem(0), F.regexp_replace(F.try_element_at(F.split("section", r"\s+"), F.lit(2)), r"\.+$", "")
    rows = sections.withColumn("key", F.when(first == "Item", second)).withColumn("chars", F.length("body"))
    keyed = rows.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max_by("chars", "section_order").alias("chars"))
    wanted = F.col("key").isin(*key_items)
    grouped = keyed.groupBy("document_id").agg(F.sum("n").alias("n_sections"), F.array_sort(F.collect_list(F.when(wanted, F.struct("key", "chars")))).alias("sizes"))
    present = F.transform("sizes", lambda s: s["key"])
    grouped = grouped.select(
        "document_id",
        "n_sections",
        F.map_from_entries("sizes").alias("sizes"),
        F.array_except(F.array(*map(F.lit, key_items)), present).alias("missing"),
        F.transform(F.filter("sizes", lambda s: s["chars"] < min_chars), lambda s: s["key"]).alias("thin"),
    )
    return grouped.withColumn("status", F.when((F.size("missing") > 0) | (F.size("thin") > 0), "CHECK").otherwise("OK"))


def chunk_counts(chunks: DataFrame, share: float = 0.25) -> DataFrame:
    """document_id, n_chunks, median, low: filings with far fewer chunks than the median filing."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    (median,) = exact_percentiles(counts, "n_chunks", [0.5])
    return counts.withColumn("median", F.lit(median).cast("double")).withColumn("low", F.col("n_chunks") < share * F.col("median"))
