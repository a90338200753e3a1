"""Main text of HTML pages (operator 9).

A page is read as a flat row of text blocks. Each block has its number of words, its link density (words
inside links / words), and the same two of the block before and the block behind. Five marks say where it stands:
inside an element whose role is page furniture (nav, footer, aside, button and the like),
inside an element that a word of its class, id or role calls so, inside article or main (0.5 on pages without either), a
heading, bare text of a container. A decision tree over these features, trained on a labelled table of blocks, says which
blocks are the main text; where several features split the table alike, counts and densities of the block and its
neighbours come before marks. On pages without article and main it asks for neighbours' counts and densities.

The labelled table comes from the pages of ``html_pages``, whose blocks start with + (main text) or - (not). ``train``
takes at most ``max_rows`` blocks and runs on the driver in a second. Pages are independent: there is no shuffle.

A class, id or role word speaks of the whole element only where that is sure: not on html and body, not on
the element that is the page's main part (the first main and the first article in it, or else the first
article) and on what holds that part, not on another article with a word of its own (post, story, ...), and
not in names that say what an element has or how it stands (no-sidebar, nav-open, header-image). A form around the main
part is no furniture either. A page without main and article whose text stands in a container named
sidebar-left is still taken as furniture.

Scripts, styles, templates, the head, drawings, frames, hidden elements and comments of the markup are no
blocks; formulas, objects, noscript and form fields are text like any other. Character
references are decoded, white space inside a block becomes one space, blocks are joined in page order by
one space. Null or empty html gives an empty text; broken markup never fails. Repeated rows and nulls in
other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeqa.llm.common import read
from lakeqa.llm.html_pages import labelled_page

#: What HTML elements do to the flow of text.
SKIPPED = frozenset("script style template head title svg iframe".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre figcaption caption summary legend option".split())
CONTAINERS = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form header hr html main menu nav ol section table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside menu dialog button".split())
#: Words of class, id or role that mark page furniture; beginnings of such words.
FURNITURE_WORDS = frozenset(
    "ad ads banner complementary consent contentinfo copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation notice notification "
    "pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social subscribe toolbar widget".split()
)
FURNITURE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sponsor")
#: With these words, header is the article's own.
OWN = frozenset("article post entry story".split())
#: A name with one of these says what an element has or how it stands, not what it is.
STATES = frozenset("no not with without has have open opened closed collapsed expanded fixed sticky".split())
#: With one of these, a name speaks of a part of the text that is set out like that.
CARRIERS = frozenset("figure image img layout photo picture".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
#: Attributes up to the tag's end, with quoted values that may hold it; it fails at the next tag's beginning at the latest.
ATTRIBUTES = re.compile(r"""((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ATTRIBUTE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
IS_MAIN = re.compile(r"""(?i)\b(?:id|role)\s*=\s*["']?main(?=["'\s]|$)""")
HIDDEN = re.compile(r"""(?i)\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    role: bool
    named: bool
    main: float
    heading: bool
    bare: bool


def markup(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """Tags of a page, in time that grows with its length: name (empty at the end), closing, attributes, and the text before.

    Elements of SKIPPED go with all they hold. A sign that begins no tag is text; a comment without an end goes on to the
    end of the page.
    """
    text: list[str] = []
    at, end, next_end = 0, len(page), -1
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            text.append(page[at:])
            break
        text.append(page[at:sign])
        at = sign + 1
        if page.startswith("!--", at):
            close = page.find("-->", at + 3)
            at = end if close < 0 else close + 3
            continue
        name = NAME.match(page, at)
        if name is None and page[at : at + 1] not in ("!", "?"):
            text.append("<")
            continue
        start = at if name is None else name.end()
        whole = ATTRIBUTES.match(page, start)
        if whole is None:
            if next_end < start:  # looked for once for all tags before it
                next_end = page.find(">", start)
                next_end = end if next_end < 0 else next_end
            if next_end == end:
                text.append("<")
                continue
        attributes, at = (whole[1], whole.end()) if whole else (page[start:next_end], next_end + 1)
        if name is None:
            continue
        tag, closing = name[2].lower(), bool(name[1])
        if tag in SKIPPED and not closing:
            close = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(page, at)
            at = end if close is None else close.start() if close[0][1] != "/" else close.end()
            continue
        yield tag, closing, attributes, "".join(text)
        text = []
    yield "", False, "", "".join(text)


def _place(name: str, attributes: str, inside_main: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is page furniture for sure, furniture unless it holds the main part, main, and hidden."""
    marks: set[str] = set()
    named: set[str] = set()  # marks without those of states
    hidden = False
    if attributes:
        names = [w for m in ATTRIBUTE.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()]
        for words in (re.split(r"[^a-z0-9]+", w) for w in names):
            marks.update(words)
            if not STATES.intersection(words) and not CARRIERS.intersection(words):
                named.update(w for w in words if w != "form" or w == words[-1])  # form-group is no form
        hidden = bool(HIDDEN.search(attributes))
        if marks & OWN:
            named = set() if name == "article" else named - {"header"}
    furniture = name in FURNITURE or name == "header" and not inside_main
    by_words = name not in ("html", "body") and (bool(named & FURNITURE_WORDS) or any(w.startswith(FURNITURE_STARTS) for w in named))
    return furniture, by_words or name == "form", name in MAIN or "main" in marks, hidden


class _Open(NamedTuple):
    """An open element: its name, whether it is inside furniture by role, the innermost element around it that is furniture
    by name (a number, or -1), whether it is inside the main part, and whether it is hidden."""

    name: str
    role: bool
    named: int
    main: bool
    hidden: bool


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[tuple[Block, int]] = []
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    outer: list[int] = []  # of each element that is furniture by name, the next such element around it
    parts: dict[str, int] = {}  # the innermost such element around the first main, the first article in it, the first article
    pieces: list[str] = []
    linked, links, heading = 0, 0, False
    veil, depth = "", 0  # a hidden element inside a block, and how often its name is open inside it
    ground = _Open("", False, -1, False, False)

    def top() -> _Open:
        return stack[-1] if stack else ground

    def pop() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    def flush() -> None:
        nonlocal pieces, linked
        words = "".join(pieces).split()
        if words:
            own = top()
            out.append((Block(" ".join(words), len(words), min(linked, len(words)), own.role, False, float(own.main), heading, own.name not in LEAVES), own.named))
        pieces, linked = [], 0

    for name, closing, attributes, raw in markup(page):
        if raw and not depth and not top().hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked += len(text.split()) if links else 0
        leaf, container = name in LEAVES, name in CONTAINERS
        if leaf or container:
            flush()
            links, depth, heading = 0, 0, name in HEADINGS and not closing
            while stack and stack[-1].name in LEAVES and (container or not closing or stack[-1].name == name):
                pop()
        if name == veil and depth:
            depth += -1 if closing else 1
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
        if closing:
            if container and open_names[name]:
                while pop() != name:
                    pass
            continue
        around = top()
        role, worded, main, hidden = _place(name, attributes, around.main)
        if hidden and not (leaf or container or depth or name in VOID):
            veil, depth = name, 1
        if leaf or container and not attributes.rstrip().endswith("/"):
            named = around.named
            if worded:
                outer.append(named)
                named = len(outer) - 1
            if not (around.role or role or around.hidden or hidden):
                if name == "main" or container and IS_MAIN.search(attributes):
                    parts.setdefault("main", named)
                elif name == "article":
                    parts.setdefault("first", named)
                    if "main" in parts and around.main:
                        parts.setdefault("article", named)
            stack.append(_Open(name, around.role or role, named, around.main or main, around.hidden or hidden))
            open_names[name] += 1
    flush()
    excused = {-1}  # what stands around the main part is no furniture
    for part in ("main", "article") if "main" in parts else ("first",):
        named = parts.get(part, -1)
        while named not in excused:
            excused.add(named)
            named = outer[named]
    unknown = {} if parts else {"main": 0.5}
    return [b._replace(named=named not in excused, **unknown) for b, named in out]


#: Names of the features, for reports and tests.
FEATURES = ("words", "density", "words before", "density before", "words behind", "density behind", "role", "named", "main", "heading", "bare")
PLACE = FEATURES.index("main")


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    own = [(float(b.words), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*own[i], *around[i], *around[i + 2], float(b.role), float(b.named), b.main, float(b.heading), float(b.bare)) for i, b in enumerate(blocks)]


#: Seeds of the labelled pages.
PAGES = 400


def labelled_blocks(pages: Iterable[str] | None = None) -> list[tuple[tuple[float, ...], int]]:
    """The labelled table: features of a block, 1 for main text."""
    rows = []
    for page in map(labelled_page, range(PAGES)) if pages is None else pages:
        blocks = blocks_of(page)
        rows += [(f, int(b.text[0] == "+")) for f, b in zip(features_of(blocks), blocks, strict=True)]
    return rows


def train(rows: list[tuple[tuple[float, ...], int]], depth: int = 8, max_rows: int = 10_000) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, below, above), or a share of main text as a leaf. It asks first
    for the place: outside or inside the page's main part, or a page without one."""
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} labelled blocks")
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def grow(x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max():
            return float(y.mean())
        best = None
        # counts and densities come before marks where both split alike
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < t
                impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low])) / len(y)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t), low)
        if best is None:
            return float(y.mean())
        _, f, t, low = best
        return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))

    # pages without article and main are learned by themselves, so neighbours matter there and not inside an article
    where = x[:, PLACE]
    parts = ((where < 0.25, 0.0), ((where >= 0.25) & (where < 0.75), 1.0), (where >= 0.75, 1.0))
    outside, unknown, inside = (grow(x[w], y[w], depth) if w.any() else other for w, other in parts)
    return (PLACE, 0.25, outside, (PLACE, 0.75, unknown, inside))


def is_main(tree, features: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        f, t, below, above = tree
        tree = below if features[f] < t else above
    return tree >= 0.5


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, f in zip(blocks, features_of(blocks), strict=True) if is_main(tree, f))


def extract(df: DataFrame, tree=None, html: str = "html") -> DataFrame:
    """df without html, with text and n_chars."""
    tree = train(labelled_blocks()) if tree is None else tree
    kept = [f for f in df.schema if f.name != html and f.name.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(html)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"]
            )

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
