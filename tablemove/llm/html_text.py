"""HTML extraction (operator 10): the maximum-scoring subsequence of a page's tokens.

A page becomes a sequence of tags and words.  Words score positive and tags
negative, with weights learned from labelled pages, here those whose author
marked the main text with ``<article>``: a token kind's weight is the log-odds
that it lies inside.  The names (classes, ids) of the elements around a word
add to its score what was learned of them, and names that often stand for
something else than the text take from it.  A linear scan finds the contiguous
region with the best sum; its words with a score above 0 are the text, one
line per block.

What lies below an element that is never article text (menus, forms, scripts,
hidden parts, ...) scores nothing and is left out of the text.  Such an element
is told by its tag, its role or, as a container, by a name.  A tag, role or
name says nothing where the element holds the page's article or main element or
nine tenths of all words: it is then a wrapper of the page.

Tags are read in one pass, attribute by attribute.  A ``<`` that opens no tag is
text; after a quote that never closes quotes mean nothing for the rest of the page.

Cases: null or empty html, or a page without words: empty text.  Unclosed or
crossed tags are closed by their parents.  Rows with equal or null ids are each
handled on their own; other columns are ignored; no rows: no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

LABELLED_PAGES = 2000  # pages the weights are learned from, by smallest hash of their id

# Elements by their part in a page.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td tfoot th thead title tr ul""".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike
strong sub sup time tt u var""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
NEVER_TEXT = frozenset("nav footer aside form menu dialog button label fieldset".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NEVER_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment
comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice
notices notification pager pagination popup promo promotion reply replies respond sidebar signup site-header
sponsor sponsored subscribe subscription toolbar topbar""".split())
DOUBTFUL_NAMES = frozenset("discussion related search share sharing skip social tags widget widgets".split())
NEGATIONS = frozenset("has no not with without".split())  # no-sidebar, with-menu: names of wrappers
NAMED = frozenset("center div dl ins li ol section span table tbody td tr ul".split())  # containers whose names count
#: Weights where no labelled page tells: of a word, a tag, and what a doubtful name adds to each of its words.
DEFAULT_WORD, DEFAULT_TAG, DOUBT = 1.0, -0.2, -2.0
LEAST_WORD, LEAST_TAG, MOST_WORD, MOST_TAG = 0.5, -0.05, 4.0, -1.0
NAME_FLOOR, NAME_PAGES = -2.0, 2  # what a learned name takes from a word at most, and the pages it must be seen on
WRAPPER = 0.9  # share of the page's words that makes an element a wrapper

_OPEN = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP, _EQUALS = re.compile(r"[\s/]*"), re.compile(r"\s*=\s*")
_ATTR_NAME, _BARE = re.compile(r"[^\s<>/=]+"), re.compile(r"[^\s<>]*")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_RAW_END = {tag: re.compile(f"</{tag}\\b[^<>]*>?", re.I) for tag in RAW}


class Tag(NamedTuple):
    name: str
    end: bool = False
    closed: bool = False  # <name/>
    attrs: tuple[tuple[str, str], ...] = ()


def _attributes(text: str, pos: int) -> tuple[list[tuple[str, str]], int, bool]:
    """(attributes from ``pos`` on, place of the closing ``>`` or -1, whether a quoted value was read or begun)."""
    out, quoted, size = [], False, len(text)
    while True:
        pos = _GAP.match(text, pos).end()
        if pos >= size or text[pos] in "<>":
            return out, pos if pos < size and text[pos] == ">" else -1, quoted
        name = _ATTR_NAME.match(text, pos)
        if name is None:  # an equals sign without a name
            pos += 1
            continue
        pos, value = name.end(), ""
        if equals := _EQUALS.match(text, pos):
            pos = equals.end()
            if text[pos:pos + 1] in ("'", '"'):
                quoted, to = True, text.find(text[pos], pos + 1)
                if to < 0:
                    return out, -1, True
                value, pos = text[pos + 1:to], to + 1
            else:
                value, pos = (m := _BARE.match(text, pos))[0], m.end()
        out.append((name[0].lower(), value))


def pieces(page: str) -> Iterator[str | Tag]:
    """Texts and tags of a page in order.  Time grows with its length: a tag that ends nowhere is read to the next ``<``
    only, or once beyond it, as from then on quotes mean nothing."""
    at, since, quotes, size = 0, 0, True, len(page)  # page[since:at] is text not given out yet
    while m := _OPEN.search(page, at):
        to = m.start()
        if to > since and page[to + 1] in "!?":
            yield page[since:to]
        start = to + 2 if page.startswith("</", to) else to + 1
        if page.startswith(("<!--", "<![CDATA["), to):
            mark = "-->" if page[to + 2] == "-" else "]]>"
            end = page.find(mark, to + 4)
            at = since = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), to):
            end = page.find(">", to)
            at = since = size if end < 0 else end + 1
        else:
            m = _TAG_NAME.match(page, start)
            name = m[0].lower()
            if "<" in name:  # no tag
                end = -1
            elif quotes:
                attrs, end, quoted = _attributes(page, m.end())
                quotes = end >= 0 or not quoted
            if not quotes and "<" not in name:
                stop = page.find("<", to + 1)
                end = page.find(">", m.end(), stop if stop >= 0 else size)
                attrs = _attributes(page[m.end():end + 1], 0)[0] if end >= 0 else []
            if end < 0:
                at = to + 1
                continue
            if to > since:
                yield page[since:to]
            yield Tag(name, start == to + 2, page[end - 1] == "/", tuple(attrs))
            at = since = end + 1
            if name in RAW and start == to + 1 and page[end - 1] != "/":
                m = _RAW_END[name].search(page, at)
                at = since = size if m is None else m.end()
                yield Tag(name, True)
    if since < size:
        yield page[since:]


class Element:
    """An open or closed element: what its tag, roles and names say, and the words below it."""

    __slots__ = ("article", "boundary", "context", "doubts", "hidden", "marked", "names", "never", "parent", "penalty", "seen", "tag", "words")

    def __init__(self, tag: str, attrs: tuple[tuple[str, str], ...], parent: "Element | None"):
        self.tag, self.parent, self.words, self.marked = tag, parent, 0, tag in ("article", "main")
        self.article = tag == "article" or parent is not None and parent.article
        self.context = tag if tag in BLOCK else parent.context if parent else ""
        self.hidden = tag in HIDDEN
        self.never = tag in NEVER_TEXT or tag == "header" and not self.article
        self.boundary = tag == "form"  # may be a wrapper on its own
        self.doubts, self.names, self.penalty, self.seen = 0, [], 0.0, [0, 0]
        for name, value in attrs:
            if name == "class" or name == "id":
                self.names += [x for x in value.lower().split()]
                if tag in NAMED and not (self.article and (tag == "section" or name == "id")) and not (tag == "section" and name == "id"):
                    self._named(value.lower().split())
            elif name == "role" and value.strip().lower() in NEVER_ROLES:
                self.never = True
            elif name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
                self.hidden = True

    def _named(self, names: list[str]) -> None:
        for x in names:
            parts = {x} if self.article else {x, *re.split(r"[-_]+", x)}  # inside an article whole names only
            if not NEGATIONS.isdisjoint(parts):
                continue
            if not NEVER_NAMES.isdisjoint(parts):
                self.never = True
                self.boundary |= x not in NEVER_NAMES
            elif not DOUBTFUL_NAMES.isdisjoint(parts):
                self.doubts += 1


class Token(NamedTuple):
    kind: str  # word:<block around it> or tag:<name>
    text: str | None
    block: int
    element: Element | None


def tokens(page: str) -> tuple[list[Token], list[Element]]:
    """Tags and the words between them, and all elements, parents first; these know the words below them."""
    out: list[Token] = []
    stack: list[Element] = []
    opened: Counter = Counter()
    every: list[Element] = []
    block = 0

    def close(tag: str) -> None:
        while stack:
            gone = stack.pop().tag
            opened[gone] -= 1
            if gone == tag:
                return

    for piece in pieces(page):
        if isinstance(piece, str):
            if stack:
                stack[-1].words += len(piece.split())
            out.append(Token(f"word:{stack[-1].context if stack else ''}", piece, block, stack[-1] if stack else None))
            continue
        tag = piece.name
        block += tag in BLOCK
        if piece.end:
            if opened[tag] > 0:
                close(tag)
            above = stack[-1] if stack else None
        else:
            if tag in BLOCK and stack and stack[-1].context == "p":
                close("p")  # a block ends an open paragraph and what is open in it
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
                close(tag)
            above = stack[-1] if stack else None
            if tag not in VOID and not piece.closed:
                own = Element(tag, piece.attrs, above)
                stack.append(own)
                every.append(own)
                opened[tag] += 1
        out.append(Token(f"tag:{tag}", " " if tag == "br" else None, block, above))
    for e in reversed(every):  # children come after their parents
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.marked |= e.marked
    total = sum(e.words for e in every if e.parent is None)
    for e in every:
        wrapper = e.marked and e.tag not in ("article", "main") or e.boundary and e.words >= WRAPPER * max(1, total)
        e.never = e.hidden or e.never and not wrapper
        e.doubts = 0 if wrapper else e.doubts
        if e.parent is not None:  # parents come before their children
            e.never |= e.parent.never
            e.doubts += e.parent.doubts
    return out, every


def count_labelled(page: str) -> Counter:
    """Counts of (token kind, inside) of a page that marks its article; words count each, for their block and for the names of the elements around them."""
    out: Counter = Counter()
    found, elements = tokens(page)
    for kind, text, _, e in found:
        if e is not None and e.never:
            continue
        inside, words = e is not None and e.article, len(text.split()) if kind.startswith("word") else 1
        out[kind, inside] += words
        if kind.startswith("word") and e is not None:
            e.seen[inside] += words
    for e in reversed(elements):
        for inside in (0, 1):
            for name in set(e.names) if e.seen[inside] else ():
                out[f"name:{name}", bool(inside)] += e.seen[inside]
            if e.parent is not None:
                e.parent.seen[inside] += e.seen[inside]
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of lying inside; words from LEAST_WORD to MOST_WORD, tags from MOST_TAG to LEAST_TAG, names from NAME_FLOOR to 0."""
    out = {}
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 1) / (counts.get((kind, False), 0) + 1))
        what = kind.split(":")[0]
        low, high = {"word": (LEAST_WORD, MOST_WORD), "tag": (MOST_TAG, LEAST_TAG), "name": (NAME_FLOOR, 0.0)}[what]
        out[kind] = min(high, max(low, odds))
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best region: its blocks, one per line."""
    best, best_span, total, start = 0.0, None, 0.0, 0
    items = []
    found, elements = tokens(page or "")
    for e in elements:
        e.penalty = min([e.parent.penalty if e.parent else 0.0, *(weights.get(f"name:{x}", 0.0) for x in e.names)])
    for kind, text, block, e in found:
        words, score = html.unescape(text) if text is not None else "", 0.0
        if e is not None and e.never:
            words = ""
        elif kind.startswith("word"):
            each = weights.get(kind, DEFAULT_WORD) + (DOUBT * e.doubts + e.penalty if e is not None else 0.0)
            score = each * len(words.split())
            words = "" if each <= 0 else words
        else:
            score = weights.get(kind, DEFAULT_TAG)
        items.append((kind, words, block))
        if total <= 0:
            total, start = 0.0, len(items) - 1
        total += score
        if total > best:
            best, best_span = total, (start, len(items))
    if best_span is None:
        return ""
    inside = {items[i][2] for i in range(*best_span) if items[i][0].startswith("word") and items[i][1].strip()}
    blocks: dict[int, list[str]] = {}
    for _, words, block in items:
        if words and block in inside:
            blocks.setdefault(block, []).append(words)
    lines = (" ".join("".join(x).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from ``sample`` of the pages that mark their article; counted in tasks, a row per token kind comes back.

    HTML's own tags always count, other tags and names if seen on NAME_PAGES of these pages."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<article[\\s>]"))
    ids = rows.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    own = {f"{what}:{t}" for what in ("word", "tag") for t in BLOCK | INLINE | VOID | HIDDEN | {""}}

    def run(batches):
        for b in batches:
            total, on = Counter(), Counter()
            for page in b.column("html").to_pylist():
                counts = count_labelled(page)
                total.update(counts)
                on.update(counts.keys())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64()),
                                              pa.array([on[k] for k in total], pa.int64()), pa.array([k in own for k, _ in total], pa.bool_())], names=["kind", "inside", "n", "pages", "own"])

    counted = (rows.join(F.broadcast(ids), "id").select("html").mapInArrow(run, "kind string, inside boolean, n long, pages long, own boolean")
               .groupBy("kind", "inside", "own").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")).where(F.col("own") | (F.col("pages") >= NAME_PAGES)))
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in counted.collect()})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 weights: dict[str, float] | None = None) -> DataFrame:
    """(id, url, text) per row of ``pages``."""
    prepare(pages.sparkSession)
    weights = learn_weights(pages, id_col, html_col) if weights is None else weights
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            own = [extract(x, weights) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(own, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
