"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass scores a block by
its length, its stop-word density and its link density; where it stands is one
more feature (an article's element counts for it, a menu's, a footer's, a form's
or an advert's against it).  Blocks too short to tell stay open; in the second
pass they inherit the label of the nearest decided block, within the same
container where that has any.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BOILER_TAGS = frozenset(
    "nav header footer aside form button select option datalist fieldset dialog menu head title script style noscript template "
    "iframe object applet canvas svg math audio video map textarea".split()
)
#: Words that, as a whole class, id or role, mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar topbar widget alert contentinfo complementary dialog".split()
)
#: What such a word may be joined with, as in ``comment-list`` (but not in ``no-sidebar``).
BOILER_PARTS = frozenset(
    "area bar block bottom box column container content global group inner item items left links list main page panel posts primary "
    "right row secondary section site slot text thread top unit wrap wrapper".split()
)
#: Those of reader comments, which may be articles by themselves.
COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: Words that, as a whole class, id or role, mark the article, and what they may be joined with.
ARTICLE_WORDS = frozenset("article content entry main post story".split())
ARTICLE_PARTS = frozenset("area blog body center column container inner news page primary section single text wrap wrapper".split())
# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    # English
    "the of and a to in is that it was for on are as with be at by this from or an not have had but "
    # German
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    # French
    "le la les de des du et un une en que qui dans pour pas sur par au avec est il elle ne se ce plus sont "
    # Spanish
    "el los las y del se por con una su para como más o pero sus al lo".split()
)
#: Thresholds of the first pass.
MOST_LINKS, SHORT, LONG, STOPS_LOW, STOPS_HIGH = 0.5, 70, 200, 0.15, 0.30

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
#: Every attribute in turn, so that no name is looked for inside a value.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_LETTERS = re.compile(r"[^\W\d_]+")


class _Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "linked", "boiler", "inside", "good")

    def __init__(self, text: str, linked: int, boiler: bool, inside: int):
        self.text, self.linked, self.boiler, self.inside = text, linked, boiler, inside
        self.good: bool | None = None


@lru_cache(maxsize=1 << 16)
def _name_marks(name: str) -> tuple[bool, bool]:
    """Whether a class, id or role marks boilerplate, and whether the article.

    A name of several parts does if one of them does and the others only place
    it: ``comment-list`` and ``post-comments``, but not ``no-sidebar``.  What
    heads an article (``entry-header``) is no page header.
    """
    parts = re.split("[-_]+", name)
    words = {x for x in parts if x in BOILER_WORDS}
    known = all(x in BOILER_WORDS or x in BOILER_PARTS or x in ARTICLE_WORDS or x.isdigit() for x in parts)
    of_article = not ARTICLE_WORDS.isdisjoint(parts)
    boiler = known and bool(words) and not (of_article and words == {"header"})
    return boiler, of_article and all(x in ARTICLE_WORDS or x in ARTICLE_PARTS for x in parts)


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article, by itself."""
    boiler, article = tag in BOILER_TAGS, tag in ("article", "main")
    if attributes:
        seen = set()
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in seen:  # the first of a name counts
                continue
            seen.add(name)
            if name == "hidden" or name == "aria-hidden" and value == "true":
                boiler = True
            elif name == "style":
                boiler |= "display:none" in re.sub(r"\s", "", value)
            elif name in ("class", "id", "role") and tag not in ("html", "body", "main"):
                for x in value.split():
                    bad, good = _name_marks(x)
                    boiler |= x in COMMENT_WORDS if tag == "article" else bad
                    article |= good
    return boiler, article and not boiler


def _collapsed(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(page: str) -> list[_Block]:
    """Blocks of a page in order, with decoded text and single spaces."""
    found: list[_Block] = []
    # Open elements and what held before them: in boilerplate, number of the article or
    # 0, in a phrase (an advert within a line, say) that is left out of its block.
    stack: list[tuple[str, bool, int, bool]] = []
    boiler, inside, mute, articles = False, 0, False, 0
    parts: list[str] = []
    link_parts: list[str] = []
    in_link, breaks, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal breaks
        if parts:
            text = _collapsed(parts)
            if text:
                found.append(_Block(text, len(_collapsed(link_parts)), boiler, inside))
            parts.clear()
            link_parts.clear()
        breaks = 0

    while at < end:
        m = _TAG.search(page, at)
        chunk = page[at : m.start() if m else end]
        if chunk and not mute:
            parts.append(chunk)
            if in_link:
                link_parts.append(chunk)
            if breaks and not chunk.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if m[1]:  # an end tag
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK_TAGS:
                flush()
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_at is not None:
                _, boiler, inside, mute = stack[open_at]
                del stack[open_at:]
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag in RAW_TAGS and tag not in ("template",):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            parts.append(" ")
            continue
        if tag == "a":
            in_link += 1
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "p" or tag == "li":  # the end tag of the one before is optional
            last = stack[-1][0] if stack else ""
            if last == tag:
                _, boiler, inside, mute = stack.pop()
        own_boiler, own_article = _marks(tag, m[3])
        stack.append((tag, boiler, inside, mute))
        if own_boiler and tag not in BLOCK_TAGS:
            mute = True
        elif own_boiler:
            boiler = True
        elif own_article and not boiler and not inside:
            articles += 1
            inside = articles
    flush()
    return found


def first_pass(b: _Block) -> bool | None:
    """Label of a block by itself: good, bad, or open.

    Text in sentences (stop words) and of some length counts for a block, links
    against it; so does the container it stands in.
    """
    size = len(b.text)
    words = _LETTERS.findall(b.text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0.0
    score = 0
    if size >= SHORT:
        long = size >= LONG
        # Long text without links may be in a language that has no stop words here.
        score += 1 + long + (stops >= STOPS_HIGH) if stops >= STOPS_LOW else 2 if long and not b.linked else -1
    # In an article short links and long quotations are no list of links.
    if b.linked > ((0.9 if size < SHORT else 1.0) if b.inside else MOST_LINKS) * size:
        score -= 6
    if not b.inside and size < SHORT and b.text.lower().startswith(("©", "copyright ")):
        score -= 6
    score += 2 * (b.inside > 0 and size >= SHORT) - 9 * b.boiler
    if score < 0 or size >= SHORT and score == 0 and b.linked:
        return False
    return True if score >= 2 else None


def classify(page_blocks: list[_Block]) -> None:
    """Set ``good`` of every block in two passes."""
    for b in page_blocks:
        b.good = first_pass(b)
    _inherit(page_blocks)


def _nearest(page_blocks: list[_Block], same: bool) -> list[bool | None]:
    """For every open block the label of the nearest decided one, in its container with ``same``.

    Of two as near the good one counts.  Blocks in boilerplate say nothing about
    their neighbours.
    """
    out: list[bool | None] = [None] * len(page_blocks)
    away = [0] * len(page_blocks)
    for order in (range(len(page_blocks)), range(len(page_blocks) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            b = page_blocks[i]
            place = b.inside if same else 0
            if b.good is None:
                if place in last:
                    at, label = last[place]
                    far = abs(i - at)
                    if out[i] is None or far < away[i] or far == away[i] and label:
                        out[i], away[i] = label, far
            elif not b.boiler:
                last[place] = (i, b.good)
    return out


def _inherit(page_blocks: list[_Block]) -> None:
    near, anywhere = _nearest(page_blocks, True), _nearest(page_blocks, False)
    has_article = any(b.inside and not b.boiler for b in page_blocks)
    for i, b in enumerate(page_blocks):
        if b.good is None:
            # Beside an article, only what stands near other text is text.
            far = anywhere[i] if b.inside or not has_article else None
            label = near[i] if near[i] is not None else far
            # Open blocks of an article with nothing decided are the article itself.
            b.good = bool(b.inside) if label is None else label


def main_text(page: str | None) -> str:
    """Good blocks of a page, one to a line; empty for a null page."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.good)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row of ``pages``.

    Character references are decoded, white space within a block becomes one
    space, blocks are joined by one line feed; nothing is cut off.  A null or
    empty page, or one without article, has empty text.  Existing columns of
    the two names are replaced.  Rows are handled one by one, a batch at a
    time, so repeated rows and very long pages need no care.
    """
    rows = pages.drop("text", "n_chars").withColumn(html_col, F.col(html_col).cast("string"))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    at = rows.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*batch.schema.names, "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"{fields}, text string, n_chars bigint")
