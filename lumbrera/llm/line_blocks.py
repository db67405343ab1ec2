"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped: every block element becomes a line of text with its character references
   decoded and white space made one space. Lines that say they are not content (scripts, styles,
   menus, page headers, footers, asides, forms, hidden elements, elements named as adverts, notices,
   sidebars or comments) become empty lines; lines that are mostly links count as length 0.
2. Text lengths are summed over windows of ``WINDOW`` lines. ``WINDOW`` lines of length 0 are a valley, and
   parts between valleys rise and fall by themselves. In each, the surge point is the first line whose window, looking
   ahead, reaches ``SURGE`` characters: short lines that stand in a row before the text, such as a menu without
   markup, do not belong to it. The dive point is where the windows fall to 0, since texts end in short lines, too.
3. The text between surge and dive is kept, lines of links among it; where no window of the page reaches ``SURGE``, the part
   with most text is kept whole. Article and main elements add weight: every line of theirs
   counts as risen, and their share of the text of the page, times ``MARK * SURGE`` characters, is
   added to the highest window of each part with such lines. So short parts of an article that is most of the page are kept,
   while a teaser in an article element beside a long text has to rise like any other, and the long
   text is kept too.

Where a page marks its article and names what is not content, as the given pages do, the marks settle
the result; the windows settle it on pages without such marks.

Single lines of length 0, such as an advert between two paragraphs, lie inside a window with text and do not
end it. Nothing between surge and dive is dropped except what says it is not content.

Defined cases: null or empty html has an empty text; pages cut off in the middle of an element, a tag
or a character reference are read as far as they go; unclosed elements end where the next of their
kind must begin; an article ends any unclosed menu, but one inside a closed menu, aside or footer is part of it; repeated rows get equal results; columns of the
input stay, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, SURGE = 3, 80
MARK = 2  # an article that is half of the page's text keeps all its stretches
LINK_SHARE = 0.5
# --- fixed values: element and attribute names -----------------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol option p pre section select summary table tbody tfoot thead title tr ul".split())
NOT_CONTENT = frozenset("nav footer aside form head menu noscript iframe button select textarea dialog object svg canvas template".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")
NAMED = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related "
    "recommended widget toolbar pagination pager copyright disclaimer skip search header topbar".split())
OF_ARTICLES = frozenset("header".split())  # not content, unless inside an article
CLOSED = frozenset("nav footer aside menu dialog".split())  # no article inside them is the main one
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
ENDS_ITSELF = frozenset("p li dt dd option tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# ---------------------------------------------------------------------------------------------------
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z""", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_CONTENT or tag in OF_ARTICLES and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        if tag != "article" or not attributes:
            return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            parts = {p.lower() for p in _NAME_PART.findall(value)}
            if parts & NAMED - (OF_ARTICLES if in_article else frozenset()):
                return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _ends(page: str, at: int, tag: str, n: int) -> bool:
    """Whether the outermost of ``n`` open elements is closed after ``at``."""
    for found in re.compile(rf"<(/?){tag}\b", re.I).finditer(page, at):
        n += -1 if found[1] else 1
        if not n:
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, mostly links) of every line; the text is empty where the line is not content."""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    linked = articles = 0
    in_link = False
    outer: tuple[str, int] | None = None  # the element that is not content, and how many of its kind are open
    ends: bool | None = None  # whether that element is closed, once it matters
    inner = 0  # open articles inside it

    def close() -> None:
        nonlocal linked
        raw = "".join(text)
        text.clear()
        line = " ".join(references.unescape(raw).split())
        if line:
            links = linked > LINK_SHARE * len(raw)
            out.append(("" if outer else line, articles > 0, links and not articles))
        linked = 0

    at = 0
    while True:
        found = _TAG.search(page, at)
        piece = page[at : found.start() if found else len(page)]
        if piece:
            text.append(piece)
            linked += len(piece) if in_link else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = found[1] == "/"
        if tag == "a":
            in_link = not closing
        elif tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if tag in RAW and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        content = tag in ("article", "main")
        if tag not in BLOCKS and not (outer and outer[0] == tag):
            if not closing and outer is None and tag not in VOID and found[3] and _unwanted(tag, found[3], articles > 0):
                close()
                outer, ends, inner = (tag, 1), None, 0
            continue
        close()
        if closing:
            if outer and outer[0] == tag:
                outer = (tag, outer[1] - 1) if outer[1] > 1 else None
            elif content and outer and inner:
                inner -= 1
            elif content:
                articles = max(0, articles - 1)
            continue
        if outer and outer[0] == tag and tag not in ENDS_ITSELF:
            outer = (tag, outer[1] + 1)
            continue
        if outer and outer[0] in ENDS_ITSELF:
            outer = None
        unwanted = _unwanted(tag, found[3], articles > 0)
        if content and outer and outer[0] in CLOSED and ends is None:
            ends = _ends(page, at, *outer)
        if content and outer and (unwanted or outer[0] in CLOSED and ends):
            inner += 1
        elif content and not unwanted:
            articles, outer = articles + 1, None
        elif outer is None and unwanted and tag not in VOID:
            outer, ends, inner = (tag, 1), None, 0
    close()
    return out


def stretches(lengths: list[int], marked: list[bool]) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window) of each part between valleys; lines surge to dive - 1 are inside. A part whose windows
    stay below ``SURGE`` and that has no marked line is given whole."""
    parts, begin, last = [], None, None
    for i, n in enumerate(lengths):
        if begin is not None and i - last >= WINDOW and not n:
            parts.append((begin, last + 1))
            begin = None
        if n:
            begin, last = i if begin is None else begin, i
    if begin is not None:
        parts.append((begin, last + 1))
    out = []
    for begin, end in parts:
        ahead = [sum(lengths[i : min(i + WINDOW, end)]) for i in range(begin, end)]
        surge = next((i for i in range(begin, end) if marked[i] or lengths[i] and ahead[i - begin] >= SURGE), begin)
        out.append((surge, end, max(ahead)))
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    lengths = [0 if linked else len(t) for t, _, linked in lines]
    marked = [bool(n) and inside for n, (_, inside, _) in zip(lengths, lines, strict=True)]
    weight = MARK * SURGE * sum(n for n, m in zip(lengths, marked, strict=True) if m) / max(1, sum(lengths))
    added = lambda s: weight if any(marked[s[0] : s[1]]) else 0
    found = stretches(lengths, marked)
    high = [s for s in found if s[2] + added(s) >= SURGE]
    found = high or sorted(found, key=lambda s: -sum(lengths[s[0] : s[1]]) - added(s))[:1]
    return "\n".join(lines[i][0] for surge, dive, _ in found for i in range(surge, dive) if lines[i][0])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; the html column is not kept."""
    kept = [f for f in pages.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(p) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*part.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars bigint"])
    return pages.select(*[f"`{f.name}`" for f in kept], f"`{html}`").mapInArrow(run, schema)
