"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element.  Text lengths are summed over
sliding windows of lines; where the sum surges above a threshold the main text
begins, where it dives below it the text ends.  Every such stretch stays, short
lines included, and so do lines with a weight between two stretches.

Lines weigh their own text without link text.  Where an <article> or <main> holds
text, only lines in such elements weigh, each their whole text, and windows end
at the element's edges: an element in which the sum surges is kept whole, from
edge to edge, and one in which it never does (a teaser beside the article) goes.

Elements that are boilerplate by name or by class, id or role are left out while
stripping, so their lines are not seen at all.  One left out by name that is never
closed is read as an ordinary block, and so is a <form> round a whole page (one
that holds h1, nav, header, footer, article or main).  A page whose lines never
reach the threshold takes its largest sum for it; a page without text gives ''.

Null html counts as empty; each row gets one row; only page_id, url and html are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import frugal

WINDOW = 3
THRESHOLD = 60

# Element names and attribute words.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("aside button datalist dialog footer form head header iframe label menu nav noscript object select svg template".split())
RAW = ("script", "style", "textarea", "title")
WHOLE = frozenset(("article", "main"))
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split()
)

HOLDERS = frozenset("area articles bar block box buttons container form group inner item items left links list panel posts right section slot stories unit widget wrap wrapper".split())
CONTENT = frozenset("article body content entry main post story text".split())
REMARKS = frozenset("comment comments disqus replies reply respond".split())

# As browsers read them: a quote opens a value only after "=", and values may hold ">".
_ATTRS = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+"
# One pass over comments, declarations, raw text and tags, whichever comes first.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?![A-Za-z0-9:-]){_ATTRS}>.*?(?:</(?P=raw)(?![A-Za-z0-9:-])[^>]*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>{_ATTRS})>",
    re.S | re.I,
)
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADER_END = re.compile("</header", re.I)
_HEADING = re.compile(r"<h[1-6](?![0-9A-Za-z])", re.I)
_FORM_END = re.compile(r"</form", re.I)
_PAGE_PART = re.compile(r"<(?:h1|nav|header|footer|article|main)(?![0-9A-Za-z-])", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def says_boilerplate(token: str, whole: bool) -> bool:
    """Whether a class, id or role names boilerplate: the word itself, a name that
    ends in one ("site-footer"), or one that holds a list or box of them
    ("share-buttons", but not "share-of-market")."""
    parts = [p.lower() for p in _PART.findall(token)]
    if not parts:
        return False
    held = parts[-1] in HOLDERS
    if parts[-1] in REMARKS or (parts[0] in REMARKS and (held or parts[-1] in CONTENT)):
        return True
    return not whole and not CONTENT.intersection(parts) and (parts[-1] in BOILERPLATE or (parts[0] in BOILERPLATE and held))


def boilerplate(name: str, attrs: str) -> bool:
    if name in LEFT_OUT:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if _HIDDEN.search(attrs):
        return True
    tokens = [t for m in _MARKS.finditer(attrs) for t in (m[1] or m[2] or m[3] or "").split()]
    return any(says_boilerplate(t, name in WHOLE) for t in tokens)


def unclosed(tokens: list[re.Match]) -> set[int]:
    """Where the elements left out by name start that are never closed."""
    opened: dict[str, list[int]] = {}
    for m in tokens:
        name = (m["name"] or "").lower()
        if name in LEFT_OUT and not m["attrs"].endswith("/"):
            at = opened.setdefault(name, [])
            if not m["close"]:
                at.append(m.start())
            elif at:
                at.pop()
    return {x for at in opened.values() for x in at}


def text_lines(html: str) -> tuple[list[str], list[int], list[int]]:
    """One line a block, its weight, and the number of the outermost <article> or
    <main> that holds it (0: none)."""
    page, tokens = html, list(_TOKEN.finditer(html))
    lines: list[str] = []
    weights: list[int] = []
    own: list[str] = []
    homes: list[int] = []
    linked = inside = link = home = 0
    skip, depth = "", 0
    never: set[int] | None = None

    def left_out(m: re.Match, name: str) -> bool:
        nonlocal never
        if not boilerplate(name, m["attrs"]):
            return False
        if name not in LEFT_OUT:
            return True
        if never is None:
            never = unclosed(tokens)
        if m.start() in never:
            return False
        if name == "form":
            end = _FORM_END.search(page, m.end())
            return not _PAGE_PART.search(page, m.end(), end.start() if end else len(page))
        return True

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(own)).split())
        own.clear()
        if text:
            lines.append(text)
            weights.append(len(text) if inside else max(0, len(text) - linked))
            homes.append(home if inside else 0)
        linked = 0

    at = 0
    for m in tokens:
        if not skip and m.start() > at:
            part = page[at : m.start()]
            own.append(part)
            if link:
                linked += len(part)
        at = m.end()
        if m["raw"]:
            own.append(" ")
        if not m["name"]:
            continue
        close, name, attrs = bool(m["close"]), m["name"].lower(), m["attrs"]
        if name == "header" and inside and not skip and not boilerplate("", attrs):
            end = _HEADER_END.search(page, at)
            if close or _HEADING.search(page, at, end.start() if end else len(page)):  # the article's own title
                flush()
                continue
        if skip:
            if not close and skip != name and name in WHOLE and skip not in LEFT_OUT:
                skip = ""  # an unclosed box doesn't swallow the article
            elif not close and skip == "p" and name in BLOCKS:
                skip = ""  # any block ends a paragraph
            else:
                if name == skip and not attrs.endswith("/"):
                    depth += -1 if close else 1
                if depth <= 0:
                    skip = ""
                continue
        if not close and name not in VOID and not attrs.endswith("/") and left_out(m, name):
            if name in BLOCKS:
                flush()
            skip, depth = name, 1
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            own.append(" ")
        if name == "a":
            link = 0 if close else 1
        if name in WHOLE:
            home += not inside and not close
            inside = max(0, inside + (-1 if close else 1))
    if not skip:
        own.append(page[at:])
    flush()
    if any(homes):
        weights = [w if h else 0 for w, h in zip(weights, homes, strict=True)]
    return lines, weights, homes


def main_lines(weights: list[int], homes: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[int]:
    """The lines of the main text.  On a page without homes: all of each stretch, and
    what weighs between; else all lines of each home that a stretch lies in."""
    n = len(weights)
    if not any(weights):
        return []
    half = window // 2
    sums = [sum(weights[k] for k in range(max(0, i - half), min(n, i + half + 1)) if homes[k] == homes[i]) for i in range(n)]
    limit = min(threshold, max(sums))
    stretches: list[tuple[int, int]] = []
    start = None
    for i in range(n + 1):
        up = i < n and sums[i] >= limit
        if up and start is None:
            start = i
        elif not up and start is not None:
            lo, hi = start, i
            while lo < hi and not weights[lo]:  # a window reaches past the text's own edge
                lo += 1
            while hi > lo and not weights[hi - 1]:
                hi -= 1
            if lo < hi:
                stretches.append((lo, hi))
            start = None
    held = {homes[i] for lo, hi in stretches for i in range(lo, hi)} - {0}
    if held:
        return [i for i, h in enumerate(homes) if h in held]
    kept: list[int] = []
    for lo, hi in stretches:
        between = range(kept[-1] + 1, lo) if kept else ()
        kept += [k for k in between if weights[k]]
        kept += range(lo, hi)
    return kept


def main_text(html: str | None) -> str:
    lines, weights, homes = text_lines(html or "")
    return "\n".join(lines[i] for i in main_lines(weights, homes))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
