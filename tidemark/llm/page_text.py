"""Main text of web pages by differencing each page with the pages next to it by URL.

1. Every page becomes its text lines: the text of each block-level element, with character references decoded and white
   space made one space. A line knows whether it stands in a part that cannot be the article (menus, headers, footers,
   sidebars, forms, notices, adverts, reader comments: by element, role, or a word of the class or id), in a part that says it
   is the article, or in neither. A box of the layout whose longer class name holds such a word ("right-sidebar") is no such part
   if the article is in it. Scripts, styles and other unseen elements give no lines.
2. Pages are sorted by host and URL path (numbers in a path by value) with a range partitioning, so one host may span
   any number of tasks. Each page is paired with its neighbours of the same host.
3. The lines of a pair are aligned by longest common subsequence. Shared lines are deleted: they are the host's frame. A
   neighbour that shares nearly all lines is a copy of the page and tells nothing about the frame; it is passed over.
4. The check that follows: a shared line that stands in the article is put back (articles quote each other), and a line of a part
   that cannot be the article goes even if no neighbour has it.

What is left is joined by one space. A page at the edge of a range of URLs is paired with the neighbour on its own side only.
Null html is an empty page, a null url has no host and no neighbours; both keep their row. Repeated ids or urls are pages
of their own (and copies of each other). Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Names of the HTML standard.
UNSEEN = {"script", "style", "template", "svg", "select", "button", "textarea", "iframe", "noscript", "title", "object", "canvas", "math"}
FOREIGN = {"svg", "math"}  # may close themselves, and end before an element of the page if they are never closed
LOOSE = {"button", "select", "object", "canvas"}  # what follows is seen: if never closed they end before an element of the page
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog"}
ARTICLE = {"article", "main"}
BOXES = FRAME | ARTICLE | {"header", "section", "div", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "fieldset", "address"}
BLOCKS = BOXES | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "br",
    "figcaption", "body", "html", "summary", "legend", "center",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# Words of classes, ids and roles that name parts of a page.
FRAME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup",
    "promo", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "topbar", "widget",
}
ARTICLE_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}

#: Parts that hold articles other than the page's own.
LISTS = {
    "comment", "comments", "disqus", "promo", "recommended", "related", "replies", "reply", "sponsor", "sponsored", "teaser", "widget",
}

#: In a name such as "with-sidebar", what follows is not the element itself.
OF_OTHERS = {"with", "has", "no", "is", "not", "without"}

REST_OF_TAG = r"""((?:[^<>"']++|"[^"]*"|'[^']*')*+)>"""  # possessive, and ends at a "<": broken markup costs no second look
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*+){REST_OF_TAG}", re.S)
NAMING = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[a-z]+").findall


UNQUOTED_END = re.compile(r"=\s*[^\s\"'=]+/$")  # the slash belongs to the value


class Line(NamedTuple):
    text: str
    frame: bool
    article: bool


def named_words(attributes: str, whole: bool = False) -> set[str]:
    """The words of an element's classes, id and roles; with ``whole`` only names that are one word."""
    out: set[str] = set()
    for found in NAMING.finditer(attributes or ""):
        for name in (found[2] or found[3] or found[4] or "").split():
            words = WORDS(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if words and words[0] not in OF_OTHERS and not (whole and len(words) > 1):
                out.update(words)
    return out


class UnseenEnds:
    """Where the unseen elements of a page end. The tags of a name are paired in one pass, when the first of them is met."""

    def __init__(self, html: str):
        self.html, self.closing, self.paired = html, {}, {}

    def pairs(self, name: str) -> dict[int, int]:
        """The end of an element by the end of its opening tag. A button or select ends where the next one opens."""
        found, opened = {}, []
        tags = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({name})(?=[\s/>]){REST_OF_TAG}", re.S | re.I)
        for tag in tags.finditer(self.html):
            if not tag[2] or tag[3].endswith("/") and name in FOREIGN and not UNQUOTED_END.search(tag[3]):
                continue
            if not tag[1]:
                if opened and name in ("button", "select"):
                    found[opened.pop()] = tag.start()
                opened.append(tag.end())
            elif opened:
                found[opened.pop()] = tag.end()
        return found

    def end(self, at: int, name: str, attributes: str) -> int:
        """Where an unseen element ends whose opening tag ends at ``at``."""
        if name in FOREIGN and attributes.endswith("/") and not UNQUOTED_END.search(attributes):
            return at
        if name in FOREIGN | LOOSE:
            if name not in self.paired:
                self.paired[name] = self.pairs(name)
            end = self.paired[name].get(at)
            if end is None:
                blocks = (tag.start() for tag in TAG.finditer(self.html, at) if (tag[2] or "").lower() in BLOCKS)
                end = next(blocks, len(self.html))
            return end
        if name not in self.closing:
            self.closing[name] = [m.end() for m in re.finditer(rf"</{re.escape(name)}\s*>", self.html, re.I)]
        ends = self.closing[name]
        after = bisect_left(ends, at + len(name) + 3)
        return ends[after] if after < len(ends) else len(self.html)


def page_lines(html: str | None) -> list[Line]:
    """The lines of a page in order."""
    lines: list[tuple[Line, list[int]]] = []  # with the numbers of the boxes that frame it unless the article is in them
    open_boxes: list[tuple[str, bool, bool, bool, int]] = []  # name, frame, article, heading only, number if the article lifts its mark
    lifted: set[int] = set()
    boxes = 0
    pieces: list[str] = []
    own_frame, inline, heading = False, "", False

    def end_line() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            frame = own_frame or any(b[1] for b in open_boxes) or (not heading and any(b[3] for b in open_boxes))
            lines.append((Line(text, frame, any(b[2] for b in open_boxes)), [b[4] for b in open_boxes if b[4]]))

    html = html or ""
    at, unseen = 0, UnseenEnds(html)
    while True:
        found = TAG.search(html, at)
        if not inline:
            pieces.append(html[at : found.start() if found else len(html)])
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if name in UNSEEN and not closing:
            at = unseen.end(at, name, found[3])
            continue
        if name == "head":  # what it holds is unseen by itself, and its end may be left out
            continue
        if name not in BLOCKS:
            if closing and name == inline:
                inline = ""
            elif not closing and not inline and name not in VOID and found[3] and (
                named_words(found[3]) & FRAME_WORDS or HIDDEN.search(found[3])
            ):
                inline = name
            continue
        end_line()
        inline = ""
        if closing:
            own_frame = heading = False
            if name in BOXES and any(b[0] == name for b in open_boxes):
                while open_boxes.pop()[0] != name:
                    pass
            continue
        words = named_words(found[3], whole=name in ARTICLE)
        frame = bool(words & (FRAME_WORDS - {"header"})) or bool(found[3] and HIDDEN.search(found[3]))
        heading = name in HEADINGS
        if name in BOXES:
            article = name in ARTICLE or bool(words & ARTICLE_WORDS)
            inside = article or any(b[2] for b in open_boxes)
            header = name == "header" or "header" in words  # inside the article, its headings belong to the article
            framed = name in FRAME or frame or (header and not inside)
            single = named_words(found[3], whole=True) & FRAME_WORDS
            wrapper = framed and name not in FRAME | ARTICLE | {"header"} and not (single or words & LISTS or HIDDEN.search(found[3]))
            if name in ARTICLE and not framed and not any(b[1] for b in open_boxes):
                lifted.update(b[4] for b in open_boxes)
            boxes += 1
            open_boxes.append((name, framed and not wrapper, article, header and inside, boxes if wrapper else 0))
            own_frame = False
        else:
            own_frame = frame and name not in ("body", "html")
    end_line()
    return [Line(x.text, x.frame or not lifted.issuperset(marks), x.article) for x, marks in lines]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence: the longest increasing run of matches."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(start), *range(len(a) - tail, len(a))}
    places = defaultdict(list)
    for j in range(len(b) - tail - 1, start - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(start, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        found.add(chain[0])
        chain = chain[1]
    return found


def main_text(lines: list[Line], neighbours: list[list[Line]], copy_share: float = 0.9) -> str:
    """The text of a page, given its neighbours; see the module's text."""
    texts = [line.text for line in lines]
    inner = [i for i, line in enumerate(lines) if not line.frame]
    size = sum(len(texts[i]) for i in inner)
    shared: set[int] = set()
    for other in neighbours:
        common = common_lines(texts, [line.text for line in other])
        if sum(len(texts[i]) for i in inner if i in common) < copy_share * size:
            shared |= common
    return " ".join(texts[i] for i in inner if i not in shared or lines[i].article)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The path without query, fragment, file ending or final slash; numbers are padded so that they sort by value."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"(\.[a-zA-Z]+)?/*$", "")
    padded = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"^[0-9]{1,18}$"), F.lpad(s, 18, "0")).otherwise(s))
    return F.concat_ws("/", padded)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"),
    )
    order = ["host", "path", "url", "page_id"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        held: list[tuple] = []  # the page before, this page, as (host, page_id, url, lines)

        def written(after: tuple | None) -> tuple:
            page = held[-1]
            others = [p for p in (held[0] if len(held) > 1 else None, after) if p and p[0] and p[0] == page[0]]
            text = main_text(page[3], [p[3] for p in others])
            return page[1], page[2], text, len(text)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = []
                for page_id, url, html, host in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns)):
                    page = host, page_id, url, page_lines(html)
                    if held:
                        out.append(written(page))
                    held[:] = [*held[-1:], page]
                if out:
                    yield packed(out)
        if held:
            yield packed([written(None)])

    return ordered.select("page_id", "url", "html", "host").mapInArrow(run, SCHEMA)
