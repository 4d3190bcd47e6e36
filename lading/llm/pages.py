"""Operator 6: main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import ship

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
SKIP = frozenset("script style noscript template iframe svg math nav header footer aside form button select option menu dialog head title textarea object canvas audio video fieldset label input xmp noembed noframes".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split()
)
CLOSES_P = BLOCK - {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role of elements that are not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|combx|comments?|commentlist|community|consent|contact|cookies?|disqus|disclaimer|footer|footnote-nav|gdpr|header|login|masthead|menu|meta-nav|modal|nav|navbar|navigation|newsletter|notice|outbrain|pager|pagination|popup|promo|promoted|recommended|related|replies|reply|respond|rss|share|sharing|shoutbox|sidebar|skip|skyscraper|social|sponsor|sponsored|subscribe|subscription|taboola|teaser|toolbar|warning|widget)(?:$|[\s_-])",
    re.I,
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
COMMENT = re.compile(r"<!--.*?(?:--!?>|\Z)", re.S)
DECLARATION = re.compile(r"<[!?][^>]*>")
#: No part of these gives back what it has taken, so each try is linear in what it reads.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
TAG_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)([^>]*+)>")
#: Characters within which quotes of a tag are heeded; a longer tag ends at its first ``>``. Levels that a start tag looks up
#: for an element that it closes.
MOST_TAG, MOST_LEVELS = 4096, 256
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "parent", "items", "score", "chars", "linked")

    def __init__(self, tag: str, noise: bool, parent: Node | None):
        self.tag, self.noise, self.parent = tag, noise, parent
        self.items: list = []  # pieces of text and nodes, in page order
        self.score = 0.0
        self.chars = self.linked = 0


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in SKIP:
        return True
    if tag in ("body", "html", "article", "main") or not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in NOISE_ROLE:
            return True
        if name in ("class", "id") and NOISE.search(value):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of elements and text; unclosed paragraphs and list items end where a block begins. Time is linear in the page,
    whatever its markup: tags that never end are text, and end tags without a start are known by a count."""
    root = here = Node("#root", False, None)
    at, n, last = 0, len(page), page.rfind(">")
    open_: dict[str, int] = {}

    def leave(up: Node) -> Node:
        """Closes everything up to and with ``up``."""
        x = here
        while x is not up.parent:
            open_[x.tag] -= 1
            x = x.parent
        return x

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.items.append(page[at:])
            break
        if lt > at:
            here.items.append(page[at:lt])
        skipped = COMMENT.match(page, lt) or (DECLARATION.match(page, lt) if lt < last else None)
        if skipped:
            at = skipped.end()
            continue
        m = (TAG.match(page, lt, lt + MOST_TAG) or TAG_LOOSE.match(page, lt)) if lt < last else None
        if m is None:  # a bare "<"
            here.items.append("<")
            at = lt + 1
            continue
        at = m.end()
        close, tag, attributes = m.groups()
        tag = tag.lower()
        if close:
            if open_.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up)
            elif tag in BLOCK:
                here.items.append(Node("br", False, here))
            continue
        if tag in CLOSES_P:
            up, levels = here, 0
            while up is not root and (levels := levels + 1) < MOST_LEVELS and up.tag not in ("p", "td", "th", "li", "article", "section", "div", "main", "body", "table", "button", *HEADINGS):
                up = up.parent
            if up.tag == "p" or (tag in HEADINGS and up.tag in HEADINGS):
                here = leave(up)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            up, levels = here, 0
            while up is not root and (levels := levels + 1) < MOST_LEVELS and up.tag not in same and up.tag not in ("ul", "ol", "dl", "table", "select", "tbody", "thead", "div", "article", "section", "body"):
                up = up.parent
            if up.tag in same:
                here = leave(up)
                if tag == "tr" and up.tag != "tr" and here.tag == "tr":
                    here = leave(here)
        node = Node(tag, _is_noise(tag, attributes), here)
        here.items.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node``, without what is not the article."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list = [(node, 0)]
    while stack:
        at, k = stack.pop()
        if k == 0 and at.tag in BLOCK:
            flush()
        items = at.items
        while k < len(items):
            x = items[k]
            k += 1
            if isinstance(x, str):
                now.append(x)
            elif x.noise:
                if x.tag in BLOCK:
                    flush()
            elif x.tag == "br":
                now.append(" ")
            elif x.items or x.tag in BLOCK:
                stack.append((at, k))
                stack.append((x, 0))
                break
        else:
            if at.tag in BLOCK:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    """Paragraphs pass points for length and commas to their parent and half of them to the grandparent; a container's
    points are discounted by its share of link text. The best container is kept with those siblings that score near it or
    are paragraphs of few links; then up to the enclosing article or main, if any."""
    if not page:
        return ""
    root = parse(page)
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(y for y in x.items if isinstance(y, Node) and not y.noise)
    for x in reversed(order):
        own = sum(len(y.strip()) for y in x.items if isinstance(y, str))
        x.chars = own + sum(y.chars for y in x.items if isinstance(y, Node) and not y.noise)
        x.linked = x.chars if x.tag == "a" else sum(y.linked for y in x.items if isinstance(y, Node) and not y.noise)
        if (x.tag in ("p", "pre", "td", "blockquote", "li", *HEADINGS) or (x.tag in ("div", "section", "article", "body", "main") and own > 0)) and x.chars:
            commas = sum(y.count(",") for y in x.items if isinstance(y, str))
            points = (1 + min(x.chars / 100, 3) + commas) * (1 - x.linked / x.chars)
            for up, share in ((x.parent if x.tag in ("p", "pre", "td", "blockquote", "li", *HEADINGS) else x, 1.0), (x.parent.parent if x.parent else None, 0.5)):
                if up is not None:
                    up.score += points * share
    value = {id(x): x.score * (1 - x.linked / x.chars) if x.chars else 0.0 for x in order}
    best = max(order, key=lambda x: value[id(x)])  # the outermost of equals: parents come first
    if not value[id(best)]:
        return ""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        return "\n\n".join(_blocks(up))
    keep = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * value[id(best)])
        keep = []
        for y in best.parent.items:
            if isinstance(y, Node) and not y.noise:
                paragraph = y.tag == "p" and y.chars and y.linked / y.chars < 0.25
                if y is best or value[id(y)] >= least or paragraph or y.tag in HEADINGS:
                    keep.append(y)
    return "\n\n".join(t for y in keep for t in _blocks(y))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the html, with ``text`` and ``n_chars``. A null or empty page gives an empty text. Rows keep their
    number; repeated rows give repeated results; columns named ``text`` or ``n_chars`` are replaced."""

    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    out = pages.select(*kept, text_of(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_extract_pages(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
