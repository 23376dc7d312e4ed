"""Main text of web pages: subtrees that recur on many pages of a host are removed, then what is no article."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import packed
from salescope.plans.session import ship_package, written

#: A subtree is a template if it stands on so many different pages of its host, and on such a share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.01

# Fixed values of HTML: elements without content, with raw text, that end a paragraph, and that close their like.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " tbody tfoot thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "thead": {"tbody", "tfoot"}, "tbody": {"thead", "tbody"},
    "tfoot": {"tbody"},
}
BOUND = set("table ul ol dl select body html article div section".split())

#: Elements, and words of their class, id or role, that hold no main text.
NO_TEXT_TAGS = set("nav footer aside form button select dialog menu head object canvas audio video label".split())
NO_TEXT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination sidebar side"
    " footer masthead toolbar comment comments reply replies disqus share sharing social related recommended newsletter"
    " subscribe subscription signup login search contentinfo complementary widget widgets".split()
)

#: Ids of these are anchors that text is linked by; only class and role tell what they are.
ANCHORED = set("p h1 h2 h3 h4 h5 h6 hgroup section article blockquote figure pre table ul ol li dl dt dd".split())

#: A recurring subtree in an article is a template only if it holds less than this share of the article's text.
MOST_OF_ARTICLE = 0.5

# As the HTML tokenizer has it, a quote opens a value only right after a "="; elsewhere it is a letter like any other.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=>)|[^\s>\"'][^\s>]*+)"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+\s*+(?:{_VALUE})?+)*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+")

#: A compound name with one of these tells of something else, as in has-sidebar or no-ads.
ABOUT_OTHERS = set("has with without no not is hide hides show shows".split())
#: In an article, these are its own text unless they carry a class, id or role: they may recur.
PLAIN = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd".split())


@dataclass
class Element:
    tag: str
    parent: int
    start: int
    end: int = -1
    no_text: bool = False
    by_part: bool = False  # only a part of a compound name says that it holds no text
    named: bool = False  # has a class, id or role
    in_article: bool = False
    holds_article: bool = False
    article: int = -1  # the innermost article around it


@dataclass
class Page:
    source: str
    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (innermost element, text)

    def chain(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.elements[i].parent


def _tells(name: str) -> bool:
    """Whether a part of a compound name, as in ad-banner or comment_list, is one of NO_TEXT_WORDS."""
    parts = _PARTS.split(name)
    return len(parts) > 1 and not NO_TEXT_WORDS.isdisjoint(parts) and ABOUT_OTHERS.isdisjoint(parts)


def parse(source: str | None) -> Page:
    """The elements of a page and its blocks of text; unclosed and misnested tags are put right as browsers do.

    A tag that the end of the page cuts off is dropped. Comments, scripts and other raw text leave nothing.
    """
    source = source or ""
    page = Page(source)
    stack: list[int] = []
    held: list[str] = []
    at, articles = 0, 0

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            page.blocks.append((stack[-1] if stack else -1, text))

    def close(depth: int, end: int) -> None:
        while len(stack) > depth:
            page.elements[stack.pop()].end = end

    def find(tags: set[str], bound: set[str]) -> int | None:
        for depth in range(len(stack) - 1, -1, -1):
            tag = page.elements[stack[depth]].tag
            if tag in tags:
                return depth
            if tag in bound:
                return None
        return None

    while True:
        begin = source.find("<", at)
        if begin < 0:
            held.append(source[at:])
            break
        held.append(source[at:begin])
        found = _TAG.match(source, begin)
        if not found:
            if re.match(r"</?[a-zA-Z]", source[begin : begin + 3]):
                break
            held.append("<")
            at = begin + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            depth = find({tag}, {"table"} if tag not in BLOCK else set())
            if tag in BLOCK:
                flush()
            if depth is not None:
                close(depth, at)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            if found[3].endswith("/") and tag in ("svg", "math"):
                continue
            if not closing:
                break
            after = source.find(">", closing.start())
            at = len(source) if after < 0 else after + 1
            continue
        if tag in BLOCK:
            flush()
            depth = find({"p"}, BOUND)
            if depth is not None:
                close(depth, begin)
        elif tag in ("br", "td", "th", "option"):
            held.append(" ")
        if tag in CLOSES:
            depth = find(CLOSES[tag], BOUND - CLOSES[tag])
            if depth is not None:
                close(depth, begin)
        if tag in VOID:
            continue
        parent = page.elements[stack[-1]] if stack else None
        names = _NAMES.findall(found[3]) if found[3] else ()
        told = {a.lower(): n.strip("\"'").lower().split() for a, n in names}
        words = {w for a, n in told.items() if a != "id" or tag not in ANCHORED for w in n}
        in_article = bool(parent and parent.in_article)
        named = tag not in ("html", "body", "main") and (tag != "article" or in_article or articles > 0)
        here = len(page.elements)
        page.elements.append(Element(
            tag, stack[-1] if stack else -1, begin, in_article=in_article or tag == "article",
            no_text=tag in NO_TEXT_TAGS or tag == "header" and not in_article or named and not words.isdisjoint(NO_TEXT_WORDS),
            by_part=named and any(_tells(w) for w in words), named=bool(told),
            article=here if tag == "article" else parent.article if parent else -1,
        ))
        stack.append(here)
        if tag == "article":
            articles += 1
            for i in reversed(stack[:-1]):
                if page.elements[i].holds_article:
                    break
                page.elements[i].holds_article = True
    flush()
    close(0, len(source))
    return page


def hashes(page: Page) -> list[int]:
    """A hash of each element's source, white space aside: of its own pieces of it and the hashes of its children."""
    parts: list[list[bytes]] = [[] for _ in page.elements]
    reached = [e.start for e in page.elements]
    order: list[list[int]] = [[] for _ in page.elements]
    for i, e in enumerate(page.elements):
        if e.parent >= 0:
            order[e.parent].append(i)
    out = [0] * len(page.elements)
    for i in range(len(page.elements) - 1, -1, -1):
        e = page.elements[i]
        for c in order[i]:
            parts[i] += [_SPACE.sub(" ", page.source[reached[i] : page.elements[c].start]).encode("utf-8", "replace"), out[c].to_bytes(8, "little")]
            reached[i] = max(reached[i], page.elements[c].end)
        parts[i].append(_SPACE.sub(" ", page.source[reached[i] : e.end]).strip().encode("utf-8", "replace"))
        out[i] = xxhash.xxh3_64_intdigest(b"\0".join(parts[i]))
        parts[i] = []
    return out


def subtrees(page: Page) -> dict[int, tuple[int, int]]:
    """(hash, hash of the article around it, or 0) of each element that may be a template: not the article and nothing around it.

    Inside the article these are block elements, except plain paragraphs, headings and lists, which are its own text.
    """
    out, every = {}, hashes(page)
    for i, e in enumerate(page.elements):
        if e.holds_article or e.tag in ("html", "body", "head", "main", "article"):
            continue
        if not e.in_article or e.tag in BLOCK and (e.named or e.tag not in PLAIN):
            out[i] = every[i] - (1 << 63), every[e.article] - (1 << 63) if e.in_article else 0
    return out


def main_text(source: str | None, templates: set[int]) -> str:
    """The blocks of a page's main text. ``templates`` are hashes of subtrees that recur on its host."""
    page = parse(source)
    found = {i for i, (h, _) in subtrees(page).items() if h in templates} if templates else set()
    size = [0] * len(page.elements)
    if found:
        for inner, text in page.blocks:
            if inner >= 0:
                size[inner] += len(text)
        for i in range(len(size) - 1, -1, -1):
            if page.elements[i].parent >= 0:
                size[page.elements[i].parent] += size[i]
    landmark = next((t for t in ("article", "main") if any(e.tag == t for e in page.elements)), None)
    around = [False] * len(page.elements)
    for i in range(len(page.elements) - 1, -1, -1):
        e = page.elements[i]
        around[i] = around[i] or e.tag == landmark
        if around[i] and e.parent >= 0:
            around[e.parent] = True
    gone, inside = [False] * len(page.elements), [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        template = i in found and (not e.in_article or size[i] < MOST_OF_ARTICLE * size[e.article])
        # A compound name around the article is that of a layout, not of what is in it.
        own = template or e.no_text or e.by_part and not around[i]
        gone[i] = own or e.parent >= 0 and gone[e.parent]
        inside[i] = e.tag == landmark or e.parent >= 0 and inside[e.parent]
    kept = [text for inner, text in page.blocks if inner < 0 and not landmark or inner >= 0 and not gone[inner] and (inside[inner] or not landmark)]
    return "\n".join(kept)


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, templates): the hashes of subtrees that recur across pages of the host.

    Pages with the same source count once, so copies of a page make no template of its text; so do pages with the same article
    for what is in it, so a story that many pages bring stays. Counts add up on the map side; a large host is no hot
    key, as the counting key is host and subtree.
    """
    ship_package(pages.sparkSession)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, source in zip(batch["host"], batch["html"]):
                whole = xxhash.xxh3_64_intdigest(source) - (1 << 63)
                rows += [(host, article or whole, h) for h, article in set(subtrees(parse(source)).values())]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "page", "subtree"])

    sent = pages.select("host", F.coalesce("html", F.lit("")).alias("html"))
    seen = sent.mapInPandas(emit, "host string, page long, subtree long").distinct()
    sizes = sent.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("page").alias("n"))
    counted = seen.groupBy("host", "subtree").agg(F.count("page").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    many = counted.join(sizes, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("n"))
    return many.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(row, text) for every page, ``row`` with all its columns: the main text, its blocks joined by line breaks.

    Subtrees that recur on the host go first, in articles all but plain paragraphs, headings and lists, then navigation, forms, adverts and the like by what they are; if the
    page marks an article, or else a main part, the rest outside it goes too. Null html is empty: no text. Pages
    without a readable host are counted together. Repeated pages give equal texts. No pages: no rows.
    """
    ship_package(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce("row.url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = packed(pages).withColumn("host", host)
    templates = written(host_templates(rows.select("host", "row.html")), "page-templates")

    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, found in parts:
            yield pd.Series([main_text(s, set() if t is None else set(t)) for s, t in zip(sources, found)], dtype=object)

    # Templates are read from a table of known size: the planner copies it to all tasks if it is small, else joins by host.
    joined = rows.join(templates, "host", "left")
    return joined.select("row", texts(F.col("row.html"), F.col("templates")).alias("text"))
