"""Main-text extraction by consensus paths per host.

1. Every page is parsed and its containers are scored: characters of ordinary
   text inside, less characters of links. Parts that are no article text
   (menus, headers, footers, sidebars, notices, adverts, forms, comments) are
   dropped from the text and count nowhere. The best container is the one with
   the best score of those that hold at least ``NEARLY_ALL`` of the page's
   ordinary text; the page votes for its path, which is its tags and classes
   from the root, digits generalised. A part goes by its tag, role or style, or
   by a class or id all of whose words name such parts or say where they are
   (``site-footer``, but not ``no-header`` or ``market-share``), unless the only
   articles of the page lie in it.
2. Spark counts the votes per host and path; a host's winning paths are those
   with at least ``LEAST_SHARE`` of its votes.
3. Every page is parsed again and the text is taken from the containers on its
   host's winning paths, most votes first. A page without such a container,
   or where it holds less than ``LEAST_PART`` of the ordinary text of the
   page's best or ``NEARLY_ALL`` of that of the articles around it, takes its
   own best.

The text of a container is its blocks in page order without the parts named
above; character references are decoded, white space inside a block becomes
one space, and blocks are joined by one space.

Scale: votes combine on the map side, so a host with a third of all pages is
a few partial rows per task; the winners (a few paths per host) are broadcast
only when a probe proves them small. A task holds one page at a time, and
reads it in time proportional to its length, whatever its markup.

Defined cases: null html counts as empty and gives an empty text; a null url,
or one without ``://``, has the empty host, which votes like any other;
unclosed tags end with their parent, stray end tags are ignored, an unclosed
comment, script or style swallows the rest, a quote that is never closed is no
quote, a ``<`` without any ``>`` after it is text. Repeated rows give repeated
results. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import materialise
from martlet.llm.url_templates import url_host
from martlet.plans.joins import broadcast_if_bounded

LEAST_SHARE = 0.10
LEAST_PART = 0.25
NEARLY_ALL = 0.9

# HTML elements by the role they have here.
NOT_TEXT = frozenset("script style template noscript iframe svg canvas object video audio head title".split())
NOT_ARTICLE = frozenset("nav header footer aside form button select textarea input dialog menu".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = frozenset(("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption "
                    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary "
                    "table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
ENDS_PARAGRAPH = BLOCKS - {"br"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Words in a class or id that mark parts which are no article text.
SIDE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs comment comments reply replies disqus discussion respond footer header masthead share "
    "sharing social related recommended newsletter subscribe subscription signup login widget widgets toolbar "
    "pagination pager skip").split())

#: Words that may stand beside them in such a class or id.
NEUTRAL_WORDS = frozenset((
    "site page main post entry article blog news story area box block blocks container wrapper wrap section inner outer "
    "top bottom left right primary secondary mobile desktop list item items bar link links button buttons content panel "
    "region group row col column wide small large sticky fixed global local form text title icon icons count").split())
#: Words that name parts of an article as well, when they stand inside of one.
IN_ARTICLES = frozenset(("discussion",))

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_TAG_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _step(digest: bytes, label: str) -> bytes:
    return xxhash.xxh3_128_digest(digest + label.encode())


def path_digest(path: str) -> bytes:
    digest = b""
    for label in path.split(">")[1:]:
        digest = _step(digest, label)
    return digest


@dataclass
class Container:
    label: str
    outer: Container | None
    depth: int
    begin: int  # of its pieces
    digest: bytes = b""  # of its path
    side: int = 0  # the innermost named part around it
    end: int = 0
    good: int = 0
    links: int = 0
    article: Container | None = None  # the outermost article or main around it

    @property
    def score(self) -> int:
        return self.good - self.links

    @property
    def path(self) -> str:
        labels, c = [], self
        while c.outer is not None:
            labels.append(c.label)
            c = c.outer
        return "".join(f">{x}" for x in reversed(labels))


@dataclass
class Page:
    """Pieces of text in page order (None: a block boundary), and containers."""
    pieces: list[str | None] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)

    def best(self) -> Container:
        root = self.containers[0]
        if not root.good:  # nothing but links: as much of them as there is
            return max(self.containers, key=lambda c: (c.links, c.depth, -c.begin))
        whole = [c for c in self.containers if c.good >= NEARLY_ALL * root.good]
        return max(whole, key=lambda c: (c.score, c.depth, -c.begin))

    def text(self, containers: list[Container]) -> str:
        blocks: list[str] = []
        for c in containers:
            block: list[str] = []
            for p in [*self.pieces[c.begin:c.end], None]:
                if p is not None:
                    block.append(p)
                elif block:
                    blocks += "".join(block).split()
                    block = []
        return " ".join(blocks)


@dataclass
class _Part:
    """A part that its class or id names as no article text."""
    outer: int
    holds_article: bool = False


class _Element:
    __slots__ = ("tag", "gone", "side", "link", "inner", "paragraph", "own")

    def __init__(self, tag: str, gone: bool, side: int, link: bool, inner: Container, paragraph: int, own: bool):
        self.tag, self.gone, self.side, self.link = tag, gone, side, link
        self.inner = inner  # the innermost container around its text
        self.paragraph = paragraph  # the open <p> of that container, as a place in the stack
        self.own = own  # whether ``inner`` is the element itself


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _is_gone(tag: str, attributes: dict[str, str]) -> bool:
    """No article text by tag, role or style."""
    if tag in NOT_TEXT or tag in NOT_ARTICLE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return (attributes.get("role", "").lower() in SIDE_ROLES
            or "display:none" in attributes.get("style", "").replace(" ", "").lower())


def _is_named(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """No article text by class or id."""
    if tag in ("html", "body", "main", "article"):
        return False
    names = SIDE_WORDS - IN_ARTICLES if in_article else SIDE_WORDS
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_WORDS.findall(token))
        if not names.isdisjoint(words) and words <= names | NEUTRAL_WORDS:
            return True
    return False


def _tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags of a page: where each begins and ends, its name (empty: a comment or
    declaration), whether it is an end tag, and its attributes. The caller may
    send a place to go on from."""
    at, n = 0, len(source)
    last = {q: source.rfind(q) for q in "\"'>"}
    while True:
        m = _OPEN.search(source, at)
        if m is None:
            return
        if m[1]:
            end = source.find("-->", m.end())
            end = n if end < 0 else end + 3
        elif m.end() > last[">"]:
            return
        else:
            i = m.end()
            while not m[2]:
                x = _TAG_END.search(source, i)
                if x is None or x[0] == ">":
                    break
                i = source.find(x[0], x.end()) + 1 if last[x[0]] > x.start() else x.end()
            end = source.find(">", i if i <= last[">"] else m.end()) + 1
        go_on = yield m.start(), end, (m[4] or "").lower(), bool(m[3]), source[m.end():end - 1] if m[4] else ""
        at = end if go_on is None else go_on


def parse(source: str) -> Page:
    page = Page()
    root = Container("", None, 0, 0)
    page.containers.append(root)
    stack = [_Element("", False, 0, False, root, 0, True)]
    open_tags: Counter[str] = Counter()
    parts = [_Part(0, True)]
    held: list[tuple[int, int, Container, bool]] = []  # piece, its part, its container, whether it is a link's
    article_outside = False

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            open_tags[e.tag] -= 1
            if e.own:
                e.inner.end = len(page.pieces)

    def last(tags: set[str], stop: frozenset[str]) -> int:
        if not any(open_tags[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                break
        return 0

    def add(raw: str) -> None:
        top = stack[-1]
        if raw and not top.gone:
            held.append((len(page.pieces), top.side, top.inner, top.link))
            page.pieces.append(html.unescape(raw) if "&" in raw else raw)

    at, n = 0, len(source)
    tags = _tags(source)
    found = next(tags, None)
    while found is not None:
        begin, end, tag, ends, attribute_text = found
        add(source[at:begin])
        at, go_on = end, None
        if tag in BLOCKS:
            page.pieces.append(None)
        if ends:
            i = last({tag}, frozenset())
            if i:
                close(i)
        elif tag in RAW or tag in NOT_TEXT and tag not in ("head", "svg", "object", "video", "audio", "canvas"):
            close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            at = go_on = close_tag.end() if close_tag else n
        elif tag:
            if tag in ENDS_PARAGRAPH and stack[-1].paragraph:
                close(stack[-1].paragraph)
            if tag in SIBLINGS:
                i = last(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
                if i:
                    close(i)
            if tag == "body" and open_tags["head"]:
                close(next(i for i, e in enumerate(stack) if e.tag == "head"))
            if not (tag in VOID or attribute_text.endswith("/") and tag not in BLOCKS):
                attributes = _attributes(attribute_text) if attribute_text.strip() else {}
                up = stack[-1]
                gone, side, inner = up.gone or _is_gone(tag, attributes), up.side, up.inner
                if not gone and tag in ("article", "main"):
                    article_outside |= not side
                    k = side
                    while k and not parts[k].holds_article:
                        parts[k].holds_article = True
                        k = parts[k].outer
                if not gone and _is_named(tag, attributes, inner.article is not None):
                    parts.append(_Part(side))
                    side = len(parts) - 1
                own = tag in CONTAINERS and not gone
                if own:
                    classes = ".".join(sorted(_DIGITS.sub("#", attributes.get("class", "").lower().replace(">", " ")).split()))
                    label = tag + (f".{classes}" if classes else "")
                    outer = inner
                    inner = Container(label, outer, outer.depth + 1, len(page.pieces), _step(outer.digest, label), side)
                    inner.article = outer.article or (inner if tag in ("article", "main") else None)
                    page.containers.append(inner)
                paragraph = len(stack) if tag == "p" else 0 if tag in CONTAINERS else up.paragraph
                stack.append(_Element(tag, gone, side, up.link or tag == "a", inner, paragraph, own))
                open_tags[tag] += 1
        try:
            found = tags.send(go_on)
        except StopIteration:
            found = None
    add(source[at:])
    close(1)
    root.end = len(page.pieces)

    # named parts go, unless the page has articles in such parts only
    dropped = [False] * len(parts)
    for k in range(1, len(parts)):
        dropped[k] = dropped[parts[k].outer] or article_outside or not parts[k].holds_article
    for i, side, inner, link in held:
        if dropped[side]:
            page.pieces[i] = ""
            continue
        size = len("".join(page.pieces[i].split()))
        if link:
            inner.links += size
        else:
            inner.good += size
    page.containers = [c for c in page.containers if not dropped[c.side]]
    for c in reversed(page.containers[1:]):
        c.outer.good += c.good
        c.outer.links += c.links
    return page


def winning_text(page: Page, paths: list[str]) -> str:
    """Text of the containers on the first of ``paths`` that the page has."""
    best = page.best()
    for path in map(path_digest, paths):
        found: list[Container] = []
        for c in page.containers:
            if c.digest == path and not (found and c.begin < found[-1].end):
                found.append(c)
        good = sum(c.good for c in found)
        around = {id(c.article): c.article.good for c in found if c.article is not None}
        if found and good >= LEAST_PART * best.good and good >= NEARLY_ALL * sum(around.values()):
            return page.text(found)
    return page.text([best])


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: the containers that pages of a host vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [parse(x.as_py() or "").best().path for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    named = pages.select(url_host(F.col("url")).alias("host"), "html")
    return named.mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))


def winners(counted: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host, paths``: winning paths of each host, most votes first. At most
    ``1 / least_share`` paths of a host can win."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    won = counted.join(total, "host").where(F.col("votes") >= least_share * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return won.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), least_share: float = LEAST_SHARE) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of each page."""
    won = broadcast_if_bounded(materialise(winners(votes(pages), least_share), "winners"))
    rows = (pages.select(*keep, url_host(F.col("url")).alias("_host"), F.col("html").alias("_html"))
            .join(won, F.col("_host") == F.col("host"), "left").select(*keep, "paths", "_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [winning_text(parse(h.as_py() or ""), p.as_py() or [])
                     for p, h in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*b.schema.names[:-2], "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
