"""Main text of web pages by consensus host paths.

1. Every page's elements are read with the implied ends of HTML, and its containers scored: a block's text counts for the
   container it stands in and, less by a factor per level, for those around it; link text counts against it. From the best
   one the page climbs to the article or main around it and on to those around that add text of few links (`Page._climbed`),
   so that title, lead and sister parts belong to it.
2. Each page votes for the generalised path (tags and classes from the body down, digits made alike) of that container.
   Spark counts the votes per host; paths with two votes and a hundredth of the host's pages win, so a host has at most 100.
3. Each page is read again with its host's winning paths: the text of all containers on the best-voted path that the page
   has. A page without any of them, or without text there, falls back on its own container.

Left out wherever they stand: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments (by
tag, role and words of class or id). Names that tell a state (no-sidebar, nav-open) don't count, and an element that turns out
to hold the page's article or most of its text is kept (`Page._kept`), but for hidden ones. Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by a line end; nothing else is dropped or cut.

Nulls and odd input: a null or empty html gives an empty text; a null url has the host ''; broken markup is read as far as it
goes. Repeated pages give repeated rows (and votes). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast
from riskloom.session import cut_lineage, ship_package

PATH_LEVELS = 60       # a deeper container shares the path of the one above it
OUTER = 0.6            # what a container's text counts for the container around it
MIN_VOTES = 2
MIN_SHARE = 0.01
BROADCAST_HOSTS = 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|xmp)\b"
    r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption hr address "
    "header footer nav aside form fieldset details summary hgroup menu dialog html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th img wbr".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "option": ("option", "select")}
SKIPPED_TAGS = frozenset("head nav header footer aside form button select option label input dialog menu object audio video canvas "
                         "fieldset datalist".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead header topbar footer sidebar aside rail ad ads advert "
    "adverts advertisement advertising adsense promo promotion sponsor sponsored banner cookie cookies consent gdpr notice notification "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus replies respond widget toolbar search form skip".split())
ARTICLE_WORDS = frozenset("article post entry story content main body".split())
NEVER_SKIPPED = frozenset("html body main article".split())
OWN_ARTICLE = frozenset("comment comments ad advert related".split())
STATE_FIRST = frozenset("no has with without is".split())
STATE_LAST = frozenset("open opened closed fixed sticky collapsed expanded visible enabled disabled".split())

# How firmly an element is left out: an outer layout may well bear the words of LAYOUT and WRAPPER; the rest names the thing itself.
NOT, WRAPPER, LAYOUT, FIRM, GONE = range(5)
WRAPPER_TAGS = frozenset("form fieldset label".split())
GONE_TAGS = frozenset("head button select option input object audio video canvas datalist".split())
WRAPPER_WORDS = frozenset("widget form search toolbar skip notice".split())
LAYOUT_WORDS = frozenset("nav navbar menu masthead header topbar sidebar aside rail banner overlay modal popup social share sharing "
                         "notification".split())
MOST = 0.5             # of the unlinked text: a wrapper with more of it is kept
NEARLY_ALL = 0.9       # the same for a layout
LEAST_TEXT = 200       # characters without which an element isn't kept for its text alone
OUTSIDE, LOST = -1, -2      # the drop of what no skipped element holds, and of what is left out without another look
LINKED = 0.25          # what a container around the best one adds is main text if at most this share of it is links


def _words(value: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(value)]


def _attributes(raw: str) -> dict[str, str]:
    attrs: dict[str, str] = {}
    for name, *values in _ATTR.findall(raw):
        attrs.setdefault(name.lower(), values[0] or values[1] or values[2])
    return attrs


def _skipped(tag: str, attrs: dict[str, str]) -> int:
    """NOT, or how firmly the element is left out."""
    if "hidden" in attrs or tag in GONE_TAGS:
        return GONE
    firm = NOT
    if tag in SKIPPED_TAGS:
        firm = WRAPPER if tag in WRAPPER_TAGS else FIRM
    role = attrs.get("role", "").lower()
    if role in SKIPPED_ROLES:
        firm = max(firm, WRAPPER if role == "form" else FIRM)
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = _words(name)
        found = SKIPPED_WORDS.intersection(words)
        if not found or len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        if tag in NEVER_SKIPPED and not OWN_ARTICLE & found:
            continue      # the state of the page ("article sidebar-left"), unless the element is itself such a thing
        if found == {"header"} and ARTICLE_WORDS.intersection(words):
            continue      # the heading of the article itself
        firm = max(firm, WRAPPER if found <= WRAPPER_WORDS else LAYOUT if found <= WRAPPER_WORDS | LAYOUT_WORDS else FIRM)
    return firm


class _Stack:
    """The open elements: tag, node of the nearest container, drop (see Page). Counts tell if a tag is open at all."""

    def __init__(self):
        self.items, self.open = [("body", 0, OUTSIDE)], {"body": 1}

    @property
    def top(self) -> tuple[str, int, int]:
        return self.items[-1]

    def push(self, tag: str, node: int, drop: int) -> None:
        self.items.append((tag, node, drop))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _cut(self, at: int) -> None:
        for tag, _, _ in self.items[at:]:
            self.open[tag] -= 1
        del self.items[at:]

    def close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        for i in range(len(self.items) - 1, 0, -1):
            here = self.items[i][0]
            if here == tag:
                return self._cut(i)
            if tag not in BLOCKS and here in BLOCKS and here not in ("p", "li"):
                return None        # an inline end doesn't close blocks
            if tag in ("p", "li") and here in CONTAINERS:
                return None

    def imply(self, tag: str) -> None:
        """Close what a start tag ends by itself: a paragraph before a block, a list item before the next."""
        if tag in BLOCKS and self.open.get("p"):
            self._end({"p"}, BLOCKS)
        if tag in CLOSES:
            ended, bounds = (set(x.split()) for x in CLOSES[tag])
            if any(self.open.get(t) for t in ended):
                self._end(ended, bounds)

    def _end(self, ended: set[str], bounds: set[str] | frozenset[str]) -> None:
        for i in range(len(self.items) - 1, 0, -1):
            if self.items[i][0] in ended:
                return self._cut(i)
            if self.items[i][0] in bounds:
                return None


class Page:
    """The blocks of a page outside of what is left out, and the containers they stand in.

    An element that its tag, role or names tell to leave out is a drop. Its blocks are read too, as only the whole page shows
    whether it holds the article.
    """

    def __init__(self, html: str):
        self.parent, self.path, self.depth = [-1], ["body"], [0]           # of each node; 0 is the body, also where no tag says so
        self.kind = [""]                                                   # article or main, by tag or role, or nothing
        self.blocks: list[tuple[str, int, int]] = []                       # text, its container, characters of links
        self._drops: list[tuple[int, int]] = []                            # the drop around each, and how firmly it is left out
        self._articles: list[int] = []                                     # of each article or main: the drop it stands in
        self._found: list[tuple[str, int, int, int]] = []                  # blocks, and the drop of each
        self._read(html)
        kept = self._kept() if self._drops else {OUTSIDE}
        self.blocks = [b[:3] for b in self._found if b[3] in kept]

    def _read(self, html: str) -> None:
        stack = _Stack()
        text: dict[int, list[str]] = {}      # by drop: a skipped inline element stands within a block
        links: dict[int, int] = {}
        depth_a, last = 0, 0

        def add(part: str, linked: int = 0) -> None:
            drop = stack.top[2]
            if drop != LOST:
                text.setdefault(drop, []).append(part)
                if linked:
                    links[drop] = links.get(drop, 0) + linked

        def flush() -> None:
            for drop, parts in text.items():
                joined = " ".join(unescape("".join(parts)).split())
                if joined:
                    self._found.append((joined, stack.top[1], min(links.get(drop, 0), len(joined)), drop))
            text.clear()
            links.clear()

        for m in _TOKEN.finditer(html):
            if m.start() > last:
                add(html[last:m.start()], m.start() - last if depth_a else 0)
            last = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                if m["raw"]:
                    add(" ")
                continue
            tag = tag.lower()
            ends = bool(m["end"] or m["end2"])
            if tag in BLOCKS:
                flush()
            elif tag in SPACES:
                add(" ")
            if tag == "a":
                depth_a = max(0, depth_a + (-1 if ends else 1))
            if ends:
                stack.close(tag)
                continue
            if tag in ("html", "body"):
                continue
            stack.imply(tag)
            if tag in VOID:
                continue
            raw = m["attrs"] or m["attrs2"] or ""
            attrs = _attributes(raw) if raw else {}
            _, node, drop = stack.top
            firm = _skipped(tag, attrs) if drop != LOST else GONE
            if firm == GONE:
                drop = LOST
            elif firm:
                self._drops.append((drop, firm))
                drop = len(self._drops) - 1
            kind = next((x for x in (tag, attrs.get("role", "").lower()) if x in ("article", "main")), "")
            if kind and not firm:
                self._articles.append(drop)
            if tag in CONTAINERS and drop != LOST:
                classes = "".join("." + _DIGITS.sub("0", c) for c in sorted(set(attrs.get("class", "").split())))
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.path.append(f"{self.path[node]}>{tag}{classes}" if self.depth[-1] <= PATH_LEVELS else self.path[node])
                self.kind.append(kind)
                node = len(self.parent) - 1
            if not raw.endswith("/") or tag in BLOCKS:
                stack.push(tag, node, drop)
        add(html[last:])
        flush()

    def _kept(self) -> set[int]:
        """OUTSIDE and the drops that hold the article, or the page's text: looked for from the outside in.

        A wrapper (form, widget) is kept if it holds an article or main, or most of the text. As long as no article or main
        stands outside of drops, so is a layout that holds one, or nearly all text, and any drop with both an article and
        most text. Texts are counted without links, and the page's without that of firm drops.
        """
        sizes, firm_text = [0] * len(self._drops), 0
        for text, _, linked, drop in self._found:
            if drop != OUTSIDE:
                sizes[drop] += len(text) - linked
        total = sum(len(text) - linked for text, _, linked, _ in self._found)
        holds = [0] * len(self._drops)
        for drop in self._articles:
            if drop != OUTSIDE:
                holds[drop] += 1
        for k in range(len(self._drops) - 1, -1, -1):     # what is around comes first
            around, _ = self._drops[k]
            if around != OUTSIDE:
                sizes[around] += sizes[k]
                holds[around] += holds[k]
        firm_around, levels = [False] * len(self._drops), [0] * len(self._drops)
        by_level: list[list[int]] = []
        for k, (around, firm) in enumerate(self._drops):
            within = around != OUTSIDE and firm_around[around]
            firm_around[k] = within or firm == FIRM
            if firm == FIRM and not within:
                firm_text += sizes[k]
            levels[k] = 0 if around == OUTSIDE else levels[around] + 1
            if levels[k] == len(by_level):
                by_level.append([])
            by_level[levels[k]].append(k)
        own, kept = set(self._articles), {OUTSIDE}
        free = OUTSIDE in own
        for level in by_level:
            more = set()
            for k in level:
                around, firm = self._drops[k]
                if around not in kept:
                    continue
                much = sizes[k] >= LEAST_TEXT
                if firm == WRAPPER:
                    keep = holds[k] or much and sizes[k] > MOST * (total - firm_text)
                elif firm == LAYOUT:
                    keep = not free and (holds[k] or much and sizes[k] > NEARLY_ALL * (total - firm_text))
                else:
                    keep = not free and holds[k] and sizes[k] > MOST * total
                if keep:
                    more.add(k)
            kept |= more
            free = free or not own.isdisjoint(more)
        return kept

    def best(self) -> int | None:
        """The container of the main text: the one with the highest score, or one around it. Of equal scores the outermost, then the first."""
        n = len(self.parent)
        scores = [0.0] * n
        sizes, links, articles = [0] * n, [0] * n, [int(k == "article") for k in self.kind]     # with all below
        for text, node, linked in self.blocks:
            scores[node] += max(0.0, len(text) - 2.0 * linked)
            sizes[node] += len(text)
            links[node] += linked
        for node in range(n - 1, 0, -1):       # parents come first
            around = self.parent[node]
            scores[around] += OUTER * scores[node]
            sizes[around] += sizes[node]
            links[around] += links[node]
            if sizes[node]:
                articles[around] += articles[node]
        top = max(scores)
        if top <= 0:
            return None
        return self._climbed(min((i for i, s in enumerate(scores) if s == top), key=lambda i: (self.depth[i], i)), sizes, links, articles)

    def _climbed(self, node: int, sizes: list[int], links: list[int], articles: list[int]) -> int:
        """From a container to the outermost article around it, or else the main, and on as long as what is added has few links.

        A main is the end; from an article the way ends before the body and before other articles.
        """
        around = [node]
        while self.parent[around[-1]] >= 0:
            around.append(self.parent[around[-1]])
        enclosing = [i for i in around if self.kind[i] == "article"] or [i for i in around if self.kind[i] == "main"]
        at = enclosing[-1] if enclosing else node
        for i in around[around.index(at) + 1:]:
            added = sizes[i] - sizes[at]
            if self.kind[at] == "main" or enclosing and (i == 0 or articles[i] > articles[at]):
                break
            if added and links[i] - links[at] > LINKED * added:
                break
            if added:
                at = i
        return at

    def text(self, paths: list[str]) -> str:
        """The blocks of the best-voted path that has any, or of the page's own best container."""
        here = set(self.path)
        for path in paths:
            if path in here and (found := self._below({i for i, p in enumerate(self.path) if p == path})):
                return found
        own = self.best()
        return self._below({own}) if own is not None else ""

    def _below(self, roots: set[int]) -> str:
        inside = [False] * len(self.parent)
        for i, parent in enumerate(self.parent):     # parents come first
            inside[i] = i in roots or parent >= 0 and inside[parent]
        return "\n".join(text for text, node, _ in self.blocks if inside[node])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths that win the votes of each host, best first. Takes rows of `with_host`."""
    ship_package(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for host, html in zip(batch.column("host").to_pylist(), _texts(batch)):
                page = Page(html)
                best = page.best()
                hosts.append(host)
                paths.append(None if best is None else page.path[best])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    tally = cut_lineage(pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path is not null")
                        .groupBy("host", "path").agg(F.count("*").alias("votes")))
    totals = tally.groupBy("host").agg(F.sum("votes").alias("total"))
    won = tally.join(totals, "host").where((F.col("votes") >= MIN_VOTES) & (F.col("votes") >= MIN_SHARE * F.col("total")))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("w")) \
        .select("host", F.col("w.path").alias("paths"))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in batch.column("html").cast(pa.binary()).to_pylist()]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = with_host(pages)
    winners = cut_lineage(winning_paths(pages))
    joined = pages.join(checked_broadcast(winners, BROADCAST_HOSTS), "host", "left").select("page_id", "url", "html", "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html).text(paths or []) for html, paths in zip(_texts(batch), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    types = dict(pages.dtypes)
    out = joined.mapInArrow(extract, f"page_id {types['page_id']}, url {types['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
