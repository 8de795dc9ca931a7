"""Main text of HTML pages with site template removal.

1. Every page is parsed into blocks of text, and every block-level element gets a hash of its subtree: its tag, its
   text and the hashes below it. Inline elements belong to the text of their block.
2. Spark counts each subtree over the distinct page contents of its host. A subtree that recurs on many of them is
   the site's template, and all blocks under it go (n_template). How many are many: least_recurrence(pages of the
   host), a count that grows with the root of the host's size, three at least. A single text block inside a marked
   article (a paragraph, heading, item) is template only if it is on most pages of its host and on ARTICLE_PAGES
   at least: a passage that many articles quote is main text.
3. What the counts can't tell, as on a host of two pages, is left to tags and class words (n_marked): of a page that
   marks an article or main element only that stays; elsewhere menus, headers, footers and the like go.

The hashes of a page are rows of two integers and a range of blocks each, so texts are never shuffled for the counts;
the second pass parses again and deletes ranges.

Defined cases: null and empty pages have an empty text; pages without a host are counted under one empty host; copies
of a page, and pages that differ only in their frames, count once; repeated rows and rows of one page_id each give a
row; other columns are ignored, whatever their names; an empty table gives no rows; a page takes time in proportion to
its length and its number of elements, however deep they nest. Unclosed and stray tags are accepted as browsers do: a
block start ends an open paragraph, an end tag closes what is open inside its element, and a stray one is ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, table

#: Distinct pages of a host on which a subtree must recur at least, and those for a single text block of an article.
LEAST_PAGES, ARTICLE_PAGES = 3, 8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Elements whose text is never main text.
DROPPED = frozenset("nav aside footer form dialog menu button select datalist object svg canvas math audio video map head".split())
#: A start of one of these ends an open element of the same group within the same list or table.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "menu", "dl", "table", "select")
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr figcaption caption tbody".split())
#: Words of class, id and role that mark notices, adverts, menus and comments, also inside an article.
MARKS = "ads? adverts? advertisements? advertising adsense sponsor(?:ed|s)? promos? cookies? consent gdpr notices? popups? modals? newsletter subscribe subscription signup sharing social sidebars? menus? nav navbar navigation breadcrumbs? comments? disqus replies respond pagination pager".split()
#: Those that mark frames outside an article only: inside one they name parts of its text.
OUTER_MARKS = "promotions? banners? alerts? overlay login share side header masthead topbar footer foot reply related recommend(?:ed|ations?)? widgets? toolbar skip complementary contentinfo search form legal disclaimer".split()


def _words(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words)})(?=$|[\s_-]|\d)", re.I)


_INNER, _OUTER = _words(MARKS), _words(MARKS + OUTER_MARKS)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_MARKED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _flags(tag: str, attrs: str, inside: bool) -> bool:
    """Whether tag and attributes mark an element as boilerplate."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    words = _INNER if inside else _OUTER
    for m in _MARKED.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name != "aria-hidden" and words.search(value):
            return True
    return False


class Page:
    """The blocks of a page and the subtrees over them.

    texts, marked, main: by block, its text, whether tags or marks make it boilerplate, whether it is in a main
    element. trees: (hash, first block, end block, whether it is a text block of a main element) of every subtree
    that holds a block.
    """

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.marked: list[bool] = []
        self.main: list[bool] = []
        self.trees: list[tuple[int, int, int, bool]] = []
        self._tags: list[str] = []  # open elements: tag, marked, main
        self._marked: list[bool] = [False]
        self._main: list[bool] = [False]
        self._open: dict[str, list[int]] = {}  # places of the open elements by tag
        self._blocks: list[int] = []  # places of the open block-level elements
        self._subtrees: list[list] = []  # place, digest, first block, text block of a main element
        self._buffer: list[str] = []
        self._parse(page)

    def _parse(self, page: str) -> None:
        # behind the last > there is no tag, and before it every < of a tag finds its end
        at, end = 0, page.rfind(">") + 1
        rest = page[end:].partition("<!--")[0]
        while at < end:
            m = _TOKEN.search(page, at, end)
            if not m:
                self._buffer.append(page[at:end])
                break
            if m.start() > at:
                self._buffer.append(page[at : m.start()])
            at = m.end()
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    rest = ""  # a comment without an end takes all that follows
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if not stop:
                    rest = ""
                    break
                at = stop.end()
            else:
                self._start(tag, attrs)
        self._buffer.append(rest)
        self._close_block()
        self._close_to(0)

    def _close_block(self) -> None:
        text = " ".join(entities.unescape("".join(self._buffer)).split()) if self._buffer else ""
        self._buffer.clear()
        if text:
            if self._subtrees:
                self._subtrees[-1][1].update(b"\x00" + text.encode("utf-8", "surrogatepass"))
            self.texts.append(text)
            self.marked.append(self._marked[-1])
            self.main.append(self._main[-1])

    def _close_to(self, place: int) -> None:
        """Close all open elements from a place of the stack on."""
        while len(self._tags) > place:
            k = len(self._tags) - 1
            self._open[self._tags.pop()].pop()
            self._marked.pop()
            self._main.pop()
            if self._blocks and self._blocks[-1] == k:
                self._blocks.pop()
            if self._subtrees and self._subtrees[-1][0] == k:
                _, digest, first, inner = self._subtrees.pop()
                if self._subtrees:
                    self._subtrees[-1][1].update(b"\x01" + digest.digest())
                if first < len(self.texts) and first >= 0:
                    self.trees.append((int.from_bytes(digest.digest(), "little", signed=True), first, len(self.texts), inner))

    def _end(self, tag: str) -> None:
        places = self._open.get(tag)
        if not places:
            return
        if tag in BLOCKS or tag in DROPPED:
            self._close_block()
        elif self._blocks and places[-1] < self._blocks[-1]:
            return  # an inline end tag closes inline elements only
        self._close_to(places[-1])

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self._open.get(t))), default=-1)

    def _start(self, tag: str, attrs: str) -> None:
        block = tag in BLOCKS
        tree = block or tag in DROPPED
        if tree:
            self._close_block()
        if tag in VOID:
            if tag in ("br", "hr"):
                self._buffer.append(" ")
            return
        if block and self._blocks and self._tags[self._blocks[-1]] == "p":
            self._close_to(self._blocks[-1])  # a block start ends an open paragraph with all inline elements in it
        if (group := SIBLINGS.get(tag)) and (place := self._last(group)) > self._last(SCOPES):
            # the outermost of the group within the list or table
            scope = self._last(SCOPES)
            self._close_to(min((p for t in group for p in self._open.get(t, ())[-1:] if p > scope), default=place))
        if attrs.endswith("/") and not block:
            return
        inside = self._main[-1]
        marked = _flags(tag, attrs, inside)
        main = inside or tag in ("article", "main") and not marked
        k = len(self._tags)
        self._tags.append(tag)
        self._open.setdefault(tag, []).append(k)
        # the header of an article holds its title; page headers are frames
        self._marked.append(self._marked[-1] or marked or tag == "header" and not inside)
        self._main.append(main)
        if block:
            self._blocks.append(k)
        if tree:
            # whole documents and articles are no templates
            first = len(self.texts) if tag not in ("html", "body", "article", "main") else -1
            self._subtrees.append([k, hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8), first, main and tag in TEXT_BLOCKS])

    def content(self) -> int:
        """A hash of the main text by tags and marks: what makes two pages of a host different."""
        kept = "\n".join(t for t, stays in zip(self.texts, self.unframed(), strict=True) if stays)
        return int.from_bytes(hashlib.blake2b(kept.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def unframed(self) -> np.ndarray:
        """By block, whether tags and marks leave it: inside a main element if there is one, and not marked."""
        main, plain = np.array(self.main, bool), ~np.array(self.marked, bool)
        return plain & main if (plain & main).any() else plain


def least_recurrence(n_pages: Column) -> Column:
    """Distinct pages on which a subtree of a host with so many distinct pages must recur: their root, 3 at least."""
    return F.greatest(F.lit(LEAST_PAGES), F.ceil(F.sqrt(n_pages.cast("double"))))


def _keyed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, key): key names host and html, so equal pages share it."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    return rows.withColumn("host", F.xxhash64("host")).withColumn("key", F.unhex(F.sha1(F.concat(F.col("host").cast("string"), F.lit(" "), "html"))))


def subtrees(pages: DataFrame) -> DataFrame:
    """(key, host, content, trees) of every page; trees are (hash, first block, end block, inner)."""
    kind = pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("stop", pa.int32()), ("inner", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                parsed = [Page(t.as_py()) for t in part.column("html")]
                flat = [x for p in parsed for x in p.trees]
                cols = zip(*flat, strict=True) if flat else ([], [], [], [])
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))
                trees = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p.trees) for p in parsed]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), pa.array([p.content() for p in parsed], pa.int64()), trees], ["key", "host", "content", "trees"])

    return _keyed(pages).select("key", "host", "html").mapInArrow(run, "key binary, host long, content long, trees array<struct<tree:bigint,first:int,stop:int,inner:boolean>>")


def templates(found: DataFrame) -> DataFrame:
    """(host, tree) of the subtrees of subtrees() rows that recur on many distinct pages of their host."""
    sizes = found.groupBy("host").agg(F.count_distinct("content").alias("n_pages"))
    # a tree is counted once a page; an inner one that also stands elsewhere counts as inner
    one = found.select("host", "content", F.explode("trees").alias("t")).select("host", "content", "t.tree", "t.inner")
    pages = one.groupBy("host", "tree", "content").agg(F.max("inner").alias("inner"))
    counts = pages.groupBy("host", "tree").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where(F.col("n") >= LEAST_PAGES)
    needed = F.when(F.col("inner"), F.greatest(F.lit(ARTICLE_PAGES), F.floor(F.col("n_pages") / 2) + 1)).otherwise(least_recurrence(F.col("n_pages")))
    return counts.join(sizes, "host").where(F.col("n") >= needed).select("host", "tree")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "n_template", "n_marked"]
    for b in batches:
        texts, gone_by = [], ([], [])
        for i in range(b.num_rows):
            page = Page(b.column("html")[i].as_py())
            edge = np.zeros(len(page.texts) + 1, np.int32)
            ranges = b.column("ranges")[i]
            if ranges.is_valid:
                np.add.at(edge, ranges.values.field("first").to_numpy(), 1)
                np.add.at(edge, ranges.values.field("stop").to_numpy(), -1)
            template = np.cumsum(edge[:-1]) > 0
            stays = page.unframed()
            texts.append("\n".join(t for t, keep in zip(page.texts, stays & ~template, strict=True) if keep))
            gone_by[0].append(int(template.sum()))
            gone_by[1].append(int((~stays & ~template).sum()))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *(pa.array(x, pa.int32()) for x in gone_by)], names)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_template (blocks under a template), n_marked (blocks that only tags or marks remove)."""
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    found = materialize(subtrees(pages))
    known = bounded_broadcast(materialize(templates(found)))
    ranges = found.select("key", "host", F.explode("trees").alias("t")).select("key", "host", "t.*").join(known, ["host", "tree"])
    ranges = ranges.groupBy("key").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    rows = _keyed(pages).join(ranges, "key", "left").select("page_id", "url", "html", "ranges")
    cut = rows.mapInArrow(_cut, f"page_id {kind}, url string, text string, n_template int, n_marked int")
    return cut.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_marked")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
