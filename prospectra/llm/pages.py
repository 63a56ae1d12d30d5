"""Operator 9, HTML extraction: nearest-URL page differencing.

Pages are ordered by host, URL path, key and a hash of the html. A page's neighbours are the nearest pages before and after
it in that order, on its host, that aren't nearly the same page (SAME of the longer one's lines are shared); the one whose path shares the longer prefix with the page's own counts, or both if they share as much. A page's
text lines are its blocks, without those in elements that can't be the article (menus, headers, footers, asides, forms,
scripts, hidden parts, and elements whose class, id or role names a menu, notice, advert, comments and the like). The lines
are aligned with the neighbour's by a longest common subsequence, and shared lines are deleted unless the markup itself
(article, main) holds them as content: articles of one host may share sentences.

The order is cut into chunks of so many pages by exact ranks, and a chunk gets the REACH pages on either side of it, too. Pages
that have nothing but copies in these go through further rounds, with the pages of their hosts, larger chunks and WIDER times
the reach each, until a neighbour is found or the host ends: a task's share grows with the longest run of copies, not with the
host, and the result is the same for any partitioning. Runs of pages with equal lines are passed over in one step.

Null and empty html gives an empty text; a null URL is the empty host. Repeated rows each get their result. Very long pages
are read whole: a task holds 2 * REACH of them (in a further round twice its reach; equal lines that follow each other once). An empty table gives an empty result. Columns other than key, url and html take no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
SPACES = re.compile(r"\s+")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+|\d+")
# Element names of HTML and the usual names of page parts.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "select", "button", "fieldset", "svg", "math", "object", "canvas", "audio", "video", "map", "datalist"}
CONTENT = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "widget",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


#: Share of lines, in thousandths of the longer page's, from which two pages count as copies.
SAME = 900
#: Places in the order of URLs within which the first round looks for a neighbour, and how many times more each further one.
REACH, WIDER = 16, 16
#: Pages of a chunk, and chunks at most: beyond, chunks grow, so that their borders stay a small table.
CHUNK, CHUNKS = 512, 50_000


def unwanted(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not PARTS.isdisjoint(WORD.findall(value)):
            return True
    return False


def lines(html: str) -> list[tuple[str, bool]]:
    """Blocks of a page in page order, with whether an article or main element holds them."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[str] = []  # open elements
    drop = -1  # depth of the element that drops what is in it
    content = 0
    low = None

    def end() -> None:
        got = SPACES.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if got:
            out.append((got, content > 0))

    at = 0
    while m := TAG.search(html, at):
        if drop < 0:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            if drop < 0:
                end()
        elif tag in ("br", "img") and drop < 0:
            text.append(" ")
        if m[1]:
            if tag in stack:
                while True:
                    gone = stack.pop()
                    if gone in CONTENT and drop < 0:
                        content -= 1
                    if len(stack) <= drop:
                        drop = -1
                    if gone == tag:
                        break
            continue
        if tag in RAW:
            low = low or html.lower()
            close = low.find(f"</{tag}", at)
            at = len(html) if close < 0 else (html.find(">", close) + 1 or len(html))
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in CLOSES_P and stack and stack[-1] == "p":
            stack.pop()
            if len(stack) <= drop:
                drop = -1
        if drop < 0 and unwanted(tag, m[3]):
            drop = len(stack)
        elif drop < 0 and tag in CONTENT:
            content += 1
        stack.append(tag)
    if drop < 0:
        text.append(html[at:])
        end()
    return out


def lcs(a: list, b: list) -> tuple[set[int], set[int]]:
    """Places of a longest common subsequence in a and b; memory grows with the shorter one (Hirschberg)."""
    hit_a: set[int] = set()
    hit_b: set[int] = set()

    def last(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int32)
        for v in x:
            new = row.copy()
            new[1:] = np.maximum(row[1:], row[:-1] + (y == v))
            row = np.maximum.accumulate(new)
        return row

    def walk(x: np.ndarray, y: np.ndarray, i: int, j: int) -> None:
        while len(x) and len(y) and x[0] == y[0]:
            hit_a.add(i)
            hit_b.add(j)
            x, y, i, j = x[1:], y[1:], i + 1, j + 1
        while len(x) and len(y) and x[-1] == y[-1]:
            x, y = x[:-1], y[:-1]
            hit_a.add(i + len(x))
            hit_b.add(j + len(y))
        if not len(x) or not len(y):
            return
        if len(x) == 1:
            if len(k := np.flatnonzero(y == x[0])):
                hit_a.add(i)
                hit_b.add(j + int(k[0]))
            return
        mid = len(x) // 2
        cut = int(np.argmax(last(x[:mid], y) + last(x[mid:][::-1], y[::-1])[::-1]))
        walk(x[:mid], y[:cut], i, j)
        walk(x[mid:], y[cut:], i + mid, j + cut)

    both = set(a) & set(b)
    if both:
        number = {v: k for k, v in enumerate(both)}
        pa, pb = ([k for k, v in enumerate(side) if v in both] for side in (a, b))
        walk(np.array([number[a[k]] for k in pa]), np.array([number[b[k]] for k in pb]), 0, 0)
        return {pa[k] for k in hit_a}, {pb[k] for k in hit_b}
    return set(), set()


def prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    __slots__ = ("chunk", "host", "path", "key", "url", "own", "hash", "lines", "count", "run")

    def __init__(self, row, place: int, last: Page | None) -> None:
        """place: the page's number; last: the page before it in the chunk and host."""
        self.chunk, self.host, self.path, self.key, self.url, self.own, self.hash = row.chunk, row.h, row.p, row.k, row.u, row.own, row.x
        self.lines = [(x, False) for x in np.frombuffer(row.t, "<u8").tolist()] if isinstance(row.t, bytes) else lines(row.t or "")
        self.count: Counter | None = None
        self.run = [place, place]  # first and last place of the pages with equal lines that follow each other
        if last and last.lines == self.lines:
            self.lines, self.run = last.lines, last.run
            self.run[1] = place

    def same(self, other: Page) -> bool:
        """Whether the two are nearly the same page."""
        if self.lines is other.lines or self.lines == other.lines:
            return True
        most = max(len(self.lines), len(other.lines))
        if 1000 * min(len(self.lines), len(other.lines)) < SAME * most:
            return False
        for x in (self, other):
            x.count = x.count or Counter(t for t, _ in x.lines)
        return 1000 * (self.count & other.count).total() >= SAME * most

    def text(self, near: list[Page]) -> str:
        """The lines that no neighbour shares, or that the markup holds as content."""
        best = max((prefix(x.path, self.path) for x in near), default=0)
        shared: set[int] = set()
        for x in near:
            if prefix(x.path, self.path) == best:
                shared |= lcs([t for t, _ in self.lines], [t for t, _ in x.lines])[0]
        return "\n".join(t for k, (t, content) in enumerate(self.lines) if content or k not in shared)


def line_hashes(html: str | None) -> bytes:
    """64 bits for each line of a page: what tells copies, without the text."""
    return b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _ in lines(html or ""))


def differenced(rows: Iterator, reach: int, probe: bool) -> Iterator[tuple]:
    """key, url, text, whether a side has nothing but copies within reach, host, path and hash of the pages that a chunk owns; rows are sorted by chunk and by the order of pages. probe: only those with nothing but copies."""
    held: list[Page] = []
    first = at = place = 0  # places of the first page held, of the next one to answer, and of the next row

    def nearest(page: Page, step: int) -> tuple[Page | None, bool]:
        """The nearest page on a side that is no copy; without one, whether there may be one beyond reach."""
        end = at + step * reach
        x = at + step
        while first <= x < place and (end - x) * step >= 0:
            other = held[x - first]
            if not other.same(page):
                return other, False
            x = other.run[step > 0] + step
        return None, first <= end < place

    def answer() -> Iterator[tuple]:
        page = held[at - first]
        if page.own:
            before, after = nearest(page, -1), nearest(page, 1)
            more = before[1] or after[1]
            if probe and not more:
                return
            yield page.key, page.url, None if more else page.text([x for x, _ in (before, after) if x]), more, page.host, page.path, page.hash

    for row in rows:
        last = held[-1] if held else None
        if last and (row.chunk, row.h) != (last.chunk, last.host):
            while at < place:
                yield from answer()
                at += 1
            held, first, last = [], place, None
        held.append(Page(row, place, last))
        place += 1
        if place - at > reach:
            yield from answer()
            at += 1
            if at - first > 2 * reach:  # those before are gone in one go
                del held[: at - first - reach]
                first = at - reach
    while at < place:
        yield from answer()
        at += 1


def borders(keys: DataFrame, order: list[str], reach: int) -> tuple[list, list, list]:
    """The pages that begin the second and later chunks, and those reach places after and before these; by exact ranks."""
    spark = keys.sparkSession
    keys = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower 33 bits count within the partition
    keys = C.written(keys.select(*order, F.spark_partition_id().alias("part"), place.alias("at")), "keys")
    starts, n = [], 0
    for r in keys.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], n))
        n += r["count"]
    chunk = max(CHUNK, -(-n // CHUNKS), 2 * reach)
    if n <= chunk:
        return [], [], []
    ranked = keys.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("rank", F.col("start") + F.col("at"))
    got = ranked.where((F.col("rank") % chunk).isin(0, reach, chunk - reach)).select("rank", *order).collect()  # three rows a chunk
    keyed = {r["rank"]: tuple(r)[1:] for r in got}
    first = range(chunk, n, chunk)
    return [keyed[r] for r in first], [keyed[r + reach] for r in first if r + reach < n], [keyed[r - reach] for r in first]


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every page."""
    C.ship(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(u, "^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("t"), host.alias("h"), path.alias("p"))
    rows = rows.withColumn("x", F.xxhash64("t", "u"))
    order = ["h", "p", "k", "x"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(t=[line_hashes(t) for t in batch["t"]])

    # Hashes of lines tell the pages that need further rounds, so that the texts of the others need not be stored.
    bounds = borders(rows.select(*order), order, REACH)
    sketches = rows.mapInPandas(C.lean(hashed), f"k {kinds[key]}, u {kinds[url]}, t binary, h string, p string, x long")
    probed = one_round(sketches, kinds[key], kinds[url], REACH, bounds, probe=True)
    open_ = C.written(probed.select(*order).distinct(), "open")
    out, reach = one_round(rows, kinds[key], kinds[url], REACH, bounds), REACH
    while not open_.isEmpty():
        # Repeated rows of which one is open are all answered by the next round.
        out = out.join(open_.select(*(F.col(c).alias(f"o{c}") for c in order)), among(), "left_anti")
        reach *= WIDER
        some = rows.join(open_.select("h").distinct(), "h", "left_semi").select(*rows.columns)
        more = C.written(one_round(some, kinds[key], kinds[url], reach, borders(some.select(*order), order, reach), open_), "texts")
        out = out.unionByName(more)
        open_ = C.written(more.where("more").select(*order).distinct(), "open")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")


def among() -> Column:
    """Whether a page (h, p, k, x) is one of other keys (oh, op, ok, ox)."""
    return (F.col("h") == F.col("oh")) & (F.col("p") == F.col("op")) & F.col("k").eqNullSafe(F.col("ok")) & (F.col("x") == F.col("ox"))


def one_round(rows: DataFrame, key: str, url: str, reach: int, bounds: tuple[list, list, list], wanted: DataFrame | None = None, probe: bool = False) -> DataFrame:
    """k, u, text and n_chars of the pages wanted (all, if None), and whether they need a page beyond reach (then without text); probe: only these."""
    spark = rows.sparkSession
    order = ["h", "p", "k", "x"]
    renamed = lambda df: df.select(*(F.col(c).alias(f"o{c}") for c in order))
    first, after, before = bounds
    rows = rows.withColumn("mine", F.lit(True)) if wanted is None else rows.join(renamed(wanted).withColumn("mine", F.lit(True)), among(), "left").select(*rows.columns, F.col("mine").isNotNull().alias("mine"))
    if first:
        kind = f"array<struct<h:string,p:string,k:{key},x:bigint>>"
        table = spark.createDataFrame([(first, after, before)], f"first {kind}, after {kind}, before {kind}")
        own = F.struct(*order)
        steps = [1 << x for x in reversed(range(len(first).bit_length()))]  # a binary search: how many chunks begin at or before the page
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, d: F.when((lo + d <= F.size("first")) & (F.get("first", lo + d - 1) <= own), lo + d).otherwise(lo))
        rows = rows.crossJoin(F.broadcast(table)).withColumn("c", found)  # one row: three pages a chunk, CHUNKS chunks at most
        ahead = (F.col("c") > 0) & F.coalesce(own < F.get("after", F.col("c") - 1), F.lit(True))
        behind = (F.col("c") < F.size("first")) & F.coalesce(own >= F.get("before", F.col("c")), F.lit(False))
        to = F.array_compact(F.array(F.col("c"), F.when(ahead, F.col("c") - 1), F.when(behind, F.col("c") + 1)))
        rows = rows.select("k", "u", "t", *order[:2], "x", "mine", "c", to.alias("to"))
        if wanted is not None:  # only chunks with pages that are wanted
            rows = C.written(rows, "wider")
            chunks = rows.where("mine").select(F.col("c").alias("chunk")).distinct()
        rows = rows.withColumn("chunk", F.explode("to")).withColumn("own", F.col("mine") & (F.col("chunk") == F.col("c")))
        if wanted is not None:
            rows = rows.join(F.broadcast(chunks), "chunk", "left_semi")  # CHUNKS chunks at most
    else:
        rows = rows.withColumns({"chunk": F.lit(0), "own": F.col("mine")})
    rows = rows.select("chunk", "own", "k", "u", "t", "h", "p", "x").repartition("chunk").sortWithinPartitions("chunk", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        names = ["k", "u", "text", "n_chars", "more", "h", "p", "x"]
        for k, u, text, more, *place in differenced((row for batch in batches for row in batch.itertuples(index=False)), reach, probe):
            done.append((k, u, text, len(text or ""), more, *place))
            if len(done) == 1000:
                yield pd.DataFrame(done, columns=names)
                done = []
        yield pd.DataFrame(done, columns=names)

    return rows.mapInPandas(C.lean(run), f"k {key}, u {url}, text string, n_chars long, more boolean, h string, p string, x long")
