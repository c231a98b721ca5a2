"""Main text of web pages: markup zones, and differencing against the page of nearest URL.

A page is cut into lines (blocks of text in page order). Each line is in the main
zone (inside article or main), in a boilerplate zone (menus, headers, footers,
sidebars, notices, adverts, forms, comments; by element, or a whole role, id or
class) or open. An article or main inside a wrapper that only its label or a form
closed is an inner zone, and other text of such a form a form zone: they stand in
where the page has no main zone, or no open line either.
Pages are ordered by host and URL path, each page is paired with the neighbour
whose path shares the longest beginning (ties: the earlier one), and the lines of
the two are aligned by a longest common subsequence. Shared open lines are
deleted as template text, unless all open lines are shared: then the two pages
are copies, not siblings, and nothing is deleted. Pages with a main zone yield
that zone: an article keeps passages that it shares with a neighbour.

Defined results: null or empty html gives the empty text. A null url is a host
and path of its own (empty). Repeated rows and repeated page_ids each get a row,
judged on their own html; a row never pairs with itself, but may with its copy.
Pages alone in their host have no partner and lose nothing. An empty table gives
an empty result; further columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, written

MAIN, OPEN, BOILER, INNER, FORM = range(5)
PAIRS = 32  # pairs of equal lines per line up to which all pairs are gone through
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"hidden|style|class|id|role", re.IGNORECASE)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
# Elements of HTML by role.
RAW = frozenset("script style noscript template textarea svg math iframe object select title canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("nav aside footer header form head dialog button menu".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_LABELS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "popup promo related replies responses search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
) | frozenset(
    f"{a}-{b}"
    for first, second in (
        ("site main global top bottom primary secondary", "header footer nav navigation menu navbar sidebar banner"),
        ("cookie cookies consent gdpr", "banner notice bar popup modal consent"),
        ("ad ads advert", "slot box container banner wrapper unit"),
        ("comment comments", "list form area section thread"),
        ("share social sharing", "buttons links bar icons"),
        ("related", "posts articles links stories"),
        ("newsletter search login", "form box bar signup"),
        ("nav", "bar menu links"),
    )
    for a in first.split()
    for b in second.split()
)
#: Labels of places whose articles are never the page's own.
FOREIGN = re.compile(r"(?:ads?|adverts?|advertisement|comments?|disqus|newsletter|promo|related|replies|responses|sponsor(?:ed)?)(?:-|\Z)")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _marks(attributes: str) -> tuple[bool, set[str]]:
    """Whether a tag hides its element, and its boilerplate labels: whole classes, roles and id."""
    if not TELLING.search(attributes):
        return False, set()
    of: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        of.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    hidden = "hidden" in of or of.get("aria-hidden", "").strip() == "true" or NO_DISPLAY.search(of.get("style", "")) is not None
    return hidden, BOILER_LABELS.intersection(w.replace("_", "-") for k in ("class", "id", "role") for w in of.get(k, "").split())


class Tags:
    """Tags and comments of a page from left to right, in time linear in its length.

    A tag ends at the first > outside quotes; one that never ends is text. What a
    failed search has passed is remembered, so no part is searched again and again."""

    def __init__(self, html: str):
        self.html, self.dead, self.last = html, set(), html.rfind(">")
        self.sought, self.stop = 0, -1  # the first > or quote from `sought` on

    def _end(self, at: int) -> int:
        """Place after the > that closes a tag whose attributes start at `at`; -1 without one."""
        html, passed = self.html, []
        while at >= 0:
            if not self.sought <= at <= self.stop:
                found = STOP.search(html, at)
                self.sought, self.stop = at, found.start() if found else len(html)
            if self.stop == len(html) or self.stop in self.dead:
                break
            if html[self.stop] == ">":
                return self.stop + 1
            passed.append(self.stop)
            at = html.find(html[self.stop], self.stop + 1) + 1 or -1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name in lower case, attributes) of the next tag; the name is empty for comments and the like."""
        html = self.html
        while (s := html.find("<", at)) >= 0:
            if html.startswith("<!--", s):
                e = html.find("-->", s + 4)
                return s, e + 3 if e >= 0 else len(html), False, "", ""
            if s > self.last:
                at = html.find("<!--", s)
                if at < 0:
                    return None
                continue
            closes = html.startswith("/", s + 1)
            name = NAME.match(html, s + 1 + closes)
            if name is None:
                if html[s + 1 : s + 2] in ("!", "?", "/"):
                    return s, html.find(">", s) + 1, False, "", ""
            else:
                e = self._end(name.end())
                if e >= 0:
                    return s, e, closes, name[0].lower(), html[name.end() : e - 1]
                if closes:
                    return s, html.find(">", s) + 1, False, "", ""
            at = s + 1
        return None


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, zone) of every non-empty block of a page, in page order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    zones: list[list] = []  # [element, open elements of its name, zone, whether an article may still open in it]
    opened: Counter[str] = Counter()  # zones by element
    tags = Tags(html)
    zone, at, n = OPEN, 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((text, zone))
            held.clear()

    while at < n:
        tag = tags.next(at)
        if tag is None:
            held.append(html[at:])
            break
        start, end, closes, name, attributes = tag
        if start > at:
            held.append(html[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK:
            flush()
        if closes:
            if zones and zones[-1][0] == name:
                zones[-1][1] -= 1
                if not zones[-1][1]:
                    flush()
                    opened[zones.pop()[0]] -= 1
            elif opened[name] and (name in MAIN_TAGS or name in BOILER_TAGS):
                flush()
                while True:
                    gone = zones.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
            zone = zones[-1][2] if zones else OPEN
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\b", re.IGNORECASE).search(html, at)
                at = (html.find(">", close.end()) + 1 or n) if close else n
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        hidden, labels = _marks(attributes) if attributes and name not in ("html", "body") else (False, set())
        may = zones[-1][3] if zones else True
        foreign = any(FOREIGN.match(w) for w in labels)
        if name in MAIN_TAGS and zone != BOILER:
            into = {OPEN: MAIN, FORM: INNER}.get(zone, zone)
        elif name in MAIN_TAGS and may and not hidden and not foreign:
            into = INNER
        elif name == "form" and zone in (OPEN, FORM) and not hidden and not labels:
            into = FORM
        elif name == "header" and zone in (MAIN, INNER):
            into = BOILER if hidden else None
        elif name in BOILER_TAGS or hidden or labels:
            into = BOILER
            may = may and not hidden and not foreign and (name == "form" or name not in BOILER_TAGS)
        else:
            into = None
        if into is not None:
            flush()
            zones.append([name, 1, into, may and into not in (MAIN, INNER)])
            opened[name] += 1
            zone = into
        elif zones and zones[-1][0] == name:
            zones[-1][1] += 1
    flush()
    return out


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of `a` and each prefix of `b`, by bit vectors."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _chain(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` that a longest common subsequence uses, from all pairs of equal lines."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence of each length
    links: list[tuple] = []  # its last pair, as (place in a, pair before)
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` that a longest common subsequence of `a` and `b` uses.

    Where lines repeat so often that the pairs of equal ones are many, `a` is halved
    and `b` cut where the lengths for both halves sum to the most (Hirschberg), which
    keeps memory linear and the result exact."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        s, e, x, y = todo.pop()
        while s < e and x < y and a[s] == b[x]:
            out.append(s)
            s, x = s + 1, x + 1
        while s < e and x < y and a[e - 1] == b[y - 1]:
            e, y = e - 1, y - 1
            out.append(e)
        if s == e or x == y:
            continue
        of_b = Counter(b[x:y])
        if e - s < 2 or sum(of_b[v] for v in a[s:e]) <= PAIRS * (e - s + y - x):
            out.extend(s + i for i in _chain(a[s:e], b[x:y]))
            continue
        mid = (s + e) // 2
        cut = x + int(np.argmax(_prefix_lengths(a[s:mid], b[x:y]) + _prefix_lengths(a[mid:e][::-1], b[x:y][::-1])[::-1]))
        todo += [(s, mid, x, cut), (mid, e, cut, y)]
    return sorted(out)


def main_text(lines: list[tuple[str, int]], shared: list[int] | None) -> str:
    """The article: the main zone, or else the inner one, or else the open (or else form) lines that the partner does not share."""
    for zone in (MAIN, INNER):
        main = [t for t, z in lines if z == zone]
        if main:
            return "\n".join(main)
    gone, zone = set(shared or ()), OPEN if any(z == OPEN for _, z in lines) else FORM
    own = [t for i, (t, z) in enumerate(lines) if z == zone and i not in gone]
    return "\n".join(own or [t for t, z in lines if z == zone])


def _prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), a mark that tells rows of one page_id apart, host and path."""
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", "html", F.xxhash64("url", "html").alias("mark"), F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), path.alias("path")
    )


def partners(narrow: DataFrame) -> DataFrame:
    """(page_id, mark, p_id, p_mark): each page's neighbour in the order of host and path.

    The order is a range partitioning, so a host of any size is spread over tasks;
    places are numbered per partition and shifted by the counts before them."""
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["host", "path", "page_id", "mark"]
    placed = written(narrow.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "page-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(before, "part").select(*keys, (F.col("at").bitwiseAND((1 << 33) - 1) + F.coalesce("base", F.lit(0))).alias("place"))
    near = [F.struct((F.col("place") + d).alias("place"), F.lit(d).alias("side"), *keys) for d in (1, -1)]
    offered = placed.select(F.explode(F.array(*near)).alias("o")).select(F.col("o.place").alias("place"), F.col("o.host").alias("host"), F.col("o.side").alias("side"), F.col("o.path").alias("p_path"), F.col("o.page_id").alias("p_id"), F.col("o.mark").alias("p_mark"))
    alike = F.expr("aggregate(sequence(1, least(length(path), length(p_path)) + 1), 0, (k, i) -> if(k = i - 1 AND i <= least(length(path), length(p_path)) AND substring(path, i, 1) = substring(p_path, i, 1), i, k))")
    both = placed.join(offered, ["place", "host"]).select("place", "page_id", "mark", F.struct(alike.alias("alike"), "side", "p_id", "p_mark").alias("c"))
    return both.groupBy("place", "page_id", "mark").agg(F.max("c").alias("c")).select("page_id", "mark", F.col("c.p_id").alias("p_id"), F.col("c.p_mark").alias("p_mark"))


def _line_hashes(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars, n_shared."""
    whole = _prepared(pages)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lines_of(h) for h in batch.column("html").to_pylist()]
        size = np.array([len(x) for x in found])
        hashes = _line_hashes([t for x in found for t, _ in x])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(hashes))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "mark", "host", "path")), lists], names=["page_id", "mark", "host", "path", "lines"])

    narrow = written(whole.select("page_id", "mark", "host", "path", "html").mapInArrow(batched(cut, "html"), "page_id long, mark long, host string, path string, lines array<long>"), "page-lines")

    def align(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                shared = [common_lines(a or [], b or []) for a, b in zip(part.column("lines").to_pylist(), part.column("p_lines").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("mark"), pa.array(shared, pa.list_(pa.int32()))], names=["page_id", "mark", "shared"])

    own = narrow.select("page_id", "mark", "lines").dropDuplicates(["page_id", "mark"])
    theirs = own.select(F.col("page_id").alias("p_id"), F.col("mark").alias("p_mark"), F.col("lines").alias("p_lines"))
    pairs = partners(narrow).groupBy("page_id", "mark").agg(F.min(F.struct("p_id", "p_mark")).alias("p"))
    pairs = pairs.select(F.col("page_id").alias("a_id"), F.col("mark").alias("a_mark"), F.col("p.p_id").alias("b_id"), F.col("p.p_mark").alias("b_mark"))
    lined = pairs.join(own, F.col("a_id").eqNullSafe(F.col("page_id")) & (F.col("a_mark") == F.col("mark"))).join(theirs, F.col("b_id").eqNullSafe(F.col("p_id")) & (F.col("b_mark") == F.col("p_mark")))
    shared = written(lined.select("page_id", "mark", "lines", "p_lines").mapInArrow(align, "page_id long, mark long, shared array<int>"), "shared-lines")
    shared = shared.select(F.col("page_id").alias("s_id"), F.col("mark").alias("s_mark"), "shared")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = batch.column("shared").to_pylist()
        texts = [main_text(lines_of(h), s) for h, s in zip(batch.column("html").to_pylist(), shared, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(s or ()) for s in shared], pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_shared"],
        )

    joined = whole.select("page_id", "mark", "url", "html").join(shared.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")
    return joined.select("page_id", "url", "html", "shared").mapInArrow(batched(keep, "html"), "page_id long, url string, text string, n_chars long, n_shared long")
