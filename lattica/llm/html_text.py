"""Main text of web pages: structure proposes, nearest-URL page differencing decides.

A page's html is cut into text blocks, each of them in one of three zones: ``out`` (menus, headers, footers, sidebars,
adverts, forms, reader comments: by element, role, or a name that says nothing else), ``in`` (running text of the article
element) and ``open``: everything else, that is all blocks where a page marks no article, text outside of a marked one,
blocks of an article that are mostly links or whose name alone sounds like boilerplate. Pages of one host are sorted by
path; each page is aligned with the neighbour whose path agrees longest, by longest common subsequence of their blocks.
Shared open blocks are the host's template and go, open blocks of the page's own stay. Running text inside an article
stays: an article that two pages carry is no template, nor is a page that its neighbour copies as a whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Elements and names that hold no article text.
RAW = ("script", "style", "template", "textarea", "iframe", "noframes", "noembed", "xmp", "title", "svg", "math", "canvas", "audio", "video", "object")
OUT = ("nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "noscript", "head", "datalist", "search")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar")
#: Words that name boilerplate by themselves, and words that add nothing to them; a name made of both kinds is boilerplate.
NAMES = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "adunit", "adbanner", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "aside", "comment", "comments", "commentlist", "disqus", "respond", "replies", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "topbar", "bottombar",
    "share", "sharing", "social", "pagination", "pager", "skip", "toolbar", "paywall", "overlay",
)
#: Words that text of an article may bear too: they count outside of articles, and inside only as a hint for the alignment.
HINTS = ("notice", "notices", "alert", "warning", "disclaimer", "announcement", "login", "related", "recommended", "recommendations", "discussion", "responses", "advertorial", "widget")
FILLERS = (
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "side", "box", "slot", "unit", "bar", "list", "area", "section", "block", "container", "content", "wrapper", "wrap", "inner",
    "outer", "link", "links", "item", "items", "form", "header", "title", "text", "button", "buttons", "icons", "media", "post", "posts", "article", "articles", "story", "stories", "reader", "user", "js", "id", "message", "policy", "to",
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_OUT, _VOID, _INLINE, _ROLES, _NAMES, _HINTS, _FILLERS = map(frozenset, (OUT, VOID, INLINE, ROLES, NAMES, HINTS, FILLERS))
#: Elements that hold running text: no name makes what they hold boilerplate by itself inside an article.
_TEXTUAL = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dt", "dd", "figcaption", *INLINE))
KEEP, ASK, DROP = 0, 1, 2


def _named(value: str, in_article: bool) -> int:
    """What a class or an id says: DROP for boilerplate, ASK for a hint of it."""
    worst = KEEP
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        whole = "".join(parts)
        known = [whole] if whole in _NAMES or whole in _HINTS else parts
        if not in_article and known == ["header"]:
            worst = DROP
        elif all(p in _NAMES or p in _HINTS or p in _FILLERS for p in known):
            if any(p in _NAMES for p in known) or not in_article and any(p in _HINTS for p in known):
                worst = DROP
            elif any(p in _HINTS for p in known):
                worst = max(worst, ASK)
    return worst


def _unwanted(name: str, attrs: str, in_article: bool) -> int:
    """KEEP, ASK (the alignment decides) or DROP for an element's text."""
    if name in _OUT or name == "header" and not in_article:
        return DROP
    if not attrs or name in ("html", "body", "article", "main"):
        return KEEP
    worst = KEEP
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            said = _named(value, in_article)
            worst = max(worst, ASK if said == DROP and in_article and name in _TEXTUAL else said)
        elif key == "role" and value.lower() in _ROLES or key == "hidden" and value.lower() != "until-found":
            return DROP
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return DROP
    return worst


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block that has text, in page order."""
    page = page or ""
    stack: list[tuple[str, int, bool]] = []  # element, whether it is wanted, whether it is an article
    outer: list[int] = []  # places in the stack of those that are not inline
    many: Counter[str] = Counter()  # elements in the stack
    found: list[tuple[str, bool, str]] = []
    text: list[str] = []
    linked = bad = asked = articles = links = 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            found.append(("out" if bad else "open" if asked or linked > 0.5 * len(whole) else "in", articles > 0, whole))
        text.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal bad, asked, articles, links
        for element, said, was_article in stack[i:]:
            bad -= said == DROP
            asked -= said == ASK
            articles -= was_article
            links -= element == "a"
            many[element] -= 1
        del stack[i:]
        while outer and outer[-1] >= i:
            outer.pop()

    at, size, endless = 0, len(page), set()
    while at < size:
        tag = _TAG.search(page, at)
        upto = tag.start() if tag else size
        if upto > at:
            text.append(page[at:upto])
            if links:
                linked += upto - at
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if tag[1]:
            if many[name]:  # what is above the element it closes goes with it, so no place is looked at twice
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
        elif name in _RAW_END:
            if name not in ("svg", "math") or not tag[3].endswith("/"):  # these may close themselves
                end = None if name in endless else _RAW_END[name].search(page, at)
                if not end:
                    endless.add(name)
                at = end.end() if end else at if name in ("svg", "math", "object", "audio", "video", "canvas") else size
        elif name not in _VOID and not tag[3].endswith("/"):
            if name not in _INLINE and outer:  # a block ends an open paragraph, an item the one before
                last = stack[outer[-1]][0]
                if last == "p" or name == "li" == last:
                    close(outer[-1])
            is_article = name in ("article", "main") or 'role="main"' in tag[3]
            said = _unwanted(name, tag[3], articles > 0)
            if name not in _INLINE:
                outer.append(len(stack))
            stack.append((name, said, is_article))
            bad += said == DROP
            asked += said == ASK
            articles += is_article
            links += name == "a"
            many[name] += 1
    flush()
    return [("open" if zone == "in" and not inside else zone, t) for zone, inside, t in found]


#: Bytes of the table of a longest common subsequence at most; longer inputs are halved.
_TABLE = 1 << 22


def _rows(mine: list, other: list) -> list[int]:
    """For each beginning of mine a bit vector over other: bit j is 0 where the common subsequence grows with other[j]."""
    where: dict = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    out, v = [full], full
    for x in mine:
        m = where.get(x, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
        out.append(v)
    return out


def _last_row(mine: list, other: list) -> np.ndarray:
    """Lengths of the common subsequences of mine and other[:j] for every j."""
    where: dict = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    v = full = (1 << len(other)) - 1
    for x in mine:
        m = where.get(x, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_places(mine: list, other: list) -> list[int]:
    """Places of mine in a longest common subsequence with other, by bit vectors: 64 pairs of lines a step, memory bounded."""
    out, todo = [], [(0, len(mine), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and mine[a] == other[c]:
            out.append(a)
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == other[d - 1]:
            out.append(b - 1)
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        x, y = mine[a:b], other[c:d]
        if len(x) == 1 or len(x) * len(y) <= 8 * _TABLE:
            rows = _rows(x, y)
            i, j = len(x), len(y)
            while i and j:
                if not rows[i] >> (j - 1) & 1 and rows[i - 1] >> (j - 1) & 1 and x[i - 1] == y[j - 1]:
                    out.append(a + i - 1)
                    i, j = i - 1, j - 1
                elif not rows[i] >> (j - 1) & 1 and not rows[i - 1] >> (j - 1) & 1:
                    i -= 1
                elif rows[i] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
            continue
        half = len(x) // 2
        k = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
        todo += [(a, a + half, c, c + k), (a + half, b, c + k, d)]
    return sorted(out)


def _hashed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            found = [[xxhash.xxh3_64_intdigest(t) - 2**63 for _, t in blocks_of(p.as_py())] for p in batch.column("html").slice(a, 200)]
            yield pa.record_batch([*(batch.column(c).slice(a, 200) for c in ("key", "host", "path")), pa.array(found, pa.list_(pa.int64()))], names=["key", "host", "path", "blocks"])


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _differenced(batches):
    """Shared blocks of each page with the nearer one of its two neighbours; rows come sorted."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "host", "path", "key", "ghost", "blocks")), strict=True)

    def near(row, other):
        return other is not None and other[:2] == row[:2]

    def out(before, row, after):
        sides = [x for x in (before, after) if near(row, x)]
        best = max(sides, key=lambda x: _alike(row[2], x[2]), default=None)
        return row[3], common_places(row[5], best[5]) if best else []

    held, before, row = [], None, None
    for after in rows():
        if row and not row[4]:
            held.append(out(before, row, after))
        before, row = row, after
        if len(held) == 500:
            yield pa.record_batch([pa.array([k for k, _ in held], pa.binary()), pa.array([s for _, s in held], pa.list_(pa.int32()))], names=["key", "shared"])
            held = []
    if row and not row[4]:
        held.append(out(before, row, None))
    if held:
        yield pa.record_batch([pa.array([k for k, _ in held], pa.binary()), pa.array([s for _, s in held], pa.list_(pa.int32()))], names=["key", "shared"])


def main_text(blocks: list[tuple[str, str]], shared: list[int]) -> str:
    """The blocks that stay, joined by line ends."""
    places = set(shared)
    opened = [i for i, (zone, _) in enumerate(blocks) if zone == "open"]
    copied = all(i in places for i, (zone, _) in enumerate(blocks) if zone != "out")  # the neighbour is a copy
    gone = set() if copied else {i for i in opened if i in places}
    return "\n".join(t for i, (zone, t) in enumerate(blocks) if zone != "out" and i not in gone)


def _texts(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            pages, shared = batch.column("html").slice(a, 200).to_pylist(), batch.column("shared").slice(a, 200).to_pylist()
            texts = [main_text(blocks_of(p), s or []) for p, s in zip(pages, shared, strict=True)]
            yield pa.record_batch([batch.column("page_id").slice(a, 200), batch.column("url").slice(a, 200), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by line ends, empty if none) and n_chars.

    Null and empty pages have an empty text; a null url is a host and path of its own. Rows that repeat give a row each;
    they are one page when neighbours are sought. Other columns are ignored. A page may be of any length: parsing takes time in
    proportion to it, an alignment the product of the pages' lines, 64 pairs a step.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(page, F.lit("")).alias("html"))
    # 128 bits of all that a row is: equal keys are equal rows
    whole = F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("\x1e")), "html")
    own = own.withColumn("key", F.unhex(F.md5(whole)))
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://|[?#].*$", "")
    split = own.select("key", F.lower(F.substring_index(plain, "/", 1)).alias("host"), F.regexp_replace(plain, "^[^/]*", "").alias("path"), "html")
    light = split.mapInArrow(_hashed, "key binary, host string, path string, blocks array<long>")
    ranged = light.dropDuplicates(["key"]).repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    ranged = table(ranged, "ranged")
    # a task's first and last page have a neighbour in another task
    row = F.struct("host", "path", "key", "blocks")
    ends = ranged.groupBy("part").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    beside = ends.select("part", F.lag("hi").over(Window.orderBy("part")).alias("prev"), F.lead("lo").over(Window.orderBy("part")).alias("next"))  # two rows for each task
    ghosts = beside.select("part", F.explode(F.array("prev", "next")).alias("g")).where("g is not null").select("part", "g.*", F.lit(True).alias("ghost"))
    cols = ["part", "host", "path", "key", "ghost", "blocks"]
    sorted_ = ranged.withColumn("ghost", F.lit(False)).select(cols).union(ghosts.select(cols)).repartition("part").sortWithinPartitions("part", "host", "path", "key")
    shared = sorted_.mapInArrow(_differenced, "key binary, shared array<int>")
    return own.join(shared, "key", "left").select("page_id", "url", "html", "shared").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
