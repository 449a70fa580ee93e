"""Main text of web pages by differencing against the nearest page, held in bounds by structure.

A page is cut into lines, one for each block of text.  Elements and class words that
can only be page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments) take their lines out; every other line knows whether it stands in the article
or the main part, whether its class is a mere hint of furniture (share-price may be
content, share-links may not), and whether its block is a paragraph or heading.

Pages of a host are ordered by URL path, and every page is paired with that one of its
two neighbours whose path has the longer common beginning.  Their lines are aligned by
longest common subsequence, and shared lines are deleted, as far as what the page says
about itself leaves that open:

- without article or main part every shared line goes;
- of a main part (<main>, role or class) those shared at its edges;
- of an article, with what stands around it in a main part, those at its edges in blocks
  other than the article's own paragraphs and headings, unless half the lines or more
  are shared, since the pages are copies of each other then;
- and everywhere those in blocks with a hint.

Paragraphs and headings of an explicit article stay, shared or not: near copies of an
article stand on neighbouring pages, and a page must keep its article whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
#: Characters within which quotes in a tag are paired; a longer tag ends at its first ``>``.
_LONGEST_TAG = 65_536
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")

# Element names and the words that mark page furniture.
RAW = set("script style textarea title noscript template iframe xmp".split())
FURNITURE = set("nav header footer aside form menu dialog button select svg canvas object audio video figure-ad head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs crumbs header masthead footer sidebar aside widget widgets toolbar"
    " notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations pagination pager"
    " comment comments commentlist disqus respond replies reply reader-comments skip skip-link skiplink form legal disclaimer copyright".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ARTICLE_MARKS = set("article article-body articlebody post-content entry-content main-content story story-body post-body".split())

#: Marks that are a mere hint inside an article, where differencing decides.
WEAK = set("legal disclaimer copyright notice notices alert form".split())
#: Classes of articles that are not the page's own.
COMMENT_ARTICLES = set("comment comments reply ad ads advert promo related".split())

#: Words that go with a furniture word in one class without making it something else (site-header, cookie-notice-box).
LAYOUT = set(
    "site page global main top bottom left right inner outer box bar bars block container wrapper wrap area section panel list lists item items link links button buttons icon icons bg row col column content body text title heading wide mobile desktop fixed sticky"
    " user reader readers post posts article articles blog primary secondary sub sec js is has the my c l u a b x 1 2 3 4 5 6 7 8 9".split()
)

#: What is known of a line's place; LOOSE: its block is no paragraph or heading; HINT: its class hints at furniture.
NEUTRAL, ARTICLE, MAIN, LOOSE, HINT = 0, 1, 2, 4, 8
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt address summary".split())
_LOW = {i: i + 32 for i in range(65, 91)}


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each piece of markup; comments and declarations have no name.

    Each character is looked at a bounded number of times: what has no end is text, or ends
    at the next ``>``.
    """
    at, no_cdata = 0, False
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        if not no_cdata and page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            no_cdata = end < 0
            if end >= 0:
                at = end + 3
                yield start, at, "", "", ""
                continue
        m = _NAME.match(page, start)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        end = _tag_end(page, m.end()) if m else page.find(">", start)
        if end < 0:
            return  # no tag ends after this place
        at = end + 1
        yield (start, at, m[1], m[2].lower(), page[m.end() : end]) if m else (start, at, "", "", "")


def _tag_end(page: str, begin: int) -> int:
    """Place of the ``>`` that ends a tag: outside quotes, or the first one where quotes are not paired."""
    at, limit = begin, begin + _LONGEST_TAG
    while m := _STOP.search(page, at, limit):
        if m[0] == ">":
            return m.start()
        other = page.find(m[0], m.end(), limit)
        if other < 0:
            break
        at = other + 1
    return page.find(">", begin)


#: Why an element may be furniture: not at all, by its class only, as an article of that class, or by what it is.
NO, BY_CLASS, BY_WEAK_CLASS, BY_ARTICLE_CLASS, BY_NATURE = range(5)


class _Element:
    __slots__ = ("article", "furniture", "holds", "inline", "name", "place")

    def __init__(self, name: str, furniture: int, place: int):
        self.name, self.furniture, self.place = name, furniture, place
        self.inline, self.holds = name in INLINE, False
        self.article = place in (ARTICLE, MAIN) and not furniture


def _events(page: str) -> list[tuple[int, object]]:
    """(1, element) where one begins, (-1, element) where it ends, (0, text), (2, block break or not) in page order; every element ends."""
    events: list[tuple[int, object]] = []
    stack: list[_Element] = []
    places: dict[str, list[int]] = {}  # where elements of a name stand on the stack
    furniture: list[int] = []
    low = page.translate(_LOW)  # as long as the page, unlike lower()
    ends: dict[str, int] = {}

    def last_end(name: str) -> int:
        if name not in ends:
            ends[name] = low.rfind(f"</{name}")
        return ends[name]

    def close(k: int) -> None:
        while len(stack) > k:
            e = stack.pop()
            places[e.name].pop()
            if furniture and furniture[-1] == len(stack):
                furniture.pop()
            if stack and (e.holds or e.article):
                stack[-1].holds = True
            events.append((-1, e))

    done = 0
    for start, end, slash, name, attributes in _tokens(page):
        if start < done:  # inside a script or the like
            continue
        events.append((0, page[done:start]))
        done = end
        if not name:
            continue
        if name in VOID:
            if name in ("hr", "br"):
                events.append((2, name == "hr"))
            continue
        if slash or name not in INLINE:
            if name not in INLINE:
                events.append((2, name not in ("td", "th")))
        if slash:
            own = places.get(name)
            if own and not (name in INLINE and furniture and furniture[-1] > own[-1]):
                close(own[-1])
            continue
        if attributes.endswith("/"):
            continue
        if name in RAW:
            over = low.find(f"</{name}", end) if last_end(name) >= end else -1
            gone = page.find(">", over) if over >= 0 else -1
            done = gone + 1 if gone >= 0 else len(page)
            continue
        kind, place = _kind(name, attributes)
        # Furniture that is never closed would swallow the page.
        if kind and last_end(name) < end:
            kind = NO
        if name == "p" and places.get("p") and all(e.inline for e in stack[places["p"][-1] + 1 :][:_NESTED]):  # a paragraph ends the one before it
            close(places["p"][-1])
        places.setdefault(name, []).append(len(stack))
        if kind:
            furniture.append(len(stack))
        stack.append(_Element(name, kind, place))
        events.append((1, stack[-1]))
    events.append((0, page[done:]))
    close(0)
    return events


#: Inline elements between two paragraphs that are looked through.
_NESTED = 64


def lines(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block of a page outside its furniture, in page order.

    An element that holds an article or a main part is no furniture for its class or for
    being a form, an article is none for its class unless the page has another, and inside
    an article some classes are a mere hint.
    """
    events = _events(page)
    elsewhere = any(kind == 1 and e.article for kind, e in events)
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    blocks: list[str] = []
    skipped, inside = 0, {NEUTRAL: 0, ARTICLE: 0, MAIN: 0, HINT: 0}
    opened: list[tuple[bool, int]] = []

    def close_block() -> None:
        if parts:
            text = re.sub(r"\s+", " ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                place = ARTICLE if inside[ARTICLE] else MAIN if inside[MAIN] else NEUTRAL
                found.append((place + (LOOSE if place == ARTICLE and (blocks[-1] if blocks else "") not in PARAGRAPHS else 0) + (HINT if inside[HINT] else 0), text))

    for kind, what in events:
        if kind == 0:
            if not skipped and what:
                parts.append(what)
        elif kind == 2:
            if not skipped:
                close_block() if what else parts.append(" ")
        elif kind == 1:
            by_class = what.furniture == BY_CLASS or (what.furniture == BY_WEAK_CLASS and not inside[ARTICLE]) or (what.furniture == BY_ARTICLE_CLASS and elsewhere)
            gone = what.furniture == BY_NATURE or (by_class and not what.holds)
            place = HINT if what.furniture == BY_WEAK_CLASS and inside[ARTICLE] else what.place
            if not skipped and place and not gone and not inside[place]:
                close_block()
            opened.append((gone, NEUTRAL if gone or skipped else place))
            skipped += gone
            inside[opened[-1][1]] += 1
            if not what.inline:
                blocks.append(what.name)
        else:
            gone, place = opened.pop()
            if not skipped and place:
                close_block()
            skipped -= gone
            inside[place] -= 1
            if not what.inline:
                blocks.pop()
    close_block()
    return found


def _kind(name: str, attributes: str) -> tuple[int, int]:
    """(why it may be furniture, place) of an element."""
    furniture, article, hint = (BY_CLASS if name == "form" else BY_NATURE) if name in FURNITURE else NO, {"article": ARTICLE, "main": MAIN}.get(name, NEUTRAL), False
    if attributes and name not in ("html", "body"):
        for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            key = key.lower()
            if hidden or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (key == "aria-hidden" and value == "true"):
                furniture = BY_NATURE
            elif key in ("class", "id"):
                words = value.split()
                marks = [_marked(x) for x in words]
                if not article and True in marks and not set(words) & ARTICLE_MARKS:
                    weak = all({x, *re.split(r"[-_]+", x)} & MARKS <= WEAK for x, m in zip(words, marks, strict=True) if m)
                    if furniture in (NO, BY_WEAK_CLASS):
                        furniture = BY_WEAK_CLASS if weak else BY_CLASS
                elif article and set(words) & COMMENT_ARTICLES:
                    furniture = furniture or BY_ARTICLE_CLASS
                elif not article and None in marks and not set(words) & ARTICLE_MARKS:
                    hint = True
                elif set(words) & ARTICLE_MARKS:
                    article = ARTICLE if article == ARTICLE or set(words) & (ARTICLE_MARKS - {"main-content"}) else MAIN
            elif key == "role":
                furniture = BY_NATURE if value in ROLES else furniture
                article = ARTICLE if value == "article" else MAIN if value == "main" and article != ARTICLE else article
    return furniture, article or (HINT if hint else NEUTRAL)


def _marked(word: str) -> bool | None:
    """Whether a class is furniture: True, False, or None where a furniture word is only a part of another name."""
    if word in MARKS:
        return True
    parts = set(re.split(r"[-_]+", word))
    if not parts & MARKS:
        return False
    return True if parts <= MARKS | LAYOUT else None


def split_url(url: str) -> tuple[str, str]:
    """(host in lower case, path with query) of a URL; anything else is a path without host."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    return (m[1].lower().rsplit("@", 1)[-1], m[2] or "/") if m else ("", url)


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``, in linear memory."""
    theirs, own = set(other), set(mine)
    x = [i for i, h in enumerate(mine) if h in theirs]  # no other line can be shared
    y = [h for h in other if h in own]
    found: list[int] = []
    _align(np.array([mine[i] for i in x], np.int64), np.array(y, np.int64), 0, found)
    return [x[i] for i in found]


def _align(a: np.ndarray, b: np.ndarray, at: int, found: list[int]) -> None:
    """Hirschberg's division: appends the places of a (counted from ``at``) that a longest common subsequence takes."""
    n = min(len(a), len(b))
    equal = a[:n] == b[:n]
    head = n if equal.all() else int(equal.argmin())
    found += range(at, at + head)
    a, b, at = a[head:], b[head:], at + head
    n = min(len(a), len(b))
    equal = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if equal.all() else int(equal.argmin())
    last = range(at + len(a) - tail, at + len(a))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) == 1:
        found += [at] if (b == a[0]).any() else []
    elif len(a) and len(b):
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        _align(a[:half], b[:cut], at, found)
        _align(a[half:], b[cut:], at + half, found)
    found += last


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with b[:j], for every j."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def at_edges(shared: list[int], places: list[int]) -> list[int]:
    """Shared lines at the beginning and end of ``places``; none if all are shared."""
    known = set(shared)
    own = [i for i, x in enumerate(places) if x not in known]
    return places[: own[0]] + places[own[-1] + 1 :] if own else []


def deleted(places: list[int], lines_at: list[int], shared: list[int]) -> list[int]:
    """Which of a page's chosen blocks go, by the rules above: ``places`` and positions of the blocks, positions of shared lines."""
    common = set(shared)
    of_block = [i for i, at in enumerate(lines_at) if at in common]
    if not of_block:
        return []
    hints = [i for i in of_block if places[i] & HINT]
    if any(p & ARTICLE for p in places):
        edges = at_edges(of_block, list(range(len(places)))) if 2 * len(of_block) < len(places) else []
        return sorted({*hints, *_outer(edges, places)})
    if places[0] & MAIN:
        return sorted({*hints, *at_edges(of_block, list(range(len(places))))})
    return of_block


def _outer(edges: list[int], places: list[int]) -> list[int]:
    """Of shared blocks at the edges, those up to the first paragraph or heading from either end."""
    n, a, z = len(places), 0, 0
    known = set(edges)
    while a < n and a in known and (places[a] & LOOSE or not places[a] & ARTICLE):
        a += 1
    while z < n - a and n - 1 - z in known and (places[n - 1 - z] & LOOSE or not places[n - 1 - z] & ARTICLE):
        z += 1
    return [*range(a), *range(n - z, n)]


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("blocks", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("lines_at", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
#: Deletions are broadcast if they are so many numbers at most; else they are joined by shuffle.
BROADCAST_NUMBERS = 200_000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for page_id, url, page in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = lines(page or "")
                known = 0
                for place, _ in found:
                    known |= place
                # Article and main part if there are any, else all lines.
                want = known & (ARTICLE | MAIN)
                chosen = [i for i, (place, _) in enumerate(found) if not want or place & want]
                host, path = split_url(url or "")
                hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for _, t in found]
                rows.append((page_id, url, host, path, [found[i][1] for i in chosen], [found[i][0] for i in chosen], chosen, hashes))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_PARSED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)], schema=_PARSED)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, blocks to delete) of pages that lose any, from pages with their two neighbours."""
    for batch in batches:
        keys, drops = [], []
        for r in batch.to_pylist():
            sides = [s for s in (r["before"], r["after"]) if s and s["host"] == r["host"]]
            if not sides:
                continue
            nearest = max(sides, key=lambda s: _common(s["path"] or "", r["path"] or ""))
            if nearest["hashes"] != r["hashes"]:
                drop = deleted(r["places"], r["lines_at"], shared_lines(r["hashes"], nearest["hashes"]))
                if drop:
                    keys.append(r["key"])
                    drops.append(drop)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(drops, pa.list_(pa.int32()))], names=["key", "drop"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text.

    Blocks of text in page order, joined by two line feeds; character references are
    decoded and white space inside a block is one space.  Null and empty html, and
    pages of nothing but furniture, give an empty text.  A null url belongs to the
    empty host.  Every page is compared with its nearest page and loses what the rules
    above say; an only page of a host loses nothing.  Repeated rows are pages of their
    own, and if they are neighbours they differ in nothing, so that equal pages do not
    erase each other.  Long pages are read whole, and markup that is never closed
    swallows nothing; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = p.mapInArrow(_parse, "page_id bigint, url string, host string, path string, blocks array<string>, places array<int>, lines_at array<int>, hashes array<bigint>")
    parsed = tables.written(parsed.withColumn("key", F.monotonically_increasing_id()), "parsed-pages")

    # Neighbours in (host, path) order: by range, so that a large host is many tasks, and across the ranges' edges.
    order = ["host", "path", "page_id", "key"]
    with tables.temporary(spark):
        slim = parsed.select(*order, "places", "lines_at", "hashes").repartitionByRange(tables.partitions(spark), *order).withColumn("range", F.spark_partition_id())
        slim = tables.written(slim, "page-order")
        one = F.struct("host", "path", "hashes")
        within = Window.partitionBy("range").orderBy(*order)
        edges = slim.groupBy("range").agg(F.min_by(one, F.struct(*order)).alias("head"), F.max_by(one, F.struct(*order)).alias("tail"))
        across = Window.orderBy("range")  # one row for each range
        edges = edges.select("range", F.lag("tail").over(across).alias("left"), F.lead("head").over(across).alias("right"))
        near = slim.withColumn("before", F.lag(one).over(within)).withColumn("after", F.lead(one).over(within)).join(edges, "range")
        near = near.select("key", "host", "path", "places", "lines_at", "hashes", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
        drops = tables.stay(near.mapInArrow(_difference, "key bigint, drop array<int>"), "page-deletions")
    if (drops.agg(F.sum(F.size("drop") + 1)).first()[0] or 0) <= BROADCAST_NUMBERS:
        drops = F.broadcast(drops)
    kept = F.when(F.col("drop").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda _, i: ~F.array_contains("drop", i)))
    return parsed.join(drops, "key", "left").select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
