"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words, at the beginning of a
sentence too, but for words such as The or What) and units (unit words after a number)
are replaced by typed placeholders, other words are lower-cased.  Windows of five
template words of every document are hash-joined with those of the benchmark.  A
document holds an item if at least four fifths of the item's windows, repeated ones as
often as the item has them, stand close together in it and the slots agree: with the
item laid along the document in order, each word at one place, the words that its
placeholders stand for must map to the document's words one to one, so that a question
with other numbers or names is still found, and a passage that only has the same shape
is not.

Case tells names, so a copy in capitals or small letters alone has another template:
items are looked for a second time with names as words.  An item of hardly more than
placeholders is looked for by its words, and windows of placeholders alone are asked for
only where an item's other windows are.

An item of fewer than five words is a single window and is found in texts that are as
short, not inside longer ones: its wording alone proves nothing there.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrowtext, tables
from .arrowtext import U64

WINDOW = 5
SHARE = 0.8
#: Benchmark windows that may be held in every worker (16 bytes each); beyond it the windows are joined by shuffle.
HELD_WINDOWS = 1_000_000

# Unit words.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms tonne tonnes ton tons pound pounds ounce ounces ml l litre litres liter liters gallon gallons s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh watt watts volt volts joule joules kb mb gb tb".split()

# Words that begin sentences and are no names.
STARTERS = (
    "a an the this that these those there here what which who whom whose when where why how if then else so and or but nor for yet in on at by to of from with without within into onto over under after before during while since until between among through about as because although though unless"
    " he she it they we you i his her its their our your my is are was were be been do does did has have had can could will would shall should may might must not no yes each every all any some both many much more most one two three four five six seven eight nine ten"
    " find give let given suppose consider calculate compute determine solve show prove explain describe write list name choose select complete continue evaluate assume note also however therefore thus hence finally first second next now later once"
).split()

_KIND = np.zeros(256, np.uint8)  # 0 between words, 1 letter, 2 digit
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_NUMBER, _NAME, _UNIT = U64(11), U64(12), U64(13)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    hashes, _, _, _ = arrowtext.byte_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return np.sort(hashes)


_unit_hashes, _starter_hashes = _hash_words(UNITS), _hash_words(STARTERS)


def _among(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


#: Template words up to it are placeholders.
_PLACEHOLDERS = U64(16)
#: Forms in which texts are compared: names, numbers and units as placeholders; names as words, so that case says nothing; words alone.
CASED, UNCASED, VERBATIM = range(3)


def forms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(template word hashes in each form, hashes of the words themselves, first word of each row)."""
    kind = _KIND[data]
    inside = kind > 0
    # Points and commas between digits belong to the number.
    if len(data) > 2:
        joint = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)
        inside[1:-1] |= joint
    starts, ends, first = arrowtext.runs(inside, offsets)
    lower = arrowtext.LOWER[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1: two bytes, of which the second tells the case
    accented = accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]
    lower[accented] += 0x20
    word = arrowtext.run_hashes(lower, starts, ends)
    n = len(starts)
    if not n:
        return [word, word, word], word, first
    number = kind[starts] == 2
    two = np.where(starts + 1 < len(data), data[np.minimum(starts + 1, len(data) - 1)], 0)
    capital = ((data[starts] >= 65) & (data[starts] <= 90)) | ((data[starts] == 0xC3) & (two >= 0x80) & (two <= 0x9E))
    name = capital & ~number & ~_among(_starter_hashes, word)
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1]
    after_number[first[:-1][first[:-1] < n]] = False
    unit = after_number & _among(_unit_hashes, word)
    uncased = np.where(number, _NUMBER, np.where(unit, _UNIT, word))
    return [np.where(name & ~unit, _NAME, uncased), uncased, word], word, first


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template word hashes with names as placeholders, hashes of the words themselves, first word of each row)."""
    found, word, first = forms(data, offsets)
    return found[CASED], word, first


def windows(template: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows (hash, row, position); a row with fewer words is one window."""
    h, rows, at = arrowtext.rolling(template, first, WINDOW)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < WINDOW))
    if len(short):
        whole = arrowtext.run_hashes(template, first[short], first[short + 1])
        h, rows, at = np.concatenate([h, whole]), np.concatenate([rows, short]), np.concatenate([at, np.zeros(len(short), np.int64)])
    return h, rows, at


def bare(template: np.ndarray, first: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows hold placeholders alone."""
    words = np.concatenate([[0], np.cumsum(template > _PLACEHOLDERS)])
    begin = first[rows] + at
    return words[np.minimum(begin + WINDOW, first[rows + 1])] == words[begin]


def item_windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(form, is the item looked for in it, hash, row, position and bareness of each window) for each form.

    An item most of whose windows are placeholders alone has no wording to be known by: it
    is looked for by its words.  Others are by their template, and by the one with names as
    words too where that is another one.
    """
    found, _, first = forms(data, offsets)
    h, rows, at = windows(found[CASED], first)
    empty = bare(found[CASED], first, rows, at)
    n = len(offsets) - 1
    shapeless = 2 * np.bincount(rows[empty], minlength=n) > np.bincount(rows, minlength=n)
    differ = np.concatenate([[0], np.cumsum(found[CASED] != found[UNCASED])])
    named = differ[first[1:]] > differ[first[:-1]]
    yield CASED, ~shapeless, h, rows, at, empty
    for form, used in ((UNCASED, named & ~shapeless), (VERBATIM, shapeless)):
        h, rows, at = windows(found[form], first)
        yield form, used, h, rows, at, bare(found[form], first, rows, at)


def _aligned(pairs: list[tuple[int, int]], shift: int) -> dict[int, int]:
    """Item words to document words, one to one and in order: windows at ``shift`` first, others (insertions) where these leave gaps."""
    to: dict[int, int] = {}
    known: list[int] = []
    for p, q in sorted(pairs, key=lambda x: (abs(x[1] - x[0] - shift), x)):
        for a, b in zip(range(p, p + WINDOW), range(q, q + WINDOW)):
            if a in to:
                continue
            i = bisect.bisect(known, a)
            if (not i or to[known[i - 1]] < b) and (i == len(known) or b < to[known[i]]):
                known.insert(i, a)
                to[a] = b
    return to


def _agree(item_t: np.ndarray, item_w: np.ndarray, doc_w: np.ndarray, to: dict[int, int]) -> tuple[int, bool]:
    """(slots compared, whether item words and document words in slots map one to one)."""
    forth: dict[int, int] = {}
    back: dict[int, int] = {}
    clashes = slots = 0
    for p, q in sorted(to.items()):
        if p >= len(item_t) or q >= len(doc_w) or item_t[p] > _PLACEHOLDERS:
            continue
        slots += 1
        a, b = int(item_w[p]), int(doc_w[q])
        if forth.setdefault(a, b) != b or back.setdefault(b, a) != a:
            clashes += 1
    return slots, clashes * 5 <= slots


class _Windows:
    """Windows of the items that are looked for in one form, sorted by hash; those of placeholders alone by item."""

    def __init__(self, h: np.ndarray, row: np.ndarray, at: np.ndarray, empty: np.ndarray):
        self.bare: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero(empty):
            self.bare.setdefault(int(row[i]), {}).setdefault(int(h[i]), []).append(int(at[i]))
        h, row, at = h[~empty], row[~empty], at[~empty]
        order = np.argsort(h, kind="stable")
        self.hash, self.row, self.at = h[order], row[order], at[order]
        # Few windows are looked up at once; for many, a table of the first bits spares most lookups.
        self.filter = None
        if len(h) > 4096:
            self.filter = np.zeros(1 << 20, bool)
            self.filter[(self.hash >> U64(44)).astype(np.int64)] = True

    def hits(self, need: np.ndarray, h: np.ndarray, rows: np.ndarray, at: np.ndarray, empty: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row of a text, item, its hits: position in the text, in the item, hash) where an item may stand.

        Windows of placeholders alone stand nearly everywhere, so they are asked for only
        where those with words suffice for the item together with them.
        """
        worded = ~empty if self.filter is None else ~empty & self.filter[(h >> U64(44)).astype(np.int64)]
        k = np.flatnonzero(worded)
        lo, hi = np.searchsorted(self.hash, h[k], "left"), np.searchsorted(self.hash, h[k], "right")
        times = hi - lo
        if not times.any():
            return
        m, j = np.repeat(k, times), np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        row, item = rows[m], self.row[j]
        order = np.lexsort([at[m], item, row])
        m, j, row, item = m[order], j[order], row[order], item[order]
        heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        e = np.flatnonzero(empty)
        e = e[np.argsort(rows[e], kind="stable")]
        for a, b in zip(heads, np.append(heads[1:], len(row)), strict=True):
            r, i = int(row[a]), int(item[a])
            own = self.bare.get(i, {})
            least = SHARE * need[i] - sum(map(len, own.values()))
            if b - a < least or len(np.unique(at[m[a:b]])) < least:
                continue
            got = list(zip(at[m[a:b]].tolist(), self.at[j[a:b]].tolist(), h[m[a:b]].tolist(), strict=True))
            if own:
                near = e[np.searchsorted(rows[e], r, "left") : np.searchsorted(rows[e], r, "right")]
                got += [(q, p, x) for x, places in own.items() for q in at[near[h[near] == U64(x)]].tolist() for p in places]
            yield r, i, got


class Index:
    """The benchmark's windows in every form."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self.template, self.word, self.first = forms(data, offsets)
        self.windows: list[_Windows] = []
        for _, used, h, rows, at, empty in item_windows(data, offsets):
            mine = used[rows]
            self.windows.append(_Windows(h[mine], rows[mine], at[mine], empty[mine]))
            self.need = np.bincount(rows, minlength=len(items))  # as many in each form

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
        """(row, item_id, first word, windows found, share, slots) for every item held by a text, in the first form that holds it."""
        template, word, first = forms(data, offsets)
        found: dict[tuple[int, int], tuple[int, int, int, int, float, int]] = {}
        for form, mine in enumerate(self.windows):
            if not len(mine.hash):
                continue
            h, rows, at = windows(template[form], first)
            for row, item, got in mine.hits(self.need, h, rows, at, bare(template[form], first, rows, at)):
                if (row, item) in found:
                    continue
                span = slice(self.first[item], self.first[item + 1])
                held = self._held(got, int(self.need[item]), span.stop - span.start, self.template[form][span], self.word[span], word[first[row] : first[row + 1]])
                if held:
                    start, n, slots = held
                    found[row, item] = (row, self.ids[item], start, n, n / int(self.need[item]), slots)
        return [found[k] for k in sorted(found)]

    @staticmethod
    def _held(got: list[tuple[int, int, int]], need: int, length: int, item_t: np.ndarray, item_w: np.ndarray, doc_w: np.ndarray) -> tuple[int, int, int] | None:
        """(first word, windows found, slots) of the first place that holds the item, the one with most windows first."""
        places: dict[int, list[int]] = {}
        key: dict[int, int] = {}
        for q, p, x in got:
            places.setdefault(q, []).append(p)
            key[q] = x
        at = sorted(places)
        if len(at) < SHARE * need:
            return None
        # Windows of the item within reach before each place; one that the item repeats counts as often as it stands in both.
        reach = max(WINDOW, int(1.5 * length))
        seen: dict[int, int] = {}
        n = lo = 0
        ends: list[tuple[int, int, int]] = []
        for k, q in enumerate(at):
            seen[key[q]] = seen.get(key[q], 0) + 1
            n += seen[key[q]] <= len(places[q])
            while at[lo] < q - reach:
                n -= seen[key[at[lo]]] <= len(places[at[lo]])
                seen[key[at[lo]]] -= 1
                lo += 1
            ends.append((n, -lo, k))
        best = max(ends)
        if best[0] < SHARE * need:
            return None
        # Where a window matches several places, the item may stand at any shift that has most windows among those
        # near it: the usual one of the best place is tried first, the others must hold the item's share of windows by themselves.
        shifts: dict[int, list[int]] = {}
        for q in at:
            for p in places[q]:
                shifts.setdefault(q - p, []).append(q)
        near: dict[int, int] = {}
        for q in at[-best[1] : best[2] + 1]:
            for p in places[q]:
                near[q - p] = near.get(q - p, 0) + 1
        usual = max(near, key=lambda s: (near[s], -s))
        for s in [usual, *sorted(shifts.keys() - {usual}, key=lambda s: (-len(shifts[s]), s))]:
            if s != usual:
                if any(len(shifts.get(s + d, ())) > len(shifts[s]) for d in range(-WINDOW, WINDOW + 1)):
                    continue
                k = bisect.bisect_left(at, shifts[s][-1])
                best = max(ends[k : max(k + 1, bisect.bisect_right(at, shifts[s][0] + reach))])
                if best[0] < SHARE * need:
                    continue
            pairs = [(p, q) for q in at[-best[1] : best[2] + 1] for p in places[q] if abs(q - p - s) <= WINDOW]
            to = _aligned(pairs, s)
            if s != usual and len({p for p, q in pairs if all(to.get(p + d) == q + d for d in range(WINDOW))}) < SHARE * need:
                continue
            slots, agree = _agree(item_t, item_w, doc_w, to)
            if agree:
                return at[-best[1]], best[0], slots
        return None


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("windows", pa.int64()), ("share", pa.float64()), ("slots", pa.int64())])
_FOUND_DDL = "doc_id bigint, item_id bigint, first_word bigint, windows bigint, share double, slots bigint"


def _rows_of(ids: list, found: list) -> pa.RecordBatch:
    columns = list(zip(*[(ids[r], *rest) for r, *rest in found], strict=True)) or [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")


def contaminated(documents: DataFrame, benchmark: DataFrame, held: int = HELD_WINDOWS) -> DataFrame:
    """(doc_id, item_id, first_word, windows, share, slots) for each item that a document holds, in no order.

    A null or empty text on either side matches nothing, and neither does a null
    item_id.  A null doc_id is reported as null.  Repeated rows, and items with equal
    texts, are reported each.  Of several places that hold an item the one with most
    windows counts, the first of equal ones.  Long texts are read whole; other columns
    are ignored; an empty table on either side gives no rows.  A benchmark of up to
    ``held`` windows is held in every worker, a larger one is joined by shuffle, with the
    same result.
    """
    items = _items(benchmark)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if _large(items, held):
        rows = tables.written(docs.withColumn("key", F.monotonically_increasing_id()), "keyed-documents")
        return _by_shuffle(rows.select("key", "text"), items).join(rows.select("key", "doc_id"), "key").select(*_FOUND.names)
    index = _index(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                yield _rows_of(part.column("doc_id").to_pylist(), index.find(data, offsets))

    return docs.mapInArrow(run, _FOUND_DDL)


def keep_clean(documents: DataFrame, benchmark: DataFrame, held: int = HELD_WINDOWS) -> DataFrame:
    """The rows of documents, all columns, whose text holds no item; each row is judged by its own text."""
    items = _items(benchmark)
    if _large(items, held):
        row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
        rows = tables.written(documents.select(row, F.monotonically_increasing_id().alias("key")), "keyed-documents")
        found = _by_shuffle(rows.select("key", F.col("row.text").cast("string").alias("text")), items)
        return rows.join(found.select("key").distinct(), "key", "left_anti").select("row.*")
    index = _index(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[f[0] for f in index.find(data, offsets)]] = False
                yield part.filter(pa.array(clean))

    return documents.mapInArrow(run, documents.schema)


def _large(items: DataFrame, held: int) -> bool:
    """Whether the benchmark may have more windows than a worker holds; no text has more than characters, four bytes each."""
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) > 4 * held


def _index(items: DataFrame) -> Index:
    return Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])


#: Bits of a window's hash that documents are filtered by before windows are shuffled: a bitmap of 2 MB.
_BITS = 24


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size, with the key of a row of ``rows`` (key, text) for its doc_id.

    A document that holds an item lacks at most a fifth of its windows, so it has one of
    any choice that makes up more than a fifth.  The choice falls on the windows that
    fewest items have; only these are joined, and candidate pairs of texts are compared.
    """
    items = tables.written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    listed = tables.written(items.mapInArrow(_item_windows, "item bigint, form int, h bigint, n bigint, need bigint"), "item-windows")
    common = listed.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    rarest = Window.partitionBy("item", "form").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = listed.join(common, "h").withColumn("before", F.sum("n").over(rarest) - F.col("n"))
    chosen = tables.written(ranked.filter(F.col("before") <= F.floor(F.col("need") * F.lit(1 - SHARE) + F.lit(1e-6))).select("h", "item"), "rare-windows")

    place = F.shiftrightunsigned("h", 64 - _BITS)
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    per_row = 8 * 4096
    for r in chosen.groupBy(F.floor(place / per_row).alias("part")).agg(F.bitmap_construct_agg(place % per_row).alias("bits")).collect():  # 512 rows at most
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrowtext.chunks(batch):
                template, _, first = forms(data, offsets)
                hits_ = []
                for form in (CASED, UNCASED, VERBATIM):
                    h, rows_, at = windows(template[form], first)
                    worded = ~bare(template[form], first, rows_, at)
                    h, rows_ = _of_form(h[worded], form), rows_[worded]
                    at = (h >> U64(64 - _BITS)).astype(np.int64)
                    maybe = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                    hits_.append(np.stack([rows_[maybe], h[maybe].view(np.int64)]))
                pairs = np.unique(np.concatenate(hits_, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(pairs[0], pa.int64())), pa.array(pairs[1], pa.int64())], names=["key", "h"])

    hits = rows.filter("text is not null").mapInArrow(probe, "key bigint, h bigint")
    pairs = tables.written(hits.join(chosen, "h").select("key", "item").distinct(), "leak-candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, ids, wanted = (batch.column(c) for c in ("key", "text", "item_id", "wanted"))
            run = np.concatenate([[0], np.flatnonzero(np.diff(keys.to_numpy())) + 1, [len(keys)]]) if len(keys) else [0]
            for i, j in zip(run[:-1], run[1:], strict=True):
                for a in range(i, j, 256):
                    index = Index(list(zip(ids[a : min(j, a + 256)].to_pylist(), wanted[a : min(j, a + 256)].to_pylist(), strict=True)))
                    raw = np.frombuffer(texts[a].as_py().encode(), np.uint8)
                    yield _rows_of([keys[a].as_py()], index.find(raw, np.array([0, len(raw)])))

    both = pairs.join(items.withColumnRenamed("text", "wanted"), "item").join(rows, "key").select("key", "text", "item_id", "wanted").sortWithinPartitions("key")
    return both.mapInArrow(compare, _FOUND_DDL).withColumnRenamed("doc_id", "key")


def _of_form(h: np.ndarray, form: int) -> np.ndarray:
    """Windows' hashes that differ by form."""
    return arrowtext.mix(h, 40 + form) if form else h


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, form, window, times in it, all windows of the item), without windows of placeholders alone."""
    for batch in batches:
        for part, data, offsets in arrowtext.chunks(batch):
            for form, used, h, rows, _, empty in item_windows(data, offsets):
                need = np.bincount(rows, minlength=part.num_rows)
                mine = used[rows] & ~empty
                pairs, n = np.unique(np.stack([rows[mine], _of_form(h[mine], form).view(np.int64)]), axis=1, return_counts=True)
                forms_ = pa.array(np.full(len(n), form, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(pairs[0], pa.int64())), forms_, pa.array(pairs[1], pa.int64()), pa.array(n, pa.int64()), pa.array(need[pairs[0]], pa.int64())], names=["item", "form", "h", "n", "need"])
