"""Order statistics and tiles without ordering a table.

``ntile`` over a whole table puts all its rows through one task.  A tile is known from the
keys of the last rows of the tiles before it, so only these few keys have to be found:
splitters drawn from a bounded sample divide the keys into intervals, rows are counted by
interval (a handful of rows reach the shuffle), and each wanted place lies in one interval,
in which the search goes on until it is short enough to be numbered.  Every row then gets
its tile by comparison with the keys, without any shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an interval that one task numbers at most, and splitters of an interval.
NUMBERED, SPLITTERS = 100_000, 64
#: Sampled keys for each splitter.
_OVERSAMPLED = 8
#: Splitters that a key is compared with at a time.
_STEP = 8


@dataclass
class _Interval:
    """Keys from ``low`` to ``high`` (None: no bound) of a group, the rows before it, its rows, and the places wanted in it."""

    group: tuple
    low: Any
    high: Any
    before: int
    rows: int
    wanted: list[int]


def _inside(low: Any, high: Any, key: Column, kind) -> Column:
    above = F.lit(True) if low is None else key >= literal(low, kind)
    return above if high is None else above & (key <= literal(high, kind))


def literal(key: Any, kind) -> Column:
    """A key, as collected, as a literal of its type."""
    if isinstance(key, tuple):
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields, strict=True)])
    return F.lit(key).cast(kind)


def _same(columns: Sequence[str], values: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values, strict=True)], F.lit(True))


def keys_at(rows: DataFrame, groups: Sequence[str], key: str, places: dict[tuple, list[int]], counts: dict[tuple, int], identity: Sequence[str], numbered: int = NUMBERED, splitters: int = SPLITTERS) -> dict[tuple, dict[int, Any]]:
    """The keys at ``places`` (from 1) of each group in ascending order of ``key``.

    ``counts``: rows by group.  ``identity``: columns whose hash draws the sample.  A key
    that many rows share is drawn soon, and its rows are a part of their own.  The result
    has an entry for each place.
    """
    found: dict[tuple, dict[int, Any]] = defaultdict(dict)
    todo = [_Interval(g, None, None, 0, counts[g], sorted(set(p))) for g, p in places.items() if p]
    kind = rows.schema[key].dataType
    seed = 0
    while todo:
        short = [i for i in todo if i.rows <= numbered]
        for at, keys in _numbered(rows, groups, key, short, kind).items():
            found[at[0]][at[1]] = keys
        todo = [i for i in todo if i.rows > numbered]
        if todo:
            seed += 1
            todo = _divided(rows, groups, key, todo, kind, identity, splitters, seed, found)
    return dict(found)


def _tagged(rows: DataFrame, groups: Sequence[str], key: str, intervals: list[_Interval], kind) -> DataFrame:
    """Rows of the intervals, with the interval's number."""
    number = F.lit(None).cast("int")
    for n, i in enumerate(intervals):
        number = F.when(_same(groups, i.group) & _inside(i.low, i.high, F.col(key), kind), n).otherwise(number)
    return rows.withColumn("_interval", number).filter(F.col("_interval").isNotNull())


def _numbered(rows: DataFrame, groups: Sequence[str], key: str, intervals: list[_Interval], kind) -> dict[tuple, Any]:
    if not intervals:
        return {}
    place = F.row_number().over(Window.partitionBy("_interval").orderBy(key))
    wanted = F.lit(False)
    for n, i in enumerate(intervals):
        wanted = wanted | ((F.col("_interval") == n) & F.col("_place").isin([w - i.before for w in i.wanted]))
    some = _tagged(rows, groups, key, intervals, kind).select("_interval", key).withColumn("_place", place).filter(wanted)
    return {(intervals[r["_interval"]].group, r["_place"] + intervals[r["_interval"]].before): _plain(r[key]) for r in some.collect()}


def _plain(key: Any) -> Any:
    return tuple(key) if isinstance(key, tuple) else key


def _divided(rows: DataFrame, groups: Sequence[str], key: str, intervals: list[_Interval], kind, identity: Sequence[str], splitters: int, seed: int, found: dict) -> list[_Interval]:
    """The parts of intervals that hold wanted places."""
    tagged = _tagged(rows, groups, key, intervals, kind)
    draw = F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(1 << 30))
    share = F.lit(0)
    for n, i in enumerate(intervals):
        share = F.when(F.col("_interval") == n, int(min(1.0, splitters * _OVERSAMPLED / i.rows) * (1 << 30))).otherwise(share)
    drawn: dict[int, list] = defaultdict(list)
    for r in tagged.filter(draw < share).select("_interval", key).distinct().orderBy("_interval", key).collect():  # SPLITTERS * _OVERSAMPLED an interval, about
        drawn[r["_interval"]].append(_plain(r[key]))
    cuts = {n: s[:: max(1, len(s) // splitters)] for n, s in drawn.items()}
    sizes: dict[tuple[int, int], tuple[int, Any, Any]] = {}
    for r in _parted(tagged, key, cuts, kind).groupBy("_interval", "_part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect():
        sizes[r["_interval"], r["_part"]] = (r["n"], _plain(r["low"]), _plain(r["high"]))
    left = []
    before = {n: i.before for n, i in enumerate(intervals)}
    for n, p in sorted(sizes):
        i, (size, least, most) = intervals[n], sizes[n, p]
        here = [w for w in i.wanted if before[n] < w <= before[n] + size]
        if here and least == most:
            found[i.group].update(dict.fromkeys(here, least))  # one key, however many rows have it
        elif here:
            left.append(_Interval(i.group, least, most, before[n], size, here))
        before[n] += size
    return left


def _parted(tagged: DataFrame, key: str, cuts: dict[int, list], kind) -> DataFrame:
    """Rows with their part: odd ones hold the rows of one splitter's own key, even ones those between two splitters.

    A key is compared with every ``_STEP``-th splitter of its interval, then with those of one step, not with all.
    """

    def by_interval(of) -> Column:
        out = F.lit(0)
        for n, own in cuts.items():
            out = F.when(F.col("_interval") == n, of([literal(c, kind) for c in own])).otherwise(out)
        return out

    smaller = lambda keys: F.size(F.filter(keys, lambda c: c < F.col(key)))
    steps = by_interval(lambda s: smaller(F.array(*s[_STEP - 1 :: _STEP])) * _STEP if len(s) >= _STEP else F.lit(0))
    below = by_interval(lambda s: F.col("_passed") + smaller(F.slice(F.array(*s), F.col("_passed") + 1, F.lit(_STEP))))
    own = by_interval(lambda s: F.coalesce(F.get(F.array(*s), F.col("_below")) == F.col(key), F.lit(False)).cast("int"))
    return tagged.withColumn("_passed", steps).withColumn("_below", below).withColumn("_part", 2 * F.col("_below") + own)


def last_places(rows: int, tiles: int) -> list[int]:
    """The place of the last row of each tile but the last; the first ``rows mod tiles`` tiles hold one row more."""
    size, longer = divmod(rows, tiles)
    return [t * size + min(t, longer) for t in range(1, tiles)]


def tile_columns(df: DataFrame, tiles: int, within: Column, measures: dict[str, Column], tie: str, **limits: int) -> dict[str, Column]:
    """For each measure the expression of ``ntile(tiles)`` within each value of ``within``: ascending, nulls last, ties by ``tie``.

    ``df`` is read several times, so it should be a table.  Only counts, sampled keys and
    the tiles' last keys (tiles - 1 of each group and measure) reach the driver.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.struct(c.isNull().alias("missing"), c.alias("value"), F.col(tie).alias("tie")).alias("key")) for m, c in measures.items()])).alias("x")
    rows = df.select(within.alias("within"), each).select("within", "x.*")
    counts = {r["within"]: r["n"] for r in df.groupBy(within.alias("within")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {(m, g): n for m in measures for g, n in counts.items()}
    places = {k: last_places(n, tiles) for k, n in sizes.items()}
    edges = keys_at(rows, ["measure", "within"], "key", places, sizes, ["measure", "key.tie"], **limits)
    kind = rows.schema["key"].dataType
    out = {}
    for m, c in measures.items():
        key = F.struct(c.isNull().alias("missing"), c.alias("value"), F.col(tie).alias("tie"))
        tile = F.lit(None).cast("long")
        for g in counts:
            own = [edges[m, g][p] for p in places[m, g]]
            passed = [F.when(key > literal(e, kind), 1).otherwise(0) for e in own]
            tile = F.when(within.eqNullSafe(F.lit(g)), reduce(lambda a, b: a + b, passed, F.lit(1)).cast("long")).otherwise(tile)
        out[m] = tile
    return out
