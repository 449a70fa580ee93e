"""Divergence of sources within a language: every pair of sources, and the terms that set a source apart.

A group is a language and a source.  The terms of a language that stand in enough of its
documents are kept, and a group's (or the whole language's) probability of a kept term is
the integer p = 1 + floor(SCALE * (count + 1) / (total + number of kept terms)).  The
divergence of p from q at a term is f = floor((p - q)^2 / q), a whole number, so partial
sums in any order and division give the same total.

The sum over all kept terms for a pair (g, h) is divided three ways.  If no term occurred
in either group it would be (kept terms) * f(p0_g, p0_h), with p0 the probability of a
count of 0; what follows are corrections to that.

* Heavy terms, present in more than HEAVY groups of the language, are laid out as dense
  tiles (terms by groups), and a tile adds f(p_g, p_h) - f(p0_g, p0_h) for all pairs of
  groups at once in numpy.  Of many sources, blocks of BLOCK are paired with blocks.
* Light terms that one side has: they depend on a count of one group and the other's p0
  only, so a histogram of counts by group is enough, and no pair of postings is made.
* Light terms that both have: the pairs of a term's at most HEAVY postings, counted by
  (pair, count, count) before f is evaluated; what the histograms have added wrongly for
  them is taken back.

Terms are counted within each task first, with what a task holds bounded.  Null texts,
languages and sources are empty ones.  A document without terms still makes its group
occur.  Repeated rows count each on its own, other columns are not read, and an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

SCALE = 1_000_000_000
#: Groups in which a light term stands at most, groups in a block of a tile, and terms in a tile, about.
HEAVY, BLOCK, TILE = 8, 64, 2048
#: Terms, and bytes of them, that a task counts before it sends them on.
ENTRIES, BYTES = 250_000, 32_000_000
#: ASCII letters, and every byte of other characters.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task, and a row without term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([None if t is None else t.decode() for t in some], pa.string()), pa.array([0 if t is None else n[t] for t in some], pa.int64()), pa.array([0 if t is None else docs[t] for t in some], pa.int64())], schema=_COUNTS)
        counts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                own = Counter(_TERM.findall((text or "").encode().lower()))
                before = len(n)
                n.update(own)
                docs.update(dict.fromkeys(own, 1))
                if len(n) > before:
                    held += len(n) - before
                    size += sum(map(len, own))
                if held > ENTRIES or size > BYTES:
                    yield from rows()
                    held = size = 0
    yield from rows()


def _p(count: Column, total: Column, kept: Column) -> Column:
    # Without kept terms there is nothing to divide by, and no term to sum over.
    return F.call_function("div", F.lit(SCALE) * (count + 1), F.greatest(total + kept, F.lit(1))) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, least_documents: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) by group and part.

    Part ``pair``: each other source of the language with the sum of f over all kept terms,
    p of the group and q of the other.  Part ``term``: the ``top`` kept terms of the group
    with p above the language's q, and f.  Ranks go by value, highest first, then by item.
    """
    spark = documents.sparkSession
    chosen = documents.select(*[documents[c].cast("string").alias(c) for c in ("lang", "source", "text")])
    # One shuffle by term serves the counts of groups, those of the language and the choice of terms.
    counted = chosen.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint").repartition(tables.partitions(spark), "lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.select("*", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("lang_n"), F.count(F.lit(1)).over(of_term).alias("in_groups"), F.min("source").over(of_term).alias("least"))
    counted = counted.filter(F.col("term").isNull() | (F.col("in_docs") >= least_documents))
    counted = tables.written(counted.select("lang", "source", "term", "n", "lang_n", "in_groups", (F.col("source") == F.col("least")).alias("first")), "term-counts")

    real = F.col("term").isNotNull()
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(real & F.col("first"), 1).otherwise(0)).alias("own_firsts"), F.sum(F.when(real & F.col("first"), F.col("lang_n")).otherwise(0)).alias("lang_firsts"))
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("own_firsts").over(of_lang).alias("kept"), F.sum("lang_firsts").over(of_lang).alias("lang_total"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("g"))
    groups = tables.written(groups, "term-groups")
    postings = counted.filter(real)

    q = _p(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = postings.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", q).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(postings, groups)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top), pairs.withColumn("rank", F.row_number().over(by_value))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language with its sum over all kept terms."""
    zero = F.lit(0)
    side = {s: groups.select("lang", F.col("source").alias(f"{s}_source"), F.col("g").alias(s), F.col("total").alias(f"{s}_total"), _p(zero, F.col("total"), F.col("kept")).alias(f"{s}_p0"), *(["kept"] if s == "g" else [])) for s in ("g", "h")}
    both = side["g"].join(side["h"], "lang").filter("g <> h")
    f00 = _f(F.col("g_p0"), F.col("h_p0"))
    base = F.col("kept") * f00

    light, heavy = postings.filter(F.col("in_groups") <= HEAVY), postings.filter(F.col("in_groups") > HEAVY)
    number = groups.select("lang", "source", "g")

    # Light terms of one side, from the histogram of its counts.
    histogram = light.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(number, ["lang", "source"]).groupBy("lang", "g").agg(F.collect_list(F.struct("n", "terms")).alias("counts"))

    def one_side(counts: str, total: str, value) -> Column:
        """Sum over a histogram of (value of a count's p - f00)."""
        each = F.aggregate(F.coalesce(F.col(counts), F.array().cast("array<struct<n:bigint,terms:bigint>>")), F.lit(0).cast("bigint"), lambda a, x: a + x["terms"] * (value(_p(x["n"], F.col(total), F.col("kept"))) - f00))
        return each

    both = both.join(histogram.select("lang", "g", F.col("counts").alias("g_counts")), ["lang", "g"], "left").join(histogram.select("lang", F.col("g").alias("h"), F.col("counts").alias("h_counts")), ["lang", "h"], "left")
    ones = one_side("g_counts", "g_total", lambda p: _f(p, F.col("h_p0"))) + one_side("h_counts", "h_total", lambda p: _f(F.col("g_p0"), p))
    start = both.select("lang", "g", "h", "g_source", "h_source", (base + ones).alias("value"))

    # Light terms of both: pairs of a term's few postings, equal ones counted together.
    lists = light.join(number, ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("g", "n")).alias("x"))
    two = lists.select("lang", F.explode("x").alias("a"), "x").select("lang", "a", F.explode("x").alias("b")).filter("a.g <> b.g")
    two = two.groupBy("lang", F.col("a.g").alias("g"), F.col("b.g").alias("h"), F.col("a.n").alias("g_n"), F.col("b.n").alias("h_n")).agg(F.count(F.lit(1)).alias("terms"))
    two = two.join(side["g"], ["lang", "g"]).join(side["h"], ["lang", "h"])
    pg, ph = _p(F.col("g_n"), F.col("g_total"), F.col("kept")), _p(F.col("h_n"), F.col("h_total"), F.col("kept"))
    taken = _f(pg, ph) - _f(pg, F.col("h_p0")) - _f(F.col("g_p0"), ph) + f00
    two = two.groupBy("lang", "g", "h").agg(F.sum(F.col("terms") * taken).alias("more"))

    more = two.unionByName(_tiles(heavy, groups)).groupBy("lang", "g", "h").agg(F.sum("more").alias("more"))
    summed = start.join(more, ["lang", "g", "h"], "left")
    return summed.select("lang", F.col("g_source").alias("source"), F.lit("pair").alias("part"), F.col("h_source").alias("item"), (F.col("value") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("value"))


def _tiles(heavy: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, more): corrections of all pairs by heavy terms, a partial sum for each tile."""
    spread = heavy.groupBy("lang").agg(F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("heavy")).select("lang", F.ceil(F.col("heavy") / TILE).alias("tiles"))
    blocks = groups.groupBy("lang").agg(F.ceil((F.max("g") + 1) / BLOCK).alias("blocks"))
    placed = groups.join(blocks, "lang").join(spread, "lang").withColumn("block", F.floor(F.col("g") / BLOCK))
    # A group's block is the first of a pair with every block, and the second of one with every other.
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    cells = F.flatten(F.transform(every, lambda b: F.when(b == F.col("block"), F.array(F.struct(b.alias("i"), b.alias("j")))).otherwise(F.array(F.struct(F.col("block").alias("i"), b.alias("j")), F.struct(b.alias("i"), F.col("block").alias("j"))))))
    entries = heavy.select("lang", "source", F.xxhash64("term").alias("hash"), "term", "n").join(placed, ["lang", "source"])
    entries = entries.withColumn("tile", F.pmod("hash", F.col("tiles"))).select("lang", "tile", F.explode(cells).alias("cell"), "g", "term", "n")
    of_tile = placed.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).select("lang", "tile", F.explode(cells).alias("cell"), "g", "total", "kept")
    keys = ["lang", "tile", "i", "j"]
    none = F.lit(None).cast("bigint")
    left = entries.select("lang", "tile", "cell.i", "cell.j", "g", "term", "n", none.alias("total"), none.alias("kept"))
    right = of_tile.select("lang", "tile", "cell.i", "cell.j", "g", F.lit(None).cast("string").alias("term"), none.alias("n"), "total", "kept")

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        """One cell: its postings, and the groups of its blocks (rows without term)."""
        i, j = key[2].as_py(), key[3].as_py()
        postings, members = rows.filter(pc.is_valid(rows.column("term"))), rows.filter(pc.is_null(rows.column("term")))
        n = np.zeros(0, np.int64)
        terms = postings.column("term").combine_chunks().dictionary_encode() if postings.num_rows else None
        if terms is not None:
            if isinstance(terms, pa.ChunkedArray):
                terms = terms.combine_chunks()
            row, n = terms.indices.to_numpy(), postings.column("n").to_numpy()
        g, total, kept = (members.column(c).to_numpy() for c in ("g", "total", "kept"))
        out_g, out_h, out = [n[:0]], [n[:0]], [n[:0]]
        if len(n):
            order = np.argsort(g)
            g, total, kept = g[order], total[order], kept[order]
            counts = np.zeros((len(terms.dictionary), len(g)), np.int64)
            counts[row, np.searchsorted(g, postings.column("g").to_numpy())] = n
            p = 1 + SCALE * (counts + 1) // (total + kept)
            p0 = 1 + SCALE // (total + kept)
            first, second = np.flatnonzero(g // BLOCK == i), np.flatnonzero(g // BLOCK == j)
            for a in first:
                apart = p[:, a : a + 1] - p[:, second]
                sums = (apart * apart // p[:, second]).sum(axis=0) - len(p) * ((p0[a] - p0[second]) ** 2 // p0[second])
                use = g[second] != g[a]
                out_g.append(np.full(use.sum(), g[a]))
                out_h.append(g[second][use])
                out.append(sums[use])
        lang = pa.array([key[0].as_py()] * sum(map(len, out)), pa.string())
        return pa.table({"lang": lang, "g": np.concatenate(out_g).astype(np.int64), "h": np.concatenate(out_h).astype(np.int64), "more": np.concatenate(out)})

    return left.unionByName(right).groupBy(*keys).applyInArrow(work, "lang string, g bigint, h bigint, more bigint")
