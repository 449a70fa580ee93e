"""The audit against sums over all terms, one by one."""

import random
import re
from collections import Counter

import pytest

from tidemill.llm import divergence


def brute(rows, least=3, top=200):
    docs = {}
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.setdefault(lang or "", []).append((source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))))
    out = []
    for lang, own in docs.items():
        df = Counter(t for _, c in own for t in c)
        kept = {t for t in df if df[t] >= least}
        total = lambda chosen: Counter({t: sum(c[t] for c in chosen) for t in kept})
        groups = {s: total([c for x, c in own if x == s]) for s in {s for s, _ in own}}
        whole = total([c for _, c in own])

        def p(counts, t):
            return 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts.values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s, counts in groups.items():
            pairs = [(-sum(f(p(counts, t), p(other, t)) for t in kept), o) for o, other in groups.items() if o != s]
            terms = [(-f(p(counts, t), p(whole, t)), t) for t in kept if counts[t] > 0 and p(counts, t) > p(whole, t)]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1) if rank <= n]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as doc_id", "'x' as term", "2 as n", "3 as g").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("heavy,block,tile", [(8, 64, 2048), (2, 3, 5), (0, 4, 7), (100, 64, 2048)])
def test_equals_sums_over_all_terms(spark, monkeypatch, heavy, block, tile):
    """All terms light, all heavy, and both, with several tiles and blocks; one source has a third of all rows."""
    for name, value in (("HEAVY", heavy), ("BLOCK", block), ("TILE", tile), ("ENTRIES", 30)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Été", "ÉTÉ", "été", "日本"]
    rows = []
    for i in range(260):
        source = "big" if i % 3 == 0 else f"s{rng.randrange(11)}"
        own = words[hash_of(source) % 20 :][:40]
        rows.append((rng.choice(["en", "de", "fr"]), source, " ".join(rng.choice(own if rng.random() < 0.7 else words).upper() if rng.random() < 0.2 else rng.choice(own) for _ in range(rng.randrange(12)))))
    assert run(spark, rows, top=6) == brute(rows, top=6)


def hash_of(text):
    return sum(map(ord, text))


def test_odd_rows(spark):
    rows = [("en", "a", "one two"), ("en", "a", "one two"), ("en", "b", "One, TWO; one"), ("en", None, None), (None, "a", ""), (None, None, "x x x"), ("en", "c", "1234 ... "), ("de", "a", "x")] + [("fr", "z", "long" * 40_000 + " a b")] * 3
    assert run(spark, rows) == brute(rows) and run(spark, []) == []
    # Terms in too few documents are not kept: no terms at all, and pairs of 0.
    assert run(spark, [("en", "a", "p q"), ("en", "b", "q")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
