import random
import re
from hashlib import sha256

import numpy as np
import pytest

from tidemill.llm import neardup, packing, substrings, tables
from tidemill.llm.components import components

DOCS = "doc_id bigint, text string"
SPACE = r"[^\x20\x09-\x0D]+"


def shingles(text, k):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    label = {i: i for i, _ in rows}
    sets = [(i, shingles(t, k)) for i, t in rows]
    changed = True
    links = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[:a] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def family(seed, n, size, edits):
    """Texts that are edits of one text, so that many similarities lie about the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _e in range(r.randrange(edits)):
            w[r.randrange(size)] = f"x{r.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = [*family(1, 40, 120, 9), *family(2, 25, 60, 6), *family(3, 5, 30, 2), "A b", "a B", "one", "ONE", "", None, "a b c", "many words " * 3000, "many words " * 2999]
    rows = [(i * 3 + 1, t) for i, t in enumerate(random.Random(k).sample(texts, len(texts)))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, size=k).collect()}
    assert got == brute_components(rows, k)


def test_near_duplicate_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A B C D E F"), (2, None)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), size=2).collect()), key=repr)
    assert got == sorted([(5, 5, 5, True), (5, 5, 5, True), (None, 5, None, True), (9, 5, 5, False), (2, 0, 2, True)], key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    for shared in (0.5, 0.8, 0.95):
        n = int(2000 * shared / (1 + shared))
        b = np.concatenate([a[:n], r.integers(0, 1 << 63, 1000 - n).astype(np.uint64)])
        low_a, low_b = neardup.minima(a), neardup.minima(b)
        assert abs((low_a == low_b).mean() - n / (2000 - n)) < neardup.MARGIN
        pa, pb = (neardup.packed(x, 2) for x in (low_a, low_b))
        unequal = sum(bin(int(x) & 0xFFFFFFFFFFFFFFFF).count("1") for x in (pa[:4] ^ pb[:4]) | (pa[4:] ^ pb[4:]))
        assert abs((1 - unequal / 256 - 0.25) / 0.75 - n / (2000 - n)) < neardup.MARGIN


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (7, 7), (3, 2), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(rows, window):
    low, out = {}, []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                low[key] = min(low.get(key, i), i)
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and low[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [6, 50])
def test_repeats(spark, window):
    r = random.Random(window)
    word = lambda: f"é{r.randrange(3000)}"
    passages = [[word() for _ in range(r.randrange(window - 2, 2 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(4)):
            w += [word() for _ in range(r.randrange(30))] + r.choice(passages)
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(70, rows[5][1]), (3, rows[4][1]), (80, "be " * 200), (81, "be " * 60), (82, None), (83, ""), (None, rows[7][1]), (90, " ".join(word() for _ in range(20000)) + rows[7][1])]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], DOCS + ", home string, n_words int")
    got = substrings.remove_repeats(df, window=window).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got), key=repr) == brute_repeats(rows, window)
    for x in got:
        kept = " ".join(re.findall(SPACE, x["text"] or ""))
        assert sha256(kept.encode()).hexdigest() == x["kept_sha256"] and x["extra"].asDict() == {"home": "extra", "n_words": 1}
    assert substrings.remove_repeats(df.limit(0), window=window).count() == 0


def test_repeats_without_ids(spark):
    """A third of the rows without an id: they keep their words and others theirs."""
    rows = [(i if i % 3 else None, " ".join(f"w{(i // 6) * 7 + j}" for j in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substrings.remove_repeats(df, window=50)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_repeats(rows, 50)
    assert sorted(r[0] for r in got.filter("doc_id is null").select("text").collect()) == sorted(t for i, t in rows if i is None)


def test_keys_of_two_hashes():
    first, second = np.array([5, 1, 5, 1, 5, 9], np.uint64), np.array([1, 2, 2, 2, 1, 0], np.uint64)
    order, heads = packing.by_keys(first, second)
    groups = {frozenset(order[a:b].tolist()) for a, b in zip(heads, [*heads[1:], 6], strict=True)}
    assert groups == {frozenset({1, 3}), frozenset({0, 4}), frozenset({2}), frozenset({5})}
    order, heads = packing.by_keys(first, first)
    assert len(heads) == 3


def test_shared_folder_comes_from_the_session(spark):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
