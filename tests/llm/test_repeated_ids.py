"""Near duplicates where a doc_id stands for unequal texts, against pairs of rows."""

import random

from tidemill.llm import neardup


def shingles(text, size):
    w = (text or "").split(" ") if text else []
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_unequal_texts_of_one_id(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"x{rng.randrange(99)}"
        rows.append((rng.randrange(40), " ".join(words)))
    rows += [(None, " ".join(base[0])), (None, None), (100, None), (101, ""), (100, " ".join(base[1])), (102, "one"), (103, "one")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), size=2).collect()
    sets = [shingles(t, 2) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if None not in (i, j) and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
