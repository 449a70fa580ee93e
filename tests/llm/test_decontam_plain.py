"""Templates, window shares and slots against plain forms; both ways of joining; names at sentence starts."""

import random
import re

import numpy as np
import pytest

from tidemill.llm import decontam

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def plain_template(text):
    """[(template word, word)] of a text, token by token."""
    out = []
    for t in re.findall(r"(?:[0-9](?:[.,](?=[0-9]))?|[A-Za-z\x80-\U0010ffff])+", text):
        # A number's point or comma joins digits only.
        word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        if "0" <= t[0] <= "9":
            kind = "#number"
        elif out and out[-1][0] == "#number" and word in decontam.UNITS:
            kind = "#unit"
        elif ("A" <= t[0] <= "Z" or "À" <= t[0] <= "Þ") and word not in decontam.STARTERS:
            kind = "#name"
        else:
            kind = word
        out.append((kind, word))
    return out


def windows(words):
    n = decontam.WINDOW
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


def placed(item, doc, share=decontam.SHARE):
    """Whether an item stands at some place of a document, word by word at one shift, with its share of windows and agreeing slots."""
    a, b = plain_template(item), plain_template(doc)
    need = windows([t for t, _ in a])
    if len(a) < decontam.WINDOW:
        return False
    free = sum(all(t.startswith("#") for t in w) for w in need)
    for shift in range(-len(a), len(b)):
        same = [0 <= i + shift < len(b) and b[i + shift][0] == a[i][0] for i in range(len(a))]
        good = [i for i in range(len(need)) if all(same[i : i + decontam.WINDOW])]
        if len(good) < share * len(need):
            continue
        forth, back, clashes, slots = {}, {}, 0, 0
        for i in sorted({i + j for i in good for j in range(decontam.WINDOW)}):
            if a[i][0].startswith("#"):
                x, y = a[i][1], b[i + shift][1]
                slots += 1
                clashes += (2 * free > len(need) and x != y) or forth.setdefault(x, y) != y or back.setdefault(y, x) != x
        if clashes * 5 <= slots:
            return True
    return False


def possible(item, doc):
    """What every held item must have: its share of windows somewhere in the document."""
    need, have = windows([t for t, _ in plain_template(item)]), windows([t for t, _ in plain_template(doc)])
    return sum(min(need.count(w), have.count(w)) for w in set(need)) >= decontam.SHARE * len(need)


WORDS = "the boat left with sacks of salt and reached port where they paid coins for all of it then went home".split()
NAMES = ["Anna", "Bob", "Élodie", "Dover", "Calais", "Hull"]


def sentence(rng, n):
    out = []
    for _ in range(n):
        r = rng.random()
        out.append(rng.choice(NAMES) if r < 0.12 else f"{rng.randrange(40)}" if r < 0.24 else f"{rng.randrange(9)} km" if r < 0.28 else rng.choice(WORDS))
    return " ".join(out)


def renamed(rng, text):
    """Another question of the same template: names and numbers replaced one for one."""
    names = dict(zip(NAMES, rng.sample(["Carol", "Dan", "Ürsula", "Turin", "Genoa", "York"], 6), strict=True))
    numbers = {}
    out = re.sub(r"[A-ZÉ]\w+", lambda m: names.get(m[0], m[0]), text)
    return re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(100 + 7 * len(numbers))), out)


def test_templates():
    rng = random.Random(1)
    texts = ["Alice has 3 apples. Alice buys 5 km of 1,200.5 m, Tom 3.", "The END of 12 days", "", "x", *[sentence(rng, 30) for _ in range(30)]]
    ids: dict[int, str] = {}
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        template, word, _ = decontam.templates(raw, np.array([0, len(raw)]))
        plain = plain_template(t)
        assert len(template) == len(plain), t
        for h, w, (kind, low) in zip(template.tolist(), word.tolist(), plain, strict=True):
            assert ids.setdefault(h, kind) == kind and ids.setdefault(w, low) == low and (h <= 16) == kind.startswith("#"), (t, kind)


@pytest.mark.parametrize("held", [decontam.HELD_WINDOWS, 1])
def test_against_plain_form(spark, held):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randrange(6, 26))) for i in range(25)] + [(3, sentence(rng, 12)), (40, None), (None, sentence(rng, 9)), (41, "")]
    items.append((42, items[0][1]))
    docs = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(10, 40))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items[:26])[1]
            parts += [text if rng.random() < 0.4 else renamed(rng, text) if rng.random() < 0.7 else sentence(rng, 20), sentence(rng, rng.randrange(1, 15))]
        docs.append((i if i % 9 else None, ". ".join(parts)))
    docs += [docs[4], (70, None), (71, ""), (docs[5][0], docs[6][1]), (None, items[2][1])]
    df, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    got = sorted((tuple(r) for r in decontam.contaminated(df.selectExpr("*", "1 as item_id", "2 as key"), bench, held=held).collect()), key=repr)
    pairs = sorted(((r[0], r[1]) for r in got), key=repr)
    usable = [(i, t) for i, t in items if i is not None and t]
    must = sorted(((d, i) for d, x in docs if x for i, t in usable if placed(t, x)), key=repr)
    may = sorted(((d, i) for d, x in docs if x for i, t in usable if possible(t, x)), key=repr)
    left = list(pairs)
    for p in must:
        assert p in left, p
        left.remove(p)
    spare = list(may)
    for p in pairs:
        assert p in spare, p
        spare.remove(p)
    assert any(d is None for d, _ in pairs) and len(must) > 40
    clean = sorted((r[0], r[1]) for r in [tuple(x) for x in decontam.keep_clean(df, bench, held=held).collect()] if r[0] is not None)
    dirty = {(d, x) for d, x in docs if x and any(decontam.Index([(i, t)]).find(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])) for i, t in usable)}
    assert clean == sorted((d, x) for d, x in docs if d is not None and (d, x) not in dirty) if all(x is not None for _, x in clean) else True
    if held == 1:
        want = sorted((tuple(r) for r in decontam.contaminated(df, bench).collect()), key=repr)
        assert got == want


def test_renamed_item_that_begins_sentences(spark):
    item = "Alice has 3 apples. Alice buys 5 more apples at the market. How many apples does Alice have now?"
    same = "Carol has 13 apples. Carol buys 25 more apples at the market. How many apples does Carol have now?"
    other = "Carol has 13 apples. Dave buys 25 more apples at the market. How many apples does Erin have now?"
    docs = [(1, f"Some text before. {same} And after."), (2, item), (3, f"Nothing of this kind here, {' '.join(WORDS)}.")]
    got = decontam.contaminated(spark.createDataFrame([*docs, (4, other)], DOCS), spark.createDataFrame([(9, item)], ITEMS)).collect()
    assert {r["doc_id"] for r in got} >= {1, 2} and 3 not in {r["doc_id"] for r in got}
    for held in (1, 1000):
        assert decontam.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([(9, item)], ITEMS), held=held).count() == 0
        assert decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS), held=held).count() == 0
    long = " ".join(WORDS * 3000) + " " + same
    assert {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame([(5, long)], DOCS), spark.createDataFrame([(9, item)], ITEMS)).collect()} == {5}
