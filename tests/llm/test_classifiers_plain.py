"""Both classifiers against plain forms of their features and sums, and rejection."""

import math
import random
import re
import zlib

import numpy as np

from tidemill.llm import arrowtext, langid, quality

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x, seed=0):
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def run_hash(values):
    return mix(sum((v + 1) * pow(BASE, i, 1 << 64) for i, v in enumerate(values)) & M)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_vector(text):
    """{coordinate: value} of a text, token by token."""
    words, forms, before = [], [], None
    for t in re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff \t\n\v\f\r]+", text):
        h = run_hash(low(t).encode())
        words.append(h)
        if re.match(r"[A-Za-z\x80-\U0010ffff]", t):
            upper = [("A" <= c <= "Z") or ("À" <= c <= "Þ") for c in t]
            case = 1 if all(upper) and len(t) > 1 else 2 if upper[0] else 3
            forms.append(case + 4 * (before == h))
            before = h
        else:
            forms.append(9 if t[0].isdigit() else h)
    counts = {}
    for stream, n, seed in ((words, 1, 0), (words, 2, 1), (forms, 2, 2), (forms, 3, 3)):
        for i in range(len(stream) - n + 1):
            at = mix(run_hash(stream[i : i + n]), seed) >> (64 - quality.BITS)
            counts[at] = counts.get(at, 0) + 1
    values = {k: math.log1p(n) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values())) or 1.0
    return {k: v / length for k, v in values.items()}


TEXTS = ["The cat, the CAT and the cat!", "", "a", "1,200 Élan élan ÉLAN $$$ ### x", "İstanbul naïve — dash", "No  spaces\tbut tabs\n2 lines 3.5"]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_quality_scores(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as label"), weights).collect()}
    for i, t in enumerate(TEXTS):
        dot = sum(float(weights[k]) * v for k, v in plain_vector(t).items()) + float(weights[-1])
        assert abs(got[i] - 1 / (1 + math.exp(-dot))) < 1e-5, t
    long = " ".join(TEXTS) * 3000
    both = quality.score(spark.createDataFrame([(1, long), (1, long)], "doc_id bigint, text string"), weights).collect()
    dot = sum(float(weights[k]) * v for k, v in plain_vector(long).items()) + float(weights[-1])
    assert len(both) == 2 and all(abs(r["score"] - 1 / (1 + math.exp(-dot))) < 1e-4 for r in both)


def test_ftrl_against_plain_updates():
    rng = random.Random(2)
    samples = [(rng.randrange(2), np.array(sorted(rng.sample(range(40), 5)), np.int32), np.full(5, 0.4, np.float32)) for _ in range(60)]
    got = quality.train(samples, epochs=2)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.05
    w = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    order = np.random.default_rng(1)
    for _ in range(2):
        for i in order.permutation(len(samples)):
            label, at, _x = samples[i]
            x = {**{int(k): float(np.float32(0.4)) for k in at}, 1 << quality.BITS: 1.0}
            now = {k: w(k) for k in x}
            p = 1 / (1 + math.exp(-sum(now[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * now[k]
                n[k] = n.get(k, 0.0) + g * g
    assert all(abs(got[k] - w(k)) < 1e-5 for k in z) and np.count_nonzero(got) <= len(z)


def plain_grams(text):
    """Buckets of all 2- to 4-grams of a text's words with one boundary mark on either side, one letter with both marks once."""
    out = []
    table = arrowtext.fold_table()
    letters = [int(table[ord(c)]) for c in text]
    words, now = [], []
    for c in [*letters, 0]:
        if c:
            now.append(c)
        elif now:
            words.append(now)
            now = []
    for word in words:
        marked = [0, *word, 0]
        for n in langid.GRAMS:
            for i in range(len(marked) - n + 1):
                h = marked[i]
                for c in marked[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                out.append((((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * n)) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS))
    return sorted(out)


def test_grams():
    texts = ["Ein Haus", "", "x", "ÉTÉ, 12 l'été\tİx", "a b", "no-hyphen"]
    buckets, rows, letters = langid.grams(*packed(texts))
    for i, t in enumerate(texts):
        assert sorted(buckets[rows == i].tolist()) == plain_grams(t), t
        assert letters[i] == sum(c.isalpha() for c in t)


def model_of(spark, sf):
    return langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_scores_against_plain_softmax(spark, sf):
    model = model_of(spark, sf)
    texts = ["the thing is and of it", "le la les une que", "der die das und nicht", ""]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, t in enumerate(texts[:3]):
        g = plain_grams(t)
        z = [(sum(float(model.table[b, c]) for b in g) / len(g) + model.bias[c]) / model.temperature for c in range(len(model.languages))]
        e = [math.exp(x - max(z)) for x in z]
        best = max(range(len(z)), key=lambda c: z[c])
        usual = sum(float(model.usual[b]) for b in g) / len(g)
        assert got[i]["lang_pred"] == model.languages[best] and abs(got[i]["score"] - e[best] / sum(e)) < 1e-6
        assert got[i]["rejected"] == (usual < float(model.least(np.array([len(g)]))[0]))


def test_rejection(spark):
    """Noise and languages not learned go, right predictions stay, at the stated rates."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    assert 1e-3 < model.temperature < 1e3
    held = [(i, r["text"]) for i, r in rows.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    got = langid.predict(spark.createDataFrame(held, "doc_id bigint, text string"), model).collect()
    right = [r for r in got if r["lang_pred"] == rows[r["doc_id"]]["lang"]]
    assert len(right) > 0.95 * len(got) and sum(r["rejected"] for r in right) < 0.02 * len(right)
    rng = random.Random(3)
    noise = [(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(length))) for n, length in enumerate([30, 100, 400, 2000] * 100)]
    out = langid.predict(spark.createDataFrame(noise, "doc_id bigint, text string"), model).collect()
    assert sum(r["rejected"] for r in out) > 0.9 * len(out)
    others = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    assert all(r["rejected"] for r in langid.predict(spark.createDataFrame(list(enumerate(others)), "doc_id bigint, text string"), model).collect())
    # A language that is left out of the sample is turned away for the most part.
    some = docs.filter("lang <> 'de'")
    left_out = langid.predict(docs.filter("lang = 'de'"), langid.fit(some))
    assert left_out.filter("rejected").count() > 0.9 * left_out.count()


def test_temperature_inside_its_range():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 3))
    truth = np.array([rng.choice(3, p=np.exp(2 * r) / np.exp(2 * r).sum()) for r in z])
    assert 0.35 < langid.fit_temperature(z, truth) < 0.7  # drawn at one half
    sure = np.eye(3)[truth] * 10
    assert 1e-4 < langid.fit_temperature(sure, truth) < 1e4
