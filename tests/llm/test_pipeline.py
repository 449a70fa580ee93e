"""Each stage on odd rows and against plain forms, and the whole pipeline."""

import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidemill.llm import decontam, neardup, substrings

NAMES = ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_stages_keep_to_their_operators(spark, sf):
    """Each stage against the operator's results on its own input, and clean documents stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    one = p.identify_language(spark, docs, sf)
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    two = p.drop_near_duplicates(spark, docs, sf)
    assert two.columns == docs.columns and ids(two) == ids(neardup.near_duplicates(docs, size=5).filter("kept"))
    three = p.drop_repeated_passages(spark, docs, sf)
    left = substrings.remove_repeats(docs, with_text=False)
    assert three.columns == docs.columns and ids(three) == ids(left.filter("n_removed = 0 or n_removed < n_words"))
    four = p.drop_contaminated(spark, docs, sf)
    leaks = decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert four.columns == docs.columns and set(ids(docs)) - set(ids(four)) == set(ids(leaks))
    assert [n for n, _ in p.STAGES] == NAMES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_groups(texts):
    """Groups of texts whose five-word shingle sets have a similarity of 0.8 or more, pair by pair."""
    def shingles(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def prose(seed, n):
    state, out = seed, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("wordlist"[state % 7 :][:3] + str(state % 997))
    return " ".join(out)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names stages use themselves."""
    base, other = prose(1, 80), prose(2, 400)
    data = [
        (1, base, "en", "a"), (1, base, "en", "a"), (None, base, "en", None), (None, prose(3, 60), None, "b"), (2, None, "en", "a"), (3, "", "fr", "a"), (3, prose(4, 90), "fr", "a"), (3, prose(5, 90), "fr", "b"),
        (4, other, "en", "b"), (5, other + " " + prose(6, 120), "en", "b"), (6, prose(7, 20_000), "en", None), (7, "x", "en", "a"), (8, " \n\t ", "en", "a"), (9, base.upper(), None, None),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("key", "row", "size", "target", "taken", "extra", "component_id", "grp")}).repartition(3)


def test_near_dedup_of_odd_rows(spark, odd, sf):
    got = p.drop_near_duplicates(spark, odd, sf)
    assert got.columns == odd.columns and got.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    data = [tuple(r) for r in odd.collect()]
    groups = {}
    for r, g in zip(data, near_groups([r[1] for r in data]), strict=True):
        groups.setdefault(g, []).append(r)
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(groups)
    for own in groups.values():
        (stays,) = [k for k in own if k in kept][:1] or [None]
        assert stays and (stays[0] is None) == all(r[0] is None for r in own)
        assert stays[0] is None or stays[0] == min(r[0] for r in own if r[0] is not None)


def test_repeated_passages_of_odd_rows(spark, odd, sf):
    got = p.drop_repeated_passages(spark, odd, sf)
    assert got.columns == odd.columns
    data = [tuple(r) for r in odd.collect()]
    first = {}
    for r in data:
        w = words(r[1])
        for i in range(len(w) - 49 if r[0] is not None else 0):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, r[0]), r[0])
    want = []
    for r in data:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 49 if r[0] is not None else 0):
            if first[tuple(w[i : i + 50])] < r[0]:
                gone |= set(range(i, i + 50))
        if not gone or len(gone) < len(w):
            want.append((r[0], [x for i, x in enumerate(w) if i not in gone], r[5]))
    assert sorted(((r["doc_id"], words(r["text"]), r["key"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] else None) for r in got.collect())


def test_decontamination_of_odd_rows(spark, odd, sf):
    """A row is judged by its own text: a clean row stays whatever rows share its id, and a null id hides nothing."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first()["text"]
    bad = odd.filter("doc_id = 7").withColumn("text", F.concat(F.lit("Before it. "), F.lit(item), F.lit(" after.")))
    both = odd.unionByName(bad).unionByName(bad.withColumn("doc_id", F.lit(None).cast("bigint")))
    got = p.drop_contaminated(spark, both, sf)
    assert got.columns == odd.columns and rows(got) == rows(odd)


def test_language_id_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(300).withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang"))).withColumn("score", F.lit("clash"))
    extra = spark.createDataFrame([(None, None, None, None, None, "s"), (1, "", "en", "a", 0, "s"), (2, "123 ;;", None, None, 6, "s"), (3, "zq xv jq wz kx qj vz xk qz jx wv", "en", "a", 5, "s")], some.schema)
    got = p.identify_language(spark, some.unionByName(extra), sf)
    assert got.columns == some.columns and got.filter("score = 's'").count() == 0 and got.count() >= 0.98 * some.count()


def test_mix_of_odd_rows(spark, odd, sf):
    got = p.mix_sources(spark, odd, sf)
    assert got.columns[: len(odd.columns)] == odd.columns and {"copies", "source_size"} <= set(got.columns)
    assert rows(got, *odd.columns) == rows(odd)
    assert all(0 <= r["copies"] <= 2 and (r["copies"] == 0 or words(r["text"])) for r in got.collect())


def test_empty_tables(spark, odd, sf):
    empty = odd.limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and out.columns[: len(odd.columns)] == odd.columns, name


def test_run(spark, sf):
    out = p.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {*docs.columns, "size", "target", "copies", "taken"} <= set(out.columns) and out.filter("taken > 2 * size").count() == 0
    got = out.collect()
    assert got and all(r["size"] == len(words(r["text"])) and r["n_chars"] == len(r["text"]) for r in got)
    # Nothing of what the stages remove is left, and every source's words come near its target.
    texts = [r["text"] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert len(set(near_groups(texts[:150]))) == len(texts[:150])
    seen = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for i in range(len(w) - 49):
            k = md5(" ".join(w[i : i + 50]).encode()).digest()
            assert seen.setdefault(k, r["doc_id"]) == r["doc_id"]
    taken, target, largest = {}, {}, {}
    for r in got:
        s = r["source"]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r["taken"], r["target"], max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
