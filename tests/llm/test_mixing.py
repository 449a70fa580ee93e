import re

from pyspark.sql import functions as F

from tidemill.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def water(sizes, share, most, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_whole_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    want = water(sizes, 1.5, 2.0, mixing.WEIGHTS)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)


def test_order_is_pareto(spark):
    """Within a source the drawn documents are those with the smallest random odds."""
    docs = spark.createDataFrame([(i, "w w", "a") for i in range(200)], DOCS)
    got = mixing.mix(docs, share=0.5, most=2.0).withColumn("u", mixing.uniform(F.col("doc_id"), 17)).collect()
    drawn = [r["u"] for r in got if r["copies"]]
    assert len(drawn) == 100 and max(drawn) < min(r["u"] for r in got if not r["copies"])


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (None, "z", None), (4, "q " * 5000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6 and {(r["doc_id"], r["size"]) for r in got} == {(1, 0), (2, 0), (3, 2), (None, 1), (4, 5000)}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], DOCS)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
