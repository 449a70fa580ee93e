import zlib

from pyspark.sql import functions as F

from tidemill.llm import langid, quality, queries, sampling

DOCS = "doc_id bigint, text string, lang string, quality int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_folds(spark):
    df = spark.range(50).select("id", sampling.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == fold(r["id"]) for r in df.collect())


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    truth = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    got = queries.op4_langid(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == fold(r["doc_id"]) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "12 !!", "x", 1), (4, "the " * 30000, "x", 1), (4, "the " * 30000, "x", 1), (None, "le la les", "x", 1)], "doc_id bigint, text string, score string, lang_pred int")
    r = {x["doc_id"]: x for x in langid.predict(odd, model).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and r[4]["lang_pred"] == "en" and r[1]["rejected"]
    assert {x["doc_id"] for x in langid.keep_identified(odd, model).collect()} >= {4} and langid.keep_identified(odd, model).columns == odd.columns
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None and langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0
    assert {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame([(1, None), (2, "1 2"), (3, "a word"), (4, "")], "doc_id bigint, text string"), None).collect()} == {3}  # no labels, no loss


def test_quality(spark, sf):
    got = queries.op1_quality(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all((r["score"] >= 0.3) == r["predicted"] and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.8
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id bigint, text string")
    weights = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    s = quality.score(odd.withColumn("score", F.lit("x")), weights).collect()
    assert len(s) == 4 and len({r["score"] for r in s if r["doc_id"] in (1, 2)}) == 1
    assert quality.fit(odd, spark.createDataFrame([], "doc_id bigint, quality int")) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5} and quality.score(odd.limit(0), weights).count() == 0
