"""The registered queries of this subpackage: each reads whole tables and derives its digest columns from an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, divergence, html, langid, license, mixing, neardup, negatives, oracles, quality, sampling, substrings


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", sampling.held_out(F.col("doc_id")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return _held_out(scored).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("context_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations read back from their examples, which come in order; every context is checked."""
    none = object()
    now: object = none
    n = loss = chars = examples = contexts = 0
    turns, trained, stream = sha256(), sha256(), sha256()

    def row() -> tuple:
        return (now, n, turns.hexdigest(), loss, trained.hexdigest(), chars, examples, contexts)

    for batch in batches:
        out: list[tuple] = []
        for conv, _, no, new, target, context_chars, digest, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if now is not none:
                    out.append(row())
                now, n, loss, chars, examples, contexts = conv, 0, 0, 0, 0, 0
                turns, trained, stream = sha256(), sha256(), sha256()
            stream.update(new.encode())
            chars += len(new)
            if (context_chars, digest) != (chars, stream.hexdigest()):
                raise ValueError(f"conversation {conv}: the context of example {no} is not what stands before it")
            if context is not None and (len(context), sha256(context.encode()).hexdigest()) != (chars, stream.hexdigest()):
                raise ValueError(f"conversation {conv}: example {no} carries another context")
            for role, text in chat.parse(new + (target or "")):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if target is not None:
                ((_, text),) = chat.parse(target)
                trained.update(text.encode())
                stream.update(target.encode())
                loss, chars, examples, contexts = loss + len(text), chars + len(target), examples + 1, contexts + context_chars
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
    if now is not none:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), _DIGESTS, strict=True)], schema=_DIGESTS)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.expanded(turns).mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, context_chars bigint")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _held_out(langid.predict(docs, langid.fit(docs))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=50, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), size=2, hundredths=80)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), every=20, top=20)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = negatives.whole_vectors(_read(spark, sf_dir, "embeddings"), scale=256)
    moved = whole.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return negatives.mine(moved, every=100, positives=5, negatives=10, low=30, high=90)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), least_documents=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat": op2_chat,
    "op3_license": op3_license,
    "op4_langid": op4_langid,
    "op5_substrings": op5_substrings,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_html": op8_html,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_negatives": op11_negatives,
    "op12_bpe": op12_bpe,
    "op13_divergence": op13_divergence,
}

#: SQL for those that it can express.
ORACLE: dict[str, str] = {"op2_chat": oracles.CHAT, "op5_substrings": oracles.REPEATS, "op7_minhash": oracles.NEAR, "op10_mixing": oracles.MIXING, "op11_negatives": oracles.NEGATIVES, "op13_divergence": oracles.DIVERGENCE}
