"""The registered queries: each operator over its whole table, in the shape that its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation, discriminant, line_dedup, merkle, near_dedup, packing, pii, quality_rules, simhash, suffix_dedup, topk, toxicity
from .common import fold, table, valid_text


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, held=0, threshold=0.3)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["stop"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", folds=4, held=2, threshold=0.3)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"), min_words=line_dedup.PASSAGE_WORDS, passage_words=line_dedup.PASSAGE_WORDS)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, even = valid_text(), fold(F.col("doc_id"), 2) == 0
    proven = merkle.prove(table(spark, sf_dir, "documents"), claimed=F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    shown = lambda c: F.lower(F.hex(c))
    return proven.select("doc_id", *(shown(c).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(shown("proof"), 256).alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), size=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_quality, op3_pii, op4_suffix_dedup, op5_toxicity, op6_bpe, op7_quality_rules, op8_minhash_dedup, op9_packing, op10_line_dedup, op11_merkle_manifest, op12_conversation_repair, op13_simhash_dedup)}
