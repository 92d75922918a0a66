"""The queries opN_<name>, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.llm import divergence, fingerprints, jaccard, language, middle, mixing, nearest, oracles, packing, pii, sharding, suffixes, tokens, toxicity
from emberflow.llm.common import key_text, table, text_of


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def fold(name: str = "doc_id", folds: int = 3) -> Column:
    """The fold that a row's id puts it in."""
    return F.crc32(F.encode(key_text(name), "UTF-8")) % folds


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(fold() != 1), labels.filter(fold() != 1))
    out = toxicity.score(docs.select("doc_id", text_of().alias("text")), model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sharding.assign_shards(docs, sharding.Tree.even(2, 3, 4), docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transform(table(spark, sf_dir, "documents"))
    again = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of op6's signatures joined, and similarities verified: every document with a near copy."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_personal_data": op2_personal_data,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_nearest": op9_nearest,
    "op10_sharding": op10_sharding,
    "op11_middle": op11_middle,
    "op12_divergence": op12_divergence,
    "op13_repeats": op13_repeats,
    "near_duplicates": near_duplicates,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op11_middle": oracles.MIDDLE, "op12_divergence": oracles.DIVERGENCE, "op13_repeats": oracles.REPEATS}
