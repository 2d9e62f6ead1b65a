"""The queries of this subpackage on the test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, centroids, chat, decontaminate, near_duplicates, page_text, paragraphs, quality, repetition, secrets, simhash, substrings, whitening,
)
from plumbline.llm.frames import table


def vocabulary_path() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))
    words = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_paragraphs", F.size("removed").cast("bigint").alias("n_removed"), words.alias("removed_words"))


def op3_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = vocabulary_path()
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id", (F.octet_length("tokens") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op5_page_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op8_column_sorted_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_bytes(substrings.repeated_bytes(table(spark, sf_dir, "documents")))


def op9_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(extra), vocabulary_path()))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", "identity_error", "dims"
    )


def op13_drift_bounded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_ensemble, op2_paragraph_minhash, op3_guess_cost, op4_segment_tree_bpe, op5_page_tree_model,
        op6_cgk_decontamination, op7_suffix_array_repetition, op8_column_sorted_dedup, op9_offset_masks, op10_minhash_forest,
        op11_simhash_pigeonring, op12_bit_sliced_whitening, op13_drift_bounded_clusters,
    )
}
#: SQL cannot express the operators' learned models, tokenizers and searches in whole; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
