"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.llm import bpe, convnet, licenses, multiindex, oddsketch, outliers, packing, preference, ring, substrings, variants, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = preference.format_preferences(*preference.swapped_replies(_table(spark, sf_dir, "conversations")))

    def spans(column: str) -> F.Column:
        return F.array_join(F.transform(column, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")

    return formatted.select(
        F.col("pair_id").alias("conv_id"),
        "common_turns",
        "prompt",
        "chosen",
        "rejected",
        spans("chosen_spans").alias("chosen_spans"),
        spans("rejected_spans").alias("rejected_spans"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_verdicts(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_findings(_table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    path, pattern = public_tokenizers.path(vocabulary), public_tokenizers.PATTERN
    both = bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(_table(spark, sf_dir, "documents"), threshold=75)


def op8_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.similar_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93, target_recall=0.999)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return convnet.quality_scores(docs, convnet.train_classifier(docs, _table(spark, sf_dir, "labels")))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(_table(spark, sf_dir, "embeddings"), components=16)


def op12_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), window=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.counted_words(_table(spark, sf_dir, "documents"), least_length=5, least_count=3, delete_one_in=97)
    return variants.spelling_variants(words, dominance=2)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_normaliser,
        op2_ring_sharding,
        op3_preference_format,
        op4_quality_rules,
        op5_license_scan,
        op6_byte_bpe,
        op7_odd_sketch_dedup,
        op8_multi_index_dedup,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_exact_whitening,
        op12_suffix_tree_dedup,
        op13_spelling_variants,
    )
}
