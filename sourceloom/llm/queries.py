"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import (bwt_merge, byte_bpe, flow_shards, hard_negatives, jaccard_join, manifest, merkle, packing,
                            quality_rules, shared, subword, suffix_tree, wu_manber)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_flow_reshard(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    # The old layout keeps the documents of a source together, in 16 shards.
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16)).cast("int")
    return flow_shards.reshard(docs, old, [1] * 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.join(shared.documents(spark, sf_dir), k=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def damaged(pages):
    """The second replica: about one page in 256 with a changed character, and one in 512 cut in half."""
    key = F.col("page_id").cast("string")
    html = F.coalesce("html", F.lit(""))
    half = F.floor(F.length(html) / 2).cast("int")
    changed = F.concat(F.substring(html, F.lit(1), half), F.lit("~"), F.substring(html, half + 2, F.length(html)))
    return pages.withColumn("html", F.when(merkle.digest_number(key, 9, 4, 256) == 7, changed)
                            .when(merkle.digest_number(key, 13, 4, 512) == 9, F.substring(html, F.lit(1), half))
                            .otherwise(html))


@query
def op3_merkle_audit(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = merkle.file_count(pages)
    return merkle.audit(merkle.leaves(pages, files), merkle.leaves(damaged(pages), files))


@query
def op4_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(shared.documents(spark, sf_dir)).select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed", "kept")])


@query
def op5_suffix_tree_dedup(spark, sf_dir):
    return suffix_tree.remove_repeats(shared.documents(spark, sf_dir), length=35).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


TOXICITY = subword.Settings(segment=6, separators=" \t\n\x0b\f\r.,;:!?\"()", longest=4, epochs=2)
QUALITY = subword.Settings(fold_case=False, markers=True, epochs=3)


def _classified(spark, sf_dir, label, settings, modulus, remainder, threshold):
    docs = shared.documents(spark, sf_dir)
    held_out = subword.in_fold("doc_id", modulus, remainder)
    texts, labels, _ = subword.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label, held_out)
    model = subword.train(texts, labels, settings)
    return subword.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op6_toxicity(spark, sf_dir):
    return _classified(spark, sf_dir, "toxic", TOXICITY, 3, 1, 0.7)


@query
def op7_retrieval_packing(spark, sf_dir):
    return packing.pack(shared.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 4096).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_quality_classifier(spark, sf_dir):
    return _classified(spark, sf_dir, "quality", QUALITY, 5, 0, 0.3)


@query
def op9_wu_manber(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return wu_manber.contamination(shared.documents(spark, sf_dir), benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op10_bwt_merge_dedup(spark, sf_dir):
    return bwt_merge.remove_repeats(shared.documents(spark, sf_dir), length=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_recursive_manifest(spark, sf_dir):
    return manifest.audit_documents(shared.documents(spark, sf_dir))


@query
def op12_angular_negatives(spark, sf_dir):
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_distinct_word_bpe(spark, sf_dir):
    docs = shared.documents(spark, sf_dir)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
