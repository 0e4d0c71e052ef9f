"""The llm queries: name -> query over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bestfit_packing, exact_dedup, histogram_packing, lang_id, license_scan, lm_bloom, minhash_dedup, mixing, oracles, order_minhash, url_filter
from millrace.llm.bpe import tokenizer_path
from millrace.llm.text import fold_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bestfit_packing.matrices(_table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("sequence_id", "n_tokens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return lang_id.identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = lm_bloom.train_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("detections")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_sensitivity(_table(spark, sf_dir, "documents"))


# What SQL can say of the queries above that it can't express whole, from the same operators.


def folds_of_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("without_letters"))


def base_of_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_bloom_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_of_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_word", "last_word")], "base_labels")


def edits_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_matrices": op3_token_matrices,
    "op4_language_id": op4_language_id,
    "op5_bloom_lm": op5_bloom_lm,
    "op6_histogram_packing": op6_histogram_packing,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_order_minhash": op10_order_minhash,
    "folds_of_op4": folds_of_op4,
    "base_of_op5": base_of_op5,
    "base_of_op8": base_of_op8,
    "edits_of_op10": edits_of_op10,
}

ORACLE_SQL = {
    "op1_exact_dedup": oracles.EXACT,
    "op2_url_filter": oracles.urls(),
    "op7_minhash_dedup": oracles.NEAR,
    "folds_of_op4": oracles.FOLDS,
    "base_of_op5": oracles.BASE_COUNTS,
    "base_of_op8": oracles.BASE_PHRASES,
    "edits_of_op10": oracles.EDITS,
}
