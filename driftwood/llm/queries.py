"""The registered queries: each applies an operator with its production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import binary_ids, centroids, decontam, exchange, license_scan, lm, packing, partenum, quality, simhash, substring, token_counts, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_failed")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = exchange.shared_folder(spark)
    binary_ids.write_ids(_table(spark, sf_dir, "documents"), folder)
    return binary_ids.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.severity_grades(docs, _table(spark, sf_dir, "labels")), 3)
    return toxicity.grade_texts(docs, model)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_copies(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_sets(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


_ALL = (op1_license_scan, op2_packing, op3_quality, op4_substring, op5_decontam, op6_token_ids, op7_token_counts, op8_lm_scores, op9_toxicity, op10_simhash, op11_centroids, op12_similar_sets, op13_prefix_trie)
QUERIES = {f.__name__: f for f in _ALL}
