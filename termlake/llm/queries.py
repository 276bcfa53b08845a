"""The corpus operators as queries (spark, sf_dir) -> DataFrame, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import op10_minhash, op1_langid, op2_lm, op3_secrets, op4_quality, op5_sharding, op6_decontam, op7_exact_dedup, op8_toxicity, op9_packing


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return op1_langid.language_id(_table(spark, sf_dir, "documents"))


def op2_attention_lm(spark, sf_dir):
    return op2_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    return op3_secrets.secrets(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return op4_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_hash_tree_sharding(spark, sf_dir):
    return op5_sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark, sf_dir):
    return op6_decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup_tree(spark, sf_dir):
    return op7_exact_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op8_toxicity_ordinal(spark, sf_dir):
    return op8_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_harmonic_packing(spark, sf_dir):
    return op9_packing.packed(_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark, sf_dir):
    return op10_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_attention_lm": op2_attention_lm,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_hash_tree_sharding": op5_hash_tree_sharding,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_exact_dedup_tree": op7_exact_dedup_tree,
    "op8_toxicity_ordinal": op8_toxicity_ordinal,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLE_SQL = {"op10_minhash_dedup": op10_minhash.ORACLE_SQL, "op3_secret_scan": op3_secrets.ORACLE_SQL, "op7_exact_dedup_tree": op7_exact_dedup.ORACLE_SQL}
