"""Registered queries of the llm operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velado.llm import bpe, hostrules, jaccard, langid, ngramlm, oracles, packing, quality, ranked, repair, search, sharding, substring, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return substring.remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(_docs(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_docs(spark, sf_dir))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_rules(_docs(spark, sf_dir)).drop("host_rate", "host_low")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.perplexity(_docs(spark, sf_dir))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_pack": op2_pack,
        "op3_search": op3_search,
        "op4_langid": op4_langid,
        "op5_bpe": op5_bpe,
        "op6_quality": op6_quality,
        "op7_shard": op7_shard,
        "op8_toxicity": op8_toxicity,
        "op9_jaccard": op9_jaccard,
        "op10_host_rules": op10_host_rules,
        "op11_ranked": op11_ranked,
        "op12_lm": op12_lm,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring": oracles.OP1,
        "op3_search": oracles.OP3,
        "op9_jaccard": oracles.OP9,
        "op10_host_rules": oracles.OP10,
        "op11_ranked": oracles.OP11,
        "op12_lm": oracles.OP12,
        "op13_repair": oracles.OP13,
    }
