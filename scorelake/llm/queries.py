"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.common import table
from scorelake.llm.oracles import ORACLES


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.suffix import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.pieces import encoded

    return encoded(table(spark, sf_dir, "documents"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.conversations import damaged, repair_conversations

    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.fim import middle_digests

    return middle_digests(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
