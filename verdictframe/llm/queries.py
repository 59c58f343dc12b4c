"""Queries that apply the operators to whole tables, with their SQL twins where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_sharding, op2_line_dedup, op3_license, op4_backoff, op5_packing, op6_chat, op7_dart_minhash, op8_suffix, op9_mincut, op10_host_quality, op11_filter_audit, op12_bpe, op13_prefix_trie
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op2_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_line_dedup.report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_license.scan(table(spark, sf_dir, "documents"))


def op4_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_backoff.score(table(spark, sf_dir, "documents"))


def op5_packing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_packing.pack(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(control).alias("text"))
    turns = own.unionByName(more).select("conv_id", "turn", "role", op6_chat.text_parts(F.col("text")).alias("parts"))
    return op6_chat.read_back(op6_chat.format_turns(turns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_dart_minhash.report(table(spark, sf_dir, "documents"))


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_suffix.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mincut.extract(table(spark, sf_dir, "pages"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_host_quality.judge(table(spark, sf_dir, "documents"))


def op11_filter_audit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = op12_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return op12_bpe.digests(table(spark, sf_dir, "documents"), vocabulary)


def op13_prefix_trie_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix_trie.trie(op13_prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_sharding_slots, op2_line_winnowing, op3_license_scan, op4_lm_backoff, op5_packing_columns, op6_chat_format, op7_near_dedup, op8_suffix_decontamination, op9_html_mincut, op10_host_rules,
    op11_filter_audit_lists, op12_byte_bpe, op13_prefix_trie_rollup)}
