"""Queries of the corpus operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, line_dedup, merkle, mixing, near_dedup, quality, shard, substring_dedup, trie, url_filter, warc
from .common import read


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op1(read(spark, sf_dir, "documents"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(read(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4(spark, read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op6(read(spark, sf_dir, "pages"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.op7(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op8(read(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op10(read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op11(read(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op12(read(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13(read(spark, sf_dir, "documents"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.base_columns(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring, op2_preference, op3_decontaminate, op4_warc, op5_quality, op6_url_filter, op7_shard, op8_near_dedup, op9_mix, op10_line_dedup, op11_bpe, op12_trie, op13_merkle, quality_base_columns)}
SQL = {"op1_substring": substring_dedup.OP1_SQL, "op2_preference": chat.OP2_SQL, "op4_warc": warc.OP4_SQL, "op6_url_filter": url_filter.OP6_SQL, "op3_decontaminate": decontaminate.OP3_SQL, "op8_near_dedup": near_dedup.OP8_SQL, "op9_mix": mixing.OP9_SQL, "quality_base_columns": quality.BASE_SQL, "op12_trie": trie.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
