"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontam, language_id, lempel_ziv_dedup, line_dedup, packing, pii, quality_rules, runlength_dedup, simhash_dedup, url_rules
from siltstone.llm.common import only, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.accepted(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_items(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.mine(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels"))))


def op7_runlength_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_dedup.duplicates(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op10_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv_dedup.duplicates(table(spark, sf_dir, "documents"))


def op7_runlength_index_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_dedup.duplicates(table(spark, sf_dir, "documents"), anywhere=True)


def op10_lempel_ziv_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv_dedup.duplicates(table(spark, sf_dir, "documents"), anywhere=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_url_rules": op6_url_rules,
    "op7_runlength_index": op7_runlength_index,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_lempel_ziv": op10_lempel_ziv,
    "op7_runlength_index_anywhere": op7_runlength_index_anywhere,
    "op10_lempel_ziv_anywhere": op10_lempel_ziv_anywhere,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_runlength_index": runlength_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_lempel_ziv": lempel_ziv_dedup.SQL,
}
