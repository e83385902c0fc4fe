"""The queries that __spark_entry__.py adds, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilum.llm import crf, decontam, mix, pii, quality, rules, simhash, substrings, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mix.op1(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"))


def op3_pii_pseudonyms(spark, sf_dir):
    return pii.op3(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.op7(_table(spark, sf_dir, "documents"))


def op10_simhash_neardup(spark, sf_dir):
    return simhash.op10(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontam.op4(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark, sf_dir):
    return rules.op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_scores(spark, sf_dir):
    return quality.op8(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc_archive(spark, sf_dir):
    return warc.op9(_table(spark, sf_dir, "pages"))


def op5_html_main_text(spark, sf_dir):
    return crf.op5(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op7_substring_dedup": op7_substring_dedup,
    "op10_simhash_neardup": op10_simhash_neardup,
    "op4_decontaminate": op4_decontaminate,
    "op6_quality_rules": op6_quality_rules,
    "op8_quality_scores": op8_quality_scores,
    "op9_warc_archive": op9_warc_archive,
    "op5_html_main_text": op5_html_main_text,
}
ORACLE_SQL = {
    "op1_mix_sources": mix.OP1_SQL,
    "op2_url_filter": urls.OP2_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op4_decontaminate": decontam.OP4_SQL,
    "op9_warc_archive": warc.OP9_SQL,
}
