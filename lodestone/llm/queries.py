"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import branches, conversations, decontaminate, licenses, lm, mixing, mpeg, near_vectors, ngram_join, quality, secrets, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digest(mpeg.encode(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches.digest(branches.merge_branches(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mpeg_media": op1_mpeg_media,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_ngram_join": op4_ngram_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_license_scan": op10_license_scan,
    "op11_branch_merge": op11_branch_merge,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_near_vectors": op13_near_vectors,
}

ORACLES: dict[str, str] = {
    "op4_ngram_join": ngram_join.JOIN_SQL,
    "op5_lm_scoring": lm.SCORE_SQL,
    "op9_mix_sources": mixing.MIX_SQL,
    "op10_license_scan": licenses.scan_sql(),
    "op11_branch_merge": branches.MERGE_SQL,
    "op13_near_vectors": near_vectors.LINK_SQL,
}
