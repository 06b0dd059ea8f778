"""The registered queries of this subpackage: one for each operator, over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import chat_views, jaccard_join, kmeans, media, merkle, mixing, packing, pii, quality_pu, quality_rules, relative_lz, toxicity, url_rules
from loomwright.llm.common import table


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.rotate(table(spark, sf_dir, "conversations"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_line_ends).drop("path")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.digests(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_pu": op1_quality_pu,
    "op2_chat_views": op2_chat_views,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op2_chat_views": chat_views.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op6_url_filters": url_rules.oracle(),
    "op10_quality_rules": quality_rules.oracle(),
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_substring_dedup": relative_lz.ORACLE,
    "op13_centroid_clustering": kmeans.ORACLE,
}
