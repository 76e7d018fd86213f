"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import ann, clustering, decontaminate, exact_topk, html, licenses, near_dup, negatives, packing, pii, sharding, toxicity, urls
from tabloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = urls.with_quality(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return urls.judge(labelled, good_col="good")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="query-key")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), moved)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_html_extraction,
    op2_toxicity,
    op3_minhash_near_dedup,
    op4_packing,
    op5_url_filter,
    op6_nearest_neighbours,
    op7_license_scan,
    op8_sharding,
    op9_decontamination,
    op10_pii,
    op11_exact_topk,
    op12_hard_negatives,
    op13_centroid_clustering,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

#: The others have no SQL: markup, trees, MinHash, token ids, a graph walk, a seeded shuffle, lookbehind, keyed rounds.
ORACLES: dict[str, str] = {
    "op5_url_filter": urls.SQL,
    "op7_license_scan": licenses.SQL,
    "op11_exact_topk": exact_topk.sql(),
    "op12_hard_negatives": negatives.sql("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"),
    "op13_centroid_clustering": clustering.sql(),
}
