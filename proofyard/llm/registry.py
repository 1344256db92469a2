"""The queries that apply each operator to its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import decontam, embed_dedup, html_text, licenses, minhash_dedup, mixing, pii, pst, quality, url_rules
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), everywhere=True)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document lies in the directory of its language within that of its source, under a name that is none of a licence
    file: documents have no paths, so none speaks for another and nothing is inherited here."""
    path = F.concat_ws("/", "source", "lang", "doc_id")
    found = licenses.scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    number = lambda p: F.element_at(F.split(p, "/"), -1).try_cast("long")
    return found.select(number(F.col("path")).alias("doc_id"), "licence", "score", "origin", number(F.col("inherited_from")).alias("from_doc_id"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.CONTRACT + url_rules.PATTERNS)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _shipped(query)
    for query in (
        op1_personal_data, op2_benchmark_decontamination, op3_license_scan, op4_embedding_near_dedup, op5_minhash_near_dedup,
        op6_html_extraction, op7_url_filters, op8_quality_classifier, op9_source_mixing, op10_suffix_tree_scores,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_url_filters": url_rules.oracle(url_rules.CONTRACT + url_rules.PATTERNS)}
