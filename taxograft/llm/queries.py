"""The registered queries of the subpackage and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.llm import (
    decontaminate, exact_dup, fixity, hosts, lexical, licenses, mixing, near_dup, pii, quality, repeats, spelling, toxicity,
)
from taxograft.llm.common import table


def op1_pii_sanitisation(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op3_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("mark")


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("mark")


def op5_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op6_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return hosts.filter_urls(pages, hosts.labelled_pages(pages, table(spark, folder, "labels")))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.near_duplicates(
        table(spark, folder, "documents"), width=3, threshold=Fraction(17, 20), bands=26, rows=5
    )
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dup.exact_duplicates(table(spark, folder, "documents")).drop("mark")


def op10_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    host, _ = hosts.host_and_path(F.col("url"))
    records = fixity.catalogue(table(spark, folder, "pages"), host)
    return fixity.audit(records, fixity.damaged_replica(records)).drop("digest")


def op11_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii_sanitisation, op2_license_scan, op3_toxicity_chain, op4_benchmark_leaks, op5_pfair_mixing,
        op6_host_reputation, op7_minhash_near_dedup, op8_quality_classifier, op9_exact_dedup, op10_merkle_fixity,
        op11_repeated_substrings, op12_spelling_variants, op13_ranked_search,
    )
}

ORACLES: dict[str, str] = {
    "op6_host_reputation": hosts.SQL,
    "op9_exact_dedup": exact_dup.SQL,
    "op10_merkle_fixity": fixity.SQL,
    "op11_repeated_substrings": repeats.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_ranked_search": lexical.SQL,
}
