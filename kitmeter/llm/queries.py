"""The thirteen queries, with production parameters, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, htmltext, jaccard, langid, licenses, lines, middle, packing, pii, runs, secrets, sharding
from .oracle import ORACLE


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir)).drop("n_links")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contamination(_documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), together=True)


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir)).drop("n_entropy")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_documents(spark, sf_dir)).drop("n_term")


def _repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth (by checksum of doc_id) from some place on in periods."""
    n = len(words)
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or rest or not n:
        return words
    a = g % n
    root = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * -(-(n - a) // len(root)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_documents(spark, sf_dir), _repeating)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(_documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_ngram_jaccard, op3_license_scan, op4_decontamination, op5_hilbert_sharding, op6_html_crf, op7_fingerprints, op8_best_two_fit, op9_secret_scan, op10_pii, op11_periodic_runs, op12_fill_in_middle, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
