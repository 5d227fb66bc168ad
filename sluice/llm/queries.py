"""The dealt operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_training
from .conversations import audit_conversations, damage
from .fingerprints import compare_fingerprints
from .jaccard import jaccard_components
from .langid import identify_languages
from .mixing import mix_sources
from .packing import pack_documents
from .quality_gbt import classify_quality
from .quality_rules import apply_quality_rules
from .resampling import resample
from .secrets import scan_secrets
from .simhash import simhash_components
from .substrings import remove_repeated_windows
from .suffixes import remove_repeated_strings


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_strings(_documents(spark, sf)).drop("kept")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return apply_quality_rules(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    found = identify_languages(docs, in_training(docs["doc_id"]))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "accepted")


def op4_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_documents(spark, sf))


def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_windows(_documents(spark, sf)).drop("intervals", "kept_text")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = classify_quality(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), train_where=in_training)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf)).drop("found")


def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return compare_fingerprints(_documents(spark, sf))


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(_documents(spark, sf)).select("doc_id", "fingerprint", "component_id")


def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return audit_conversations(damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffixes, op2_quality_rules, op3_language, op4_jaccard, op5_packing, op6_substrings, op7_quality, op8_mixing, op9_secrets, op10_fingerprints, op11_resampling, op12_simhash, op13_conversations)
}
