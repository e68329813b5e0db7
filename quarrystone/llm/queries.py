"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, html, langid, lines, mixing, negatives, packing, pii, quality, simhash, substrings, suffixes, trie
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op9_quality_rules(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"))


@query
def op10_benchmark_decontamination(spark, folder):
    return contamination.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op1_substring_dedup(spark, folder):
    return substrings.dedup_substrings(table(spark, folder, "documents"))


@query
def op4_suffix_array_dedup(spark, folder):
    return suffixes.dedup_bytes(table(spark, folder, "documents"))


@query
def op6_source_mixing(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"))


ORACLES["op6_source_mixing"] = mixing.SQL.strip()


@query
def op7_line_dedup(spark, folder):
    return lines.line_report(table(spark, folder, "documents"))


ORACLES["op7_line_dedup"] = lines.SQL.strip()


@query
def op3_pii(spark, folder):
    return pii.pii_report(table(spark, folder, "documents"))


@query
def op5_language_id(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query
def op8_html_extraction(spark, folder):
    return html.extract_pages(table(spark, folder, "pages"))


@query
def op13_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op11_conversation_trie(spark, folder):
    return trie.prefix_trie(table(spark, folder, "conversations"))


@query
def op12_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", shifted))


ORACLES["op11_conversation_trie"] = trie.SQL.strip()
ORACLES["op12_hard_negatives"] = negatives.SQL.strip()
