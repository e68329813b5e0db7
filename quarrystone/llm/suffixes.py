"""Repeated byte strings over the whole corpus by prefix-free parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import Shape, bytes_kind, remove_repeats


def dedup_bytes(docs: DataFrame, length: int = 200, reach: int = 96, gram: int = 16) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row.

    Rolling-hash triggers cut the texts into phrases; the dictionary holds the distinct ones, and the parse
    says how often each occurs.  Phrases overlap so far that any string of ``length`` bytes lies in one phrase: two
    suffixes are compared to that depth within the dictionary, weighted with the parse.  Suffixes of phrases whose
    order is open are named by 128-bit hashes of their first ``length`` bytes; equal names are neighbours
    in corpus order.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same row or
    another; both go.  Null texts are empty; texts below ``length`` bytes lose nothing.  Null and repeated ids are
    rows like any other; repeated rows are copies of each other.
    """
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # rows may share an id here, see remove_repeats
    found = remove_repeats(docs.select(id_.alias("id"), "text"), bytes_kind(Shape(length, reach, gram, "any")), "suffixes")
    none = F.lit(-(1 << 63)).cast("bigint")
    return found.select(F.nullif("id", none).alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
