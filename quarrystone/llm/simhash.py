"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import materialize
from .common import text_udf, word_pieces

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> tuple[int]:
    """64 bits as a signed number; bit i is set if it is set in over half of the shingles' hashes."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or b"").lower()):
        words = tail + words
        tail = words[1 - shingle:] if shingle > 1 else []
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
    if not total and tail:  # fewer words than a shingle has: the whole sequence is one
        ones += np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], "<u8").view(np.uint8), bitorder="little")
        total = 1
    return (int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]),)


def fingerprint_udf(shingle: int):
    return text_udf(partial(fingerprint, shingle=shingle), {"fp": pa.int64()})


def ball(half: int) -> list[int]:
    """All masks of at most ``half`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``subject, object``: fingerprints of a distinct column ``fp``, joined so that any two at most ``radius`` bits apart are connected.

    Every fingerprint emits all variants within half the radius; two that are close enough meet in one.  The
    ones that meet at a variant are all within the radius of each other, and no more can meet than a
    ball has points (65 at radius 2), so each is linked to the least of them.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: half of it is spent on either side")
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(radius // 2)])
    variants = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where(F.col("fp") > F.col("least")).select(F.col("least").alias("subject"), F.col("fp").alias("object")).distinct()
    return pairs.where(F.bit_count(F.col("subject").bitwiseXOR(F.col("object"))) <= radius)


def label_prints(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, label`` for a table of ``fp, first``: the least ``first`` of all fingerprints that ``edges`` reach."""
    return label_parts(prints, materialize(components(materialize(edges, "simhash-links")).withColumnRenamed("node", "fp"), "simhash-parts"))


def label_parts(prints: DataFrame, parts: DataFrame) -> DataFrame:
    """As ``label_prints``, of fingerprints whose ``component`` is known."""
    least = parts.join(prints.select("fp", "first"), "fp").groupBy("component").agg(F.min("first").alias("least"))
    moved = parts.join(least, "component").select("fp", "least")
    return prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the least ``doc_id`` that is reachable.  Equal
    texts share one fingerprint and are linked through it, never in pairs.  Null, empty and blank texts
    have fingerprint 0, which is linked like any other.  A null ``doc_id`` is never a component's id, unless
    no row of it has another.  Repeated rows come back as often as they were given.
    """
    narrow = docs.select("doc_id", fingerprint_udf(shingle)(F.col("text"))["fp"].alias("fp"))
    hashed = materialize(narrow, "simhash-prints")
    prints = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    # a written side lets adaptive execution split the rows of a fingerprint that many texts share
    named = hashed.join(materialize(label_prints(prints, links(prints.select("fp"), radius)), "simhash-labels"), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("label").alias("component_id"))
