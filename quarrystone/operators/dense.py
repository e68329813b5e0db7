"""Exact nearest vectors for a table of query vectors.

Queries are cut into blocks and matched against corpus slices, both of bounded size, whatever their
number.  A task keeps only its best ``top_k`` per query, so work is a matrix product and the shuffle of
the result is ``top_k`` rows per query and slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

# a score matrix has at most so many rows and columns: 80 MB
BLOCK_ROWS = 1000
SLICE_ROWS = 10_000
HITS = "qid long, vec_id long, score double"
DIGITS = 9  # scores are compared at this precision, so ties do not depend on summation order


def _unit(rows) -> np.ndarray:
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of each query; of equal scores the smaller ids."""
    scores = np.round(queries @ vectors.T, DIGITS)
    if len(ids) > k:
        edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        row, col = np.nonzero(scores >= edge[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k], col[place < k]
    return pd.DataFrame({"qid": qids[row], "vec_id": ids[col], "score": scores[row, col]})


def nearest(queries: DataFrame, corpus: DataFrame, top_k: int = 10, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``qid, vec_id, score, rank``: the ``top_k`` corpus rows by cosine.

    ``queries(qid, embedding, ...)`` and ``corpus(vec_id, embedding, ...)``.  Any further columns of the queries are
    equality filters on the corpus columns of the same name: a query sees only rows that agree with all its
    filters that are not null.  Only rows that agree are multiplied.
    """
    filters = [c for c in queries.columns if c not in ("qid", "embedding")]
    queries, corpus = queries.select("qid", "embedding", *filters), corpus.select("vec_id", "embedding", *filters)
    blocks = max(1, -(-queries.count() // block_rows))
    slices = max(1, -(-corpus.count() // slice_rows))

    def up_to(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    q = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("s", up_to(slices))
    c = corpus.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(slices))).withColumn("b", up_to(blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"qid": [], "vec_id": [], "score": []})]
        if len(left) and len(right):
            ids, vectors = right["vec_id"].to_numpy(), _unit(right["embedding"])
            for wanted, mine in left.groupby(filters, dropna=False) if filters else [((), left)]:
                fits = np.ones(len(right), bool)
                for name, value in zip(filters, wanted, strict=True):
                    if not pd.isna(value):
                        fits &= (right[name] == value).to_numpy()
                if fits.any():
                    parts.append(_best(mine["qid"].to_numpy(), _unit(mine["embedding"]), ids[fits], vectors[fits], top_k))
        return pd.concat(parts[1:] or parts)

    local = q.groupBy("b", "s").cogroup(c.groupBy("b", "s")).applyInPandas(run, HITS)
    return ranks.top_per_group(local, ["qid"], [F.desc("score"), F.asc("vec_id")], top_k)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key: positions are averaged apart, so a large group is combined map-side."""
    per_dim = vectors.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Metadata stored with a vector; missing values get their defaults."""
    return chunks.select(
        "vec_id", "embedding", F.coalesce("ticker", F.lit("UNKNOWN")).alias("ticker"), F.coalesce("year", F.lit("UNKNOWN")).alias("year"),
        F.coalesce("section", F.lit("unknown")).alias("section"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("chunk_index", F.col("vec_id")).alias("chunk_index"),
    )
