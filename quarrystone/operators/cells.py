"""A stored vector index: cells around centres, cut into rings, searched exactly by what cells can hold.

The index outlives a query.  A block holds vectors of one cell whose angle to the cell's centre lies between two limits; by
the triangle inequality on angles that bounds the cosine any query can have with them.  A query reads its most
promising block, and then only those whose bound reaches the k-th score it already has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialize
from . import ranks
from .dense import DIGITS, HITS

#: Rows that centres are fitted on, centres, and rounds of fitting: any choice gives the same hits, a good one fewer reads.
SAMPLE, CELLS, ROUNDS = 20_000, 256, 8
#: Rows of a block, queries of a chunk, rings of a group.
ROWS, QUERIES, RINGS = 1000, 500, 1024
#: More than rounding can add to a cosine, and to an angle, which is read from a cosine that may be close to 1.
SLACK, ANGLE_SLACK = 10.0 ** (1 - DIGITS), 1e-7
BLOCKS = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("vecs", pa.binary())])


@dataclass(frozen=True)
class VectorIndex:
    path: str
    blocks: DataFrame
    centres: np.ndarray

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        """At most ``CELLS`` centres come to the driver; the blocks stay where they are."""
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").select("centre").collect()
        return VectorIndex(path, spark.read.parquet(f"{path}/blocks"), np.array([r.centre for r in found], float))


def units(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by rounds of assignment and mean; an empty cell keeps its centre."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, units(sums), centres)
    return centres


def build_index(vectors: DataFrame, path: str | None = None, cells: int = CELLS, rows: int = ROWS) -> VectorIndex:
    """Store ``vec_id, embedding`` (ids not null and unique, vectors of one length) as blocks of at most ``rows`` rows.

    A vector of zeros has no angle; such vectors form a cell of their own, whose cosines are all 0.
    """
    spark = vectors.sparkSession
    path = path or fresh_path(spark, "vector-index")
    some = vectors.select("embedding").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()["embedding"]
    sample = units(np.array(list(some), float)) if len(some) else np.zeros((0, 0))
    sample = sample[np.any(sample != 0, axis=1)]
    centres = fitted(sample, min(cells, max(1, len(sample)))) if len(sample) else np.zeros((1, sample.shape[1]))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(matrix(b["embedding"]))
            cosine = x @ centres.T
            cell = np.where(np.any(x != 0, axis=1), cosine.argmax(1), -1).astype(np.int32)
            angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1)) * (cell >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), b["vec_id"], b["embedding"]], ["cell", "angle", "vec_id", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, angles = [h[2] for h in held], [h[1] for h in held]
            row = {"block": ids[0], "cell": held[0][0], "lo": min(angles), "hi": max(angles), "ids": ids, "vecs": units(np.array([h[3] for h in held], float)).tobytes()}
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("cell", "angle", "vec_id", "embedding")), strict=True):
                if held and (len(held) == rows or row[0] != held[0][0]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    narrow = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    placed = narrow.mapInArrow(place, "cell int, angle double, vec_id long, embedding array<double>")
    order = ["cell", "angle", "vec_id"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(pack, "block long, cell int, lo double, hi double, ids array<long>, vecs binary").write.parquet(f"{path}/blocks")
    return VectorIndex.load(spark, path)


def bounds(queries: np.ndarray, centres: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Greatest cosine that a query (row) can have with a vector of a block (column)."""
    away = np.arccos(np.clip(queries @ centres.T, -1, 1))[:, np.maximum(cell, 0)]
    least = np.maximum(np.maximum(lo - away, away - hi) - ANGLE_SLACK, 0)
    return np.where(cell < 0, 0.0, np.cos(least)) + SLACK


def _reads(queries: DataFrame, index: VectorIndex, first: bool) -> DataFrame:
    """``block``, and the queries (``qid, floor, seen, embedding``) that read it: their best one, or all that reach the floor and are not ``seen``.

    What has been read is given, not found again: of blocks with equal bounds another may be the best in another order.
    """
    chunks = max(1, -(-queries.count() // QUERIES))
    groups = max(1, -(-index.blocks.count() // RINGS))
    packed = queries.groupBy(F.pmod(F.xxhash64("qid"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("qid", "floor", "seen", "embedding")).alias("q"))
    rings = index.blocks.groupBy(F.pmod(F.hash("block"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("block", "cell", "lo", "hi")).alias("r"))
    dealt = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(rings, "group")
    centres = index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, r = b["q"][i].values, b["r"][i].values
                x = units(matrix(q.field("embedding")))
                up = bounds(x, centres, *(r.field(f).to_numpy() for f in ("cell", "lo", "hi")))
                if first:
                    read = np.zeros(up.shape, bool)
                    read[np.arange(len(x)), up.argmax(1)] = True
                else:
                    seen = np.array([np.isin(r.field("block").to_numpy(), s) for s in q.field("seen").to_pylist()])
                    read = ~seen & (up >= q.field("floor").to_numpy()[:, None])
                for k in np.flatnonzero(read.any(0)):
                    mine = np.flatnonzero(read[:, k])
                    yield pa.RecordBatch.from_arrays([r.field("block").slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), q.field("qid").take(pa.array(mine))),
                                                      pa.array([x[mine].tobytes()], pa.binary())], ["block", "qids", "x"])

    return dealt.select("q", "r").mapInArrow(run, "block long, qids array<long>, x binary")


def _hits(reads: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, ids = b["qids"][i].values.to_numpy(), b["ids"][i].values.to_numpy()
                x, v = (np.frombuffer(b[c][i].as_py()).reshape(n, -1) for c, n in (("x", len(qids)), ("vecs", len(ids))))
                scores = np.round(x @ v.T, DIGITS) + 0.0
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :k]
                rows = np.repeat(np.arange(len(qids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[order.ravel()]), pa.array(scores[rows, order.ravel()])], ["qid", "vec_id", "score"])

    return reads.join(index.blocks.select("block", "ids", "vecs"), "block").select("qids", "x", "ids", "vecs").mapInArrow(run, HITS)


def search(queries: DataFrame, index: VectorIndex, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``qid, vec_id, score, rank`` as ``dense.nearest`` gives them; and ``qid, blocks``, how many blocks each query has read.

    ``queries`` has ``qid`` (unique) and ``embedding``.  No vector is copied for a query that cannot want it.
    """
    order = [F.desc("score"), F.asc("vec_id")]
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.lit(-2.0).alias("floor"), F.array().cast("array<bigint>").alias("seen"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = materialize(_reads(asked, index, True), "index-first")
    seeds = materialize(ranks.top_per_group(_hits(first, index, top_k), ["qid"], order, top_k), "index-seeds")
    known = seeds.where(F.col("rank") == top_k).select("qid", F.col("score").alias("known"))
    read = first.select(F.explode("qids").alias("qid"), "block").groupBy("qid").agg(F.collect_list("block").alias("read"))
    again = asked.join(known, "qid", "left").join(read, "qid", "left").select("qid", F.coalesce("known", "floor").alias("floor"), F.coalesce("read", "seen").alias("seen"), "embedding")
    rest = materialize(_reads(again, index, False), "index-rest")
    hits = ranks.top_per_group(seeds.drop("rank").unionByName(_hits(rest, index, top_k)), ["qid"], order, top_k)
    visits = first.select(F.explode("qids").alias("qid")).unionByName(rest.select(F.explode("qids").alias("qid"))).groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"))
    return hits, visits
