"""Hard negatives from Hilbert-ordered blocks of vectors, read only where their zone maps allow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import top_per_group
from ..session import materialize

#: Components become whole numbers of this fraction of one; greater ones than LARGEST could give scores that no long holds.
STEP, LARGEST = 256, 1 << 26
#: Bits of a component in the Hilbert key, rows of a block, anchors of a chunk, zone maps of a group.
BITS, ROWS, ANCHORS, ZONES = 4, 512, 256, 1024
#: Chunks whose best rows a task holds.
HELD = 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1

BLOCK = "block long, label int, ids array<long>, vecs binary, lo array<long>, hi array<long>"
CHUNK = "chunk long, ids array<long>, labels array<int>, vecs binary"
FOUND = "chunk long, at int, anchor long, name long, score long, id long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, components as whole numbers and short vectors filled with zeros."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * STEP))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * STEP) < LARGEST))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    one = materialize(one, "negatives-vectors")
    dims = one.agg(F.max(F.size("v"))).first()[0] or 0
    return one.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v"))))


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Keys of points with components of ``bits`` bits: sorted, they run along a Hilbert curve."""
    x = x.astype(np.uint32)
    n, dims = x.shape
    bit = 1 << (bits - 1)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(dims):
            far = (x[:, i] & q) != 0
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(far, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[:, -1] & q, np.uint32(q - 1), np.uint32(0)) if dims else turn
    x ^= turn[:, None]
    planes = [(x & (bit >> b)) != 0 for b in range(bits)]
    packed = np.packbits(np.concatenate(planes, axis=1), axis=1) if dims else np.zeros((n, 0), np.uint8)
    return [r.tobytes() for r in packed]


def matrix(rows: pa.Array, n: int) -> np.ndarray:
    """``n`` lists of equal length as a matrix."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds ``key``, the place on the Hilbert curve through the box that all vectors fill."""
    first = rows.select(F.size("v").alias("d")).first()
    dims = first.d if first else 0
    box = rows.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first() if dims else {}
    lo = np.array([box[f"lo{i}"] for i in range(dims)], np.int64)
    width = np.maximum(np.array([box[f"hi{i}"] for i in range(dims)], np.int64) - lo, 1)

    def key(v: pa.Array) -> pa.Array:
        cells = (matrix(v, len(v)) - lo) * ((1 << BITS) - 1) // width
        return pa.array(hilbert_keys(cells, BITS), pa.binary())

    return rows.withColumn("key", F.arrow_udf(key, "binary")(F.col("v")))


def runs(batches: Iterator[pa.RecordBatch], size: int, pure: bool) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Consecutive rows ``vec_id, label, v`` in runs of at most ``size``, each of one label if ``pure``."""
    ids, labels, vecs = [], [], []
    for b in batches:
        for i, label, v in zip(b["vec_id"].to_pylist(), b["label"].to_pylist(), matrix(b["v"], b.num_rows), strict=True):
            if ids and (len(ids) == size or pure and label != labels[0]):
                yield ids, labels, np.array(vecs)
                ids, labels, vecs = [], [], []
            ids.append(i)
            labels.append(label)
            vecs.append(v)
    if ids:
        yield ids, labels, np.array(vecs)


def written_blocks(keyed: DataFrame, rows: int) -> DataFrame:
    """Blocks of one label, in the order of the curve, with the least and greatest of each component (the zone map)."""

    def run(batches):
        for ids, labels, v in runs(batches, rows, pure=True):
            yield pa.RecordBatch.from_pylist([{"block": ids[0], "label": labels[0], "ids": ids, "vecs": v.astype("<i4").tobytes(), "lo": v.min(0).tolist(), "hi": v.max(0).tolist()}],
                                             pa.schema([("block", pa.int64()), ("label", pa.int32()), ("ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]))

    order = ["label", "key", "vec_id"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.select("vec_id", "label", "v").mapInArrow(run, BLOCK), "negatives-blocks")


def written_chunks(keyed: DataFrame) -> DataFrame:
    """Anchors that lie near each other, packed into rows."""

    def run(batches):
        for ids, labels, v in runs(batches, ANCHORS, pure=False):
            yield pa.RecordBatch.from_pylist([{"chunk": ids[0], "ids": ids, "labels": labels, "vecs": v.astype("<i4").tobytes()}],
                                             pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("vecs", pa.binary())]))

    ordered = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    return materialize(ordered.select("vec_id", "label", "v").mapInArrow(run, CHUNK), "negatives-chunks")


def unpacked(vecs: bytes, n: int) -> np.ndarray:
    return np.frombuffer(vecs, "<i4").astype(np.int64).reshape(n, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``: as floats where these hold every sum, else as whole numbers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def may_read(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that an anchor (row) can have with a vector in a block's box (column)."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(plus, lo) + products(minus, hi), products(plus, hi) + products(minus, lo)


def chosen(windows: np.ndarray, labels: np.ndarray, zone_labels: np.ndarray, down: np.ndarray, up: np.ndarray, same: bool, seeds: bool) -> np.ndarray:
    """Which blocks (column) a window (row of ``at, low, high, least``) reads.

    First (``seeds``) the one whose middle is nearest to the window's upper end; then every other one whose
    interval meets the window above what the first has already brought.
    """
    at, low, high, least = windows.T
    alike = (zone_labels[None, :] == labels[at][:, None]) == same
    fits = alike & (up[at] >= low[:, None]) & (down[at] <= high[:, None])
    middle = down[at] / 2 + up[at] / 2
    far = np.where(fits, np.abs(np.minimum(high.astype(float), 2.0**62)[:, None] - middle), np.inf)
    first = np.zeros_like(fits)
    if fits.size:
        first[np.arange(len(at)), far.argmin(1)] = True
    first &= fits
    return first if seeds else fits & ~first & (up[at] >= least[:, None])


def picks(chunks: DataFrame, windows: DataFrame, groups: DataFrame, n_groups: int, same: bool, seeds: bool) -> DataFrame:
    """For each block and chunk the vectors and windows that read the block."""
    listed = windows.groupBy("chunk").agg(F.collect_list(F.struct("at", "anchor", "name", "low", "high", "least")).alias("windows"))
    dealt = chunks.join(listed, "chunk").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                zones, asked = b["zones"][r].values, b["windows"][r].values
                ids, labels = b["ids"][r].values.to_numpy(), b["labels"][r].values.to_numpy()
                anchors = unpacked(b["vecs"][r].as_py(), len(ids))
                n = len(zones)
                down, up = may_read(anchors, matrix(zones.field("lo"), n), matrix(zones.field("hi"), n))
                w = np.stack([asked.field(f).to_numpy().astype(np.int64) for f in ("at", "low", "high", "least")], axis=1)
                read = chosen(w, labels, zones.field("label").to_numpy(), down, up, same, seeds)
                blocks = zones.field("block").to_numpy()
                for k in np.flatnonzero(read.any(0)):
                    mine = np.flatnonzero(read[:, k])
                    used, place = np.unique(w[mine, 0], return_inverse=True)
                    kept = asked.take(pa.array(mine))
                    fields = {f.name: kept.field(f.name) for f in kept.type}
                    # the place of a window's anchor among the vectors sent along
                    fields["row"] = pa.array(place.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([blocks[k]]), b["chunk"].slice(r, 1), pa.array([anchors[used].astype("<i4").tobytes()], pa.binary()), pa.array([len(used)], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))],
                        ["block", "chunk", "anchors", "n", "windows"])

    schema = "block long, chunk long, anchors binary, n int, windows array<struct<at:int, anchor:long, name:long, low:long, high:long, least:long, row:int>>"
    return dealt.join(groups, "group").select("chunk", "ids", "labels", "vecs", "windows", "zones").mapInArrow(run, schema)


def scored(picked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each picked block for each window."""

    names = ["at", "anchor", "name", "score", "id"]

    def best(rows: np.ndarray) -> np.ndarray:
        """The first ``k`` rows of each window, of the rows (columns of ``names``) of a chunk."""
        rows = rows[np.lexsort((rows[:, 4], -rows[:, 3], rows[:, 2], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, [0, 2]] != rows[:-1, [0, 2]]).any(1)
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        return rows[place < k]

    def told(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk)), *[pa.array(c.astype(np.int32 if n == "at" else np.int64)) for n, c in zip(names, rows.T)]], ["chunk", *names])
        held.clear()

    def run(batches):
        # what a task finds in several blocks for one chunk is cut to the best before it leaves; a few chunks are held at a time
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r in range(b.num_rows):
                ids, asked = b["ids"][r].values.to_numpy(), b["windows"][r].values
                f = {n: asked.field(n).to_numpy() for n in ("at", "anchor", "name", "low", "high", "least", "row")}
                scores = products(unpacked(b["anchors"][r].as_py(), b["n"][r].as_py()), unpacked(b["vecs"][r].as_py(), len(ids)))
                s = scores[f["row"]]
                ok = (s >= np.maximum(f["low"], f["least"])[:, None]) & (s <= f["high"][:, None]) & (ids[None, :] != f["anchor"][:, None])
                w, c = np.nonzero(ok)
                found = np.stack([f["at"][w].astype(np.int64), f["anchor"][w], f["name"][w], s[w, c], ids[c]], axis=1)
                chunk = b["chunk"][r].as_py()
                held[chunk] = best(np.concatenate([held.get(chunk, found[:0]), found]))
                if len(held) > HELD:
                    yield from told(held)
        yield from told(held)

    return picked.join(blocks.select("block", "ids", "vecs"), "block").select("chunk", "anchors", "n", "windows", "ids", "vecs").mapInArrow(run, FOUND)


def search(chunks: DataFrame, windows: DataFrame, blocks: DataFrame, groups: DataFrame, n_groups: int, k: int, same: bool, label: str) -> DataFrame:
    """The first ``k`` rows (``rank, score, id``) of each window ``chunk, at, anchor, name, low, high``, exactly.

    Each window first reads one block a group of zone maps; the ``k``-th score it then has rules out the blocks whose
    greatest possible score lies below.
    """
    window = ["chunk", "at", "anchor", "name"]
    order = [F.desc("score"), F.col("id")]
    start = windows.withColumn("least", F.lit(LEAST))
    seeds = materialize(top_per_group(scored(picks(chunks, start, groups, n_groups, same, True), blocks, k), window, order, k), f"negatives-{label}-first")
    full = seeds.where(F.col("rank") == k).select(*window, F.col("score").alias("least"))
    again = windows.join(full, window, "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
    rest = scored(picks(chunks, again, groups, n_groups, same, False), blocks, k)
    return materialize(top_per_group(seeds.drop("rank").unionByName(rest), window, order, k), f"negatives-{label}")


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, rows: int = ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    Anchors are the rows whose id ``every`` divides; their positives the ``n_positives`` rows of their label with the
    highest inner product, their negatives the ``n_negatives`` highest rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's.  Equal scores go by id.

    Vectors lie in Parquet blocks of at most ``rows`` rows of one label, in the order of a Hilbert curve; interval arithmetic on
    their zone maps says which blocks a window reads.  A hot label or a vector that fills a third of the table is many blocks.

    Rows without id or label, without a vector, or with a null or non-finite component take no part, nor do those with
    a component of ``LARGEST / STEP`` or more.  Of rows with one id the least (label, vector) counts.  A vector shorter than
    the longest one ends in zeros.  An anchor without positives, or a window without rows, gives nothing.
    """
    keyed = materialize(with_keys(whole_vectors(vectors)), "negatives-keyed")
    blocks = written_blocks(keyed, rows)
    chunks = written_chunks(keyed.where(F.col("vec_id") % every == 0))
    n_groups = max(1, -(-blocks.count() // ZONES))
    groups = blocks.select(F.pmod(F.hash("block"), F.lit(n_groups)).alias("group"), F.struct("block", "label", "lo", "hi").alias("zone"))
    groups = materialize(groups.groupBy("group").agg(F.collect_list("zone").alias("zones")), "negatives-zones")

    anchors = chunks.select("chunk", F.posexplode("ids").alias("at", "anchor"))
    open_ = anchors.select("chunk", "at", "anchor", F.lit(0).cast("bigint").alias("name"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = search(chunks, open_, blocks, groups, n_groups, n_positives, True, "positives")
    positives = found.where("score >= 0").select("chunk", "at", "anchor", F.col("id").alias("name"), F.col("score").alias("positive_score"))
    bounds = {"low": F.expr(f"({low} * positive_score + 99) div 100"), "high": F.expr(f"({high} * positive_score) div 100")}
    windows = positives.withColumns(bounds)
    got = search(chunks, windows.drop("positive_score"), blocks, groups, n_groups, n_negatives, False, "negatives")
    out = got.join(positives, ["chunk", "at", "anchor", "name"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("name").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                      F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The query over ``embeddings``, where ids divisible by seven first move to the next of ten labels.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""
