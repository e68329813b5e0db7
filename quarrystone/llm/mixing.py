"""Mixing sources to target weights: Pfair windows and earliest deadline first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, quoted

#: Rows that one task numbers at a time, at most (unless more share one hash).
RUN_ROWS = 50_000


def source_key(source: Column) -> Column:
    """A key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def tickets(counts: DataFrame, weights: DataFrame | None, resolution: int, power: float) -> DataFrame:
    """``key, t``: whole shares of the target weights, at least one.

    Without ``weights`` (``source, weight``) the target is the source's row count to the ``power``: 1 keeps the
    shares as they are, 0 makes them equal.  A source without a positive weight gets the smallest share.
    """
    if weights is None:
        weighed = counts.select("key", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w"))
    else:
        given = weights.groupBy(source_key(F.col("source")).alias("key")).agg(F.max("weight").cast("double").alias("w"))
        weighed = counts.join(given, "key", "left").select("key", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("w").alias("total"))
    share = F.floor(F.lit(resolution) * F.col("w") / F.col("total") + 0.5)
    # total is one row
    return weighed.withColumn("total", total.scalar()).select("key", F.greatest(F.lit(1), F.coalesce(share, F.lit(1))).cast("int").alias("t"))


def schedule(shares: DataFrame) -> DataFrame:
    """``key, t, period, slots``: the slots of a source's blocks within one period.

    Shares of a period of sum(t) slots: block j of a source is released at floor(j * period / t) and due at
    ceil((j + 1) * period / t), and each slot goes to the released block that is due first.  On one sequence that
    meets all deadlines, and after a whole period everything begins anew, so one period of some thousand slots,
    a row per source of the target, is all that is ever worked out.
    """
    rows = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "t"))).alias("s"), F.sum("t").cast("int").alias("period"))
    s, period = F.col("s"), F.col("period")
    start = F.struct(F.transform(s, lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        # due date and number of each released block; an unreleased one is null and sorts out
        due = F.transform(s, lambda x, k: F.when(
            F.floor(F.get(state["done"], k) * period / x["t"]) <= slot,
            F.struct(F.ceil((F.get(state["done"], k) + 1) * period / x["t"]).alias("due"), k.alias("k"))))
        chosen = F.array_min(due)["k"]
        return F.transform(F.array(chosen), lambda c: F.struct(
            F.transform(state["done"], lambda d, k: F.when(k == c, d + 1).otherwise(d)).alias("done"),
            F.concat(state["order"], F.array(c)).alias("order")))[0]

    order = F.aggregate(F.sequence(F.lit(0), period - 1), start, step)["order"]
    planned = rows.where(period > 0).select("s", "period", order.alias("order"))
    each = planned.select("period", "order", F.posexplode("s").alias("k", "x"))
    places = F.filter(F.sequence(F.lit(0), F.col("period") - 1), lambda p: F.get("order", p) == F.col("k"))
    return each.select("x.key", "x.t", "period", places.alias("slots"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = 32, resolution: int = 1000, power: float = 0.5, tie: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with one struct column more, the result's last: its place in the mixed sequence.

    ``block`` numbers the source's blocks of ``block_docs`` rows, in the order of a hash of ``doc_id``;
    ``release`` and ``due`` bound the ``slot`` the block has; ``place`` orders all rows.  Up to the slot at which the first source
    ends, every prefix of the sequence holds of each source its weight's share of blocks, to less than one block.
    Later its slots stay free and the others go on at theirs: no row is dropped or repeated.

    A null source is a source.  Null and equal ids have equal hashes and are ordered by ``tie``; full ties are
    numbered in any order.  No column of ``docs`` is changed.
    """
    key, h, run, no, out = free_names(docs, "key", "hash", "run", "no", "mixed")
    counts = docs.groupBy(source_key(F.col("source")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    # the hash's leading digits part a source into runs that one task can number, however large the source is
    total, digits = counts.agg(F.sum("n")).first()[0] or 0, 1
    while total > RUN_ROWS * 16 ** digits:
        digits += 1
    keyed = docs.withColumns({key: source_key(F.col("source")), h: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}).withColumn(run, F.left(F.col(h), F.lit(digits)))
    sizes = keyed.groupBy(F.col(key).alias("r_key"), F.col(run).alias("r_run")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("r_key").orderBy("r_run")) - F.col("n")
    plan = schedule(tickets(counts, weights, resolution, power)).withColumnRenamed("key", "p_key")
    runs = sizes.select("r_key", "r_run", before.alias("before")).join(plan, F.col("r_key") == F.col("p_key"))
    runs = runs.select("r_key", "r_run", F.struct("before", "t", "period", "slots").alias("r_plan"))
    order = [F.col(h), *([tie] if tie is not None else [])]
    numbered = keyed.withColumn(no, F.row_number().over(Window.partitionBy(key, run).orderBy(*order)) - 1)
    placed = numbered.join(runs, (F.col(key) == F.col("r_key")) & (F.col(run) == F.col("r_run")))
    p = F.col("r_plan")
    nth = p["before"] + F.col(no)
    block = F.floor(nth / block_docs)
    slot = F.floor(block / p["t"]) * p["period"] + F.get(p["slots"], (block % p["t"]).cast("int"))
    return placed.select(*quoted(docs.columns), F.struct(
        block.alias("block"), slot.alias("slot"), F.floor(block * p["period"] / p["t"]).alias("release"),
        F.ceil((block + 1) * p["period"] / p["t"]).alias("due"), (slot * block_docs + nth % block_docs).alias("place")).alias(out))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, block, slot, release, due, place`` of each row."""
    mixed = mix(docs.select("doc_id", "source"), **options)
    return mixed.select("doc_id", "source", f"{mixed.columns[-1]}.*")


SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, source,
    greatest(1, floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) + 0.5))::BIGINT AS t FROM counts),
period AS (SELECT sum(t)::BIGINT AS p FROM shares),
edf(slot, k, t, done, picked) AS (
  SELECT -1::BIGINT, k, t, 0::BIGINT, false FROM shares
  UNION ALL
  SELECT slot, k, t, done, row_number() OVER (ORDER BY done * p // t > slot, ((done + 1) * p + t - 1) // t, k) = 1
  FROM (SELECT slot + 1 AS slot, k, t, done + picked::BIGINT AS done, p FROM edf, period WHERE slot < p - 1)),
slots AS (SELECT k, done AS nth, slot FROM edf WHERE picked),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS i FROM documents),
blocks AS (SELECT doc_id, n.source, i, i // 32 AS block, k, t, p FROM numbered n JOIN shares s ON n.source IS NOT DISTINCT FROM s.source, period)
SELECT doc_id, source, block, block // t * p + slot AS slot, block * p // t AS release, ((block + 1) * p + t - 1) // t AS due,
  (block // t * p + slot) * 32 + i % 32 AS place
FROM blocks b JOIN slots s ON b.k = s.k AND b.block % b.t = s.nth
"""
