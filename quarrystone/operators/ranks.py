"""Exact order statistics that never sort one hot group in one task.

A window partitioned by a group key puts the whole group into one task.  Here a group is first
cut into value ranges.  Range limits come from a mergeable quantile sketch (one bounded row per
group, written to the shared folder so that every later job sees the same limits); range totals
give each range its offset; only the rows of one range are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _limits(df: DataFrame, keys: list[str], value: Column, probs: list[float], accuracy: int) -> DataFrame:
    sketch = df.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(value, probs, accuracy))).alias("_limits")
    )
    return materialize(sketch, "limits")


def _below(limits: Column, value: Column) -> Column:
    return F.size(F.filter(limits, lambda b: b < value))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    specs: dict[str, tuple[str, float]],
    weight: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles per group.

    ``specs`` maps an output name to ``("linear", q)`` (interpolated at ``(n-1)*q``) or
    ``("nearest", q)`` (element ``floor(n*q)`` of the sorted list, the last one at most).
    ``weight`` counts repeated values.  The sketch only narrows down where a wanted rank lies;
    ranks are then counted exactly, so a poor sketch costs time, never correctness.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, specs, weight, accuracy).drop("_all")
    df = df.where(F.col(value).isNotNull())
    step = 2.0 / accuracy
    probs = sorted({min(1.0, max(0.0, q + d)) for _, q in specs.values() for d in (-step, step)})
    limits = _limits(df, keys, F.col(value).cast("double"), probs, accuracy)

    counted = materialize(
        df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")),
        "counted",
    )
    ranged = counted.join(limits, keys).withColumn("_range", _below(F.col("_limits"), F.col("_v"))).drop("_limits")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_n"))
    # at most 2 * len(probs) + 1 rows per group from here on
    by_range = Window.partitionBy(*keys).orderBy("_range")
    totals = materialize(
        totals.withColumn("_upto", F.sum("_n").over(by_range))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_from", F.col("_upto") - F.col("_n")),
        "ranges",
    )

    def ranks(kind: str, q: float) -> list[Column]:
        if kind == "nearest":
            return [F.least(F.floor(F.col("_total") * F.lit(q)), F.col("_total") - 1)]
        at = F.floor((F.col("_total") - 1) * F.lit(q))
        return [at, F.least(at + 1, F.col("_total") - 1)]

    wanted = F.array_distinct(F.array(*[r for kind, q in specs.values() for r in ranks(kind, q)]))
    targets = (
        totals.withColumn("_rank", F.explode(wanted))
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
        .select(*keys, "_range", "_rank", "_from", "_total")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    narrowed = (
        ranged.join(targets.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
        .withColumn("_upto", F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_upto") - F.col("_c"))
    )
    hit = (
        narrowed.join(targets, [*keys, "_range"])
        .where((F.col("_rank") - F.col("_from") >= F.col("_lo")) & (F.col("_rank") - F.col("_from") < F.col("_upto")))
    )
    found = hit.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"),
    )

    def answer(kind: str, q: float) -> Column:
        picked = [F.element_at("_at", r.cast("bigint")) for r in ranks(kind, q)]
        if kind == "nearest":
            return picked[0]
        pos = (F.col("_total") - 1) * F.lit(q)
        return picked[0] + (pos - F.floor(pos)) * (picked[1] - picked[0])

    return found.select(*keys, *[answer(k, q).alias(name) for name, (k, q) in specs.items()])


def ordered_prefix(
    df: DataFrame,
    keys: list[str],
    order: Column,
    tie: Column,
    rank: str | None = None,
    running: dict[str, str] | None = None,
    ranges: int = 64,
) -> DataFrame:
    """Add an exact row number and running sums in the order ``(order, tie)`` per group.

    ``order`` and ``tie`` are numeric and not null; ``tie`` is unique within a group.  A value that
    fills a whole range by itself is cut again by ``tie``, so one repeated value does not end up in
    one task either.
    """
    if not keys:
        return ordered_prefix(
            df.withColumn("_all", F.lit(1)), ["_all"], order, tie, rank, running, ranges
        ).drop("_all")
    running = running or {}
    probs = [i / ranges for i in range(1, ranges)]
    # ranges are cut on doubles; within a range the exact values decide
    base = df.withColumns({"_exact": F.struct(order.alias("o"), tie.alias("t")), "_o": order.cast("double"), "_t": tie.cast("double")})
    limits = _limits(base, keys, F.col("_o"), probs, 10_000)
    cut = (
        base.join(limits, keys)
        .withColumn(
            "_range",
            2 * _below(F.col("_limits"), F.col("_o")) + F.array_contains("_limits", F.col("_o")).cast("int"),
        )
        .drop("_limits")
    )
    cut = materialize(cut, "cut")
    at_limit = cut.where(F.col("_range") % 2 == 1)
    sub = _limits(at_limit, [*keys, "_range"], F.col("_t"), probs, 10_000)
    cut = (
        cut.join(sub, [*keys, "_range"], "left")
        .withColumn("_sub", F.coalesce(_below(F.col("_limits"), F.col("_t")), F.lit(0)))
        .drop("_limits")
    )
    slot = [*keys, "_range", "_sub"]
    sums = {"_rows": F.count(F.lit(1)), **{f"_s{i}": F.sum(c) for i, c in enumerate(running.values())}}
    # at most (2 * ranges) * ranges rows per group
    before = Window.partitionBy(*keys).orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*slot).agg(*[e.alias(n) for n, e in sums.items()]).select(
        *slot, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_off") for n in sums]
    )
    local = Window.partitionBy(*slot).orderBy("_exact")
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(offsets, slot)
    if rank:
        out = out.withColumn(rank, F.row_number().over(local) + F.col("_rows_off"))
    for i, (name, col) in enumerate(running.items()):
        out = out.withColumn(name, F.sum(col).over(upto) + F.col(f"_s{i}_off"))
    extra = ["_exact", "_o", "_t", "_range", "_sub", *[f"{n}_off" for n in sums]]
    return out.drop(*extra)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.  Spark cuts each task to ``n`` rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def spans_by_slot(df: DataFrame, keys: list[str], micros: str, gap_us: int) -> DataFrame:
    """Spans of activity per key, by clock slot: a new span starts after a silence of at least ``gap_us``.

    Two rows in one slot as long as the gap always share a span, so slots are aggregated first
    (map-side) and only slots, whose number depends on the calendar and not on the rows, are ordered.
    Columns: keys, ``slot``, ``span``, ``first_us``, ``last_us``, ``rows``.
    """
    slots = df.groupBy(*keys, slot_of(micros, gap_us).alias("slot")).agg(
        F.min(micros).alias("first_us"), F.max(micros).alias("last_us"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys).orderBy("slot")
    silence = F.col("first_us") - F.lag("last_us").over(w)
    starts = F.coalesce((silence >= gap_us).cast("int"), F.lit(1))
    return slots.withColumn("_start", starts).withColumn("span", F.sum("_start").over(w)).drop("_start")


def slot_of(micros: str, gap_us: int) -> Column:
    return F.floor(F.col(micros) / F.lit(gap_us))


def runs_by_gap(df: DataFrame, keys: list[str], micros: str, gap_us: int) -> DataFrame:
    """One row per span: keys, ``span``, ``first_us``, ``last_us``, ``rows``."""
    return spans_by_slot(df, keys, micros, gap_us).groupBy(*keys, "span").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("rows").alias("rows"))
