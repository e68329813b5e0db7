"""Spikes, rapid requests, routing imbalance and health over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .usage import HOUR_US, n_rows, newest_first, r6, since


def _spikes(log: DataFrame, value: str) -> DataFrame:
    """Rows above mean + 2 sample deviations, with both bounds as columns.

    The statistics are one mergeable aggregate row, read as a scalar: no window over the whole log.
    """
    stats = log.agg(n_rows().alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    bound = {
        k: stats.select(F.when((F.col("n") >= 3) & (F.col("s") > 0), F.col("m") + k * F.col("s")).alias("b")).scalar()
        for k in (2, 3)
    }
    return log.where(F.col(value) > bound[2]).withColumn("over_3", F.col(value) > bound[3])


def cost_spikes(log: DataFrame) -> DataFrame:
    return _spikes(log, "cost_usd").select(
        F.lit("cost_spike").alias("type"), F.when(F.col("over_3"), "critical").otherwise("warning").alias("severity"),
        "event_id", "us", r6(F.col("cost_usd")).alias("value"),
    )


def latency_spikes(log: DataFrame) -> DataFrame:
    return _spikes(log, "latency_ms").select(
        F.lit("latency_spike").alias("type"), F.lit("warning").alias("severity"),
        "event_id", "us", r6(F.col("latency_ms")).alias("value"),
    )


def rapid_queries(log: DataFrame, keys: list[str] | None = None, gap_us: int = 5_000_000) -> DataFrame:
    """The first request that follows its predecessor by less than ``gap_us`` (per ``keys`` if given).

    Two requests in one clock slot of that length are always rapid, so a slot needs only its two
    first rows and its last one; neighbouring slots are compared by an equi-join.
    """
    keys = keys or []
    slot = F.floor(F.col("us") / F.lit(gap_us))
    # equal times collapse to a count; the two smallest times of a slot decide
    times = log.groupBy(*keys, slot.alias("slot"), "us").agg(n_rows().alias("c"))
    firsts = times.groupBy(*keys, "slot").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.min_by("c", "us").alias("c_first"),
    )
    later = times.join(firsts.select(*keys, "slot", "first"), [*keys, "slot"]).where(F.col("us") > F.col("first"))
    seconds = later.groupBy(*keys, "slot").agg(F.min("us").alias("second"))
    slots = firsts.join(seconds, [*keys, "slot"], "left")
    before = firsts.select(*keys, (F.col("slot") + 1).alias("slot"), F.col("last").alias("prev"))
    both = slots.join(before, [*keys, "slot"], "left")
    inside_at = F.when(F.col("c_first") > 1, F.col("first")).otherwise(F.col("second"))
    hit = F.when(F.col("first") - F.col("prev") < gap_us,
                 F.struct(F.col("first").alias("at"), (F.col("first") - F.col("prev")).alias("gap")))
    hit = F.coalesce(hit, F.when(inside_at.isNotNull(),
                                 F.struct(inside_at.alias("at"), (inside_at - F.col("first")).alias("gap"))))
    found = both.select(*keys, hit.alias("hit")).where(F.col("hit").isNotNull()).groupBy(*keys).agg(F.min("hit").alias("hit"))
    return found.where(F.col("hit").isNotNull()).select(
        *keys, F.lit("rapid_queries").alias("type"), F.lit("info").alias("severity"),
        F.col("hit.at").alias("us"), F.round(F.col("hit.gap") / 1e6, 1).alias("value"),
    )


def routing_imbalance(log: DataFrame, large_model: str, limit: float = 0.8) -> DataFrame:
    s = log.agg(n_rows().alias("n"), F.count_if(F.contains(F.col("model"), F.lit(large_model))).alias("big"))
    share = T.ratio(F.col("big"), F.col("n"))
    return s.where((F.col("n") >= 5) & (share > limit)).select(
        F.lit("routing_imbalance").alias("type"), F.lit("warning").alias("severity"),
        r6(share).alias("value"),
    )


def anomaly_report(log: DataFrame, large_model: str, window_hours: int = 24) -> DataFrame:
    """Counts by type and severity over the four checks."""
    recent = since(log, window_hours * HOUR_US, strict=True)
    checks = [cost_spikes(recent), latency_spikes(recent), rapid_queries(recent), routing_imbalance(recent, large_model)]
    found = checks[0].select("type", "severity")
    for c in checks[1:]:
        found = found.unionByName(c.select("type", "severity"))
    return found.groupBy("type", "severity").agg(n_rows().alias("n"))


def health(log: DataFrame, last: int = 10) -> DataFrame:
    bad: Column = (F.col("latency_ms") > 30000) | (F.col("cost_usd") > 0.1)
    s = newest_first(log, last).agg(
        n_rows().alias("recent_queries"), F.avg("cost_usd").alias("c"), F.avg("latency_ms").alias("l"),
        F.count_if(bad).alias("bad"),
    )
    rate = T.ratio(F.col("bad"), F.col("recent_queries"))
    status = (
        F.when(F.col("recent_queries") == 0, "no_data").when(rate > 0.2, "degraded")
        .when(F.col("l") > 15000, "slow").otherwise("healthy")
    )
    total = log.select(n_rows().alias("n")).scalar()
    return s.select(
        status.alias("status"), r6(F.col("c")).alias("avg_cost"), F.round("l", 1).alias("avg_latency_ms"),
        F.round(rate, 3).alias("error_rate"), total.alias("total_queries"), "recent_queries",
    )
