"""Rate limits, trailing counts, sessions, trailing spikes and running quotas over a log, in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000


@dataclass(frozen=True)
class Limits:
    per_minute: int = 60
    per_hour: int = 1000
    concurrent: int = 10


@dataclass
class Admission:
    """What one tenant's limiter remembers: admitted times of the last hour and running requests."""

    hour: deque = field(default_factory=deque)
    running: list = field(default_factory=list)

    def decide(self, now: int, duration: int, limits: Limits) -> tuple[bool, str, float]:
        while self.hour and now - self.hour[0] >= HOUR_US:
            self.hour.popleft()
        self.running = [end for end in self.running if end > now]
        minute = 0
        oldest = now
        for t in reversed(self.hour):
            if now - t >= MINUTE_US:
                break
            minute, oldest = minute + 1, t
        if len(self.running) >= limits.concurrent:
            return False, "concurrent_limit", 0.0
        if minute >= limits.per_minute:
            return False, "per_minute_limit", max(0.0, (MINUTE_US - (now - oldest)) / 1e6)
        if len(self.hour) >= limits.per_hour:
            return False, "per_hour_limit", max(0.0, (HOUR_US - (now - self.hour[0])) / 1e6)
        self.hour.append(now)
        self.running.append(now + duration)
        return True, "", 0.0


ADMITTED = "tenant_id long, event_id long, us long, allowed boolean, reason string, retry_after_s double"


def rate_limit_admit(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``tenant_id, event_id, us, duration_us`` to decisions.

    Only admitted requests count, so each decision needs the ones before it.  A silence of an hour
    (and of the longest request there is) clears a tenant's memory; tenants are therefore cut into spans of
    activity that are decided apart.  Rows of a span stream through a task in time order: the task
    holds one limiter, never the span.
    """
    gap = max(HOUR_US, requests.agg(F.max("duration_us")).first()[0] or 0)
    spans = ranks.spans_by_slot(requests, ["tenant_id"], "us", gap).select("tenant_id", "slot", "span")
    placed = requests.withColumn("slot", ranks.slot_of("us", gap)).join(spans, ["tenant_id", "slot"])
    ordered = placed.repartition("tenant_id", "span").sortWithinPartitions("tenant_id", "span", "us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, Admission()
        for b in batches:
            out = []
            for tenant, span, event, us, duration in zip(b["tenant_id"], b["span"], b["event_id"], b["us"], b["duration_us"]):
                if (tenant, span) != current:
                    current, limiter = (tenant, span), Admission()
                out.append((tenant, event, us, *limiter.decide(us, duration, limits)))
            yield pd.DataFrame(out, columns=["tenant_id", "event_id", "us", "allowed", "reason", "retry_after_s"])

    return ordered.select("tenant_id", "span", "event_id", "us", "duration_us").mapInPandas(run, ADMITTED)


def trailing_counts(events: DataFrame, spans_us: dict[str, int], key: str = "tenant_id") -> DataFrame:
    """For each request, how many of its tenant lie in the trailing spans (itself included).

    Equal times are counted first.  A tenant is cut into clock slots as long as the span; a slot sees its own rows and
    those of the slot before, so no task holds more than two slots of one tenant.  All of the slot before count from the
    slot's first moment on and are taken off one by one as they grow too old: a running sum, linear however
    dense the rows are, where a sliding frame would be added up anew for each row.
    """
    out = events
    for name, span in spans_us.items():
        times = events.groupBy(key, "us").agg(F.count(F.lit(1)).alias("c")).withColumn("slot", F.floor(F.col("us") / span))
        after, c = F.col("slot") + 1, F.col("c")

        def step(slot: Column, us: Column, c: Column, own: bool) -> Column:
            return F.struct(slot.alias("slot"), us.alias("us"), c.alias("c"), F.lit(own).alias("own"))

        steps = F.array(step(F.col("slot"), F.col("us"), c, True), step(after, after * span, c, False), step(after, F.col("us") + span, -c, False))
        moved = times.select(key, F.explode(steps).alias("s")).groupBy(key, "s.slot", "s.us").agg(F.sum("s.c").alias("c"), F.bool_or("s.own").alias("own"))
        w = Window.partitionBy(key, "slot").orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = moved.withColumn(name, F.sum("c").over(w)).where("own").select(key, "us", name)
        out = out.join(counted, [key, "us"])
    return out


def sessions(events: DataFrame, gap_us: int = 30 * MINUTE_US, key: str = "user_id") -> DataFrame:
    """Spans of activity closed by ``gap_us`` of silence: same rule as ``session_window``."""
    return ranks.runs_by_gap(events, [key], "us", gap_us)


def running_requests(requests: DataFrame) -> DataFrame:
    """``tenant_id, us, concurrent``: how many of a tenant's requests run at each time at which one begins.

    A sweep: +1 where a request begins, -1 where it ends, added up in time order.  A request that ends at a time
    does not run at it.  Equal times are summed first and a tenant's times are cut into ranges, so no tenant is one task.
    """
    begins = requests.select("tenant_id", "us", F.lit(1).alias("d"))
    ends = requests.select("tenant_id", (F.col("us") + F.col("duration_us")).alias("us"), F.lit(-1).alias("d"))
    steps = begins.unionByName(ends).groupBy("tenant_id", "us").agg(F.sum("d").alias("d"), F.max("d").alias("most"))
    swept = ranks.ordered_prefix(steps, ["tenant_id"], F.col("us"), F.col("us"), running={"concurrent": "d"})
    return swept.where("most > 0").select("tenant_id", "us", "concurrent")


def rate_status(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``tenant_id, event_id, us, duration_us`` with what the limiter would report at that moment.

    Requests of the last minute and hour (itself included), what is left of both limits, and the requests that run.
    """
    counted = trailing_counts(requests, {"last_minute": MINUTE_US, "last_hour": HOUR_US}).join(running_requests(requests), ["tenant_id", "us"])
    left = {"minute": limits.per_minute, "hour": limits.per_hour}
    return counted.withColumns({
        **{f"remaining_{span}": F.greatest(F.lit(0), F.lit(n) - F.col(f"last_{span}")) for span, n in left.items()},
        "at_burst": F.col("concurrent") >= limits.concurrent})


def spread() -> list[Column]:
    """``n, mean, sd`` of rows in parts with ``n``, sum ``s``, ``m2`` about their own means, and ``q`` = s*s/n, all added up.

    Deviations inside the parts are never differences of large sums.
    """
    n = F.col("n")
    m2 = F.col("m2") + F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0))
    return [n, (F.col("s") / n).alias("mean"), F.sqrt(m2 / F.when(n > 1, n - 1)).alias("sd")]


def trailing_stats(log: DataFrame, value: str, hours: int = 24) -> DataFrame:
    """Per hour start: count, mean and sample deviation of the ``hours`` full hours before it.

    Hourly moments are added up; only they, not the rows, are repeated for the hours they feed.
    """
    hour = F.floor(F.col("us") / HOUR_US)
    x = F.col(value)
    moments = log.groupBy(hour.alias("h")).agg(F.count(x).alias("n"), F.sum(x).alias("s"), (F.var_pop(x) * F.count(x)).alias("m2"))
    fed = moments.select(F.explode(F.sequence(F.col("h") + 1, F.col("h") + hours)).alias("hour"), "n", "s", "m2", (F.col("s") * F.col("s") / F.col("n")).alias("q"))
    return fed.groupBy("hour").agg(*[F.sum(c).alias(c) for c in ("n", "s", "m2", "q")]).select("hour", *spread())


def spikes(rows: DataFrame, value: str) -> DataFrame:
    """Rows above ``mean + 2 sd`` of at least three others, with their ``severity``."""
    over = (F.col("n") >= 3) & (F.col("sd") > 0) & (F.col(value) > F.col("mean") + 2 * F.col("sd"))
    return rows.where(over).withColumn("severity", F.when(F.col(value) > F.col("mean") + 3 * F.col("sd"), "critical").otherwise("warning"))


def trailing_spikes(log: DataFrame, stats: DataFrame, value: str) -> DataFrame:
    """Rows above mean + 2 deviations of the day before their hour (at least three rows there)."""
    return spikes(log.withColumn("hour", F.floor(F.col("us") / HOUR_US)).join(stats, "hour"), value)


def running_quota(usage: DataFrame) -> DataFrame:
    """Tokens each tenant has used so far that day, in ``(us, event_id)`` order."""
    return ranks.ordered_prefix(usage, ["tenant_id", "date"], F.col("us"), F.col("event_id"), running={"used": "tokens"})
