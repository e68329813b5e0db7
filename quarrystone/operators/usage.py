"""Cost, latency, routing, feedback, tenant and audit reports over request logs.

Log columns: ``event_id, us`` (epoch microseconds)``, date, user_id, query, model, complexity,
tokens_in, tokens_out, cost_usd, latency_ms``.  Log order is ``(us, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..session import materialize
from . import ranks

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def n_rows() -> Column:
    return F.count(F.lit(1))



def r6(c: Column) -> Column:
    return F.round(c, 6)


def newest_first(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of the log (kept per task, then merged)."""
    return df.orderBy(F.desc("us"), F.desc("event_id")).limit(n)


def since(df: DataFrame, span_us: int, strict: bool = False) -> DataFrame:
    """Rows within ``span_us`` of the newest row."""
    cutoff = df.select((F.max("us") - F.lit(span_us)).alias("cutoff")).scalar()
    return df.where(F.col("us") > cutoff if strict else F.col("us") >= cutoff)


def cost_summary(log: DataFrame) -> DataFrame:
    """Per model and for all models (``ALL``)."""
    return log.rollup("model").agg(
        n_rows().alias("queries"), r6(F.sum("cost_usd")).alias("total_cost"), r6(F.avg("cost_usd")).alias("avg_cost"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    ).withColumn("model", F.coalesce("model", F.lit("ALL")))


def budget_check(log: DataFrame, budget: float | None = None, last: int = 10) -> DataFrame:
    budget = budget or fixed.COST_BUDGET
    recent = newest_first(log, last).agg(F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("a"))
    return recent.select(
        F.lit(budget).alias("budget_per_query"), r6(F.col("a")).alias("recent_avg_cost"),
        (F.col("a") <= budget).alias("under_budget"), r6(F.lit(budget) - F.col("a")).alias("headroom"),
    )


def model_comparison(log: DataFrame) -> DataFrame:
    sums = log.groupBy("model").agg(
        n_rows().alias("query_count"), r6(F.sum("cost_usd")).alias("total_cost"), r6(F.avg("cost_usd")).alias("avg_cost"),
        r6(F.min("cost_usd")).alias("min_cost"), r6(F.max("cost_usd")).alias("max_cost"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    )
    q = ranks.exact_quantiles(log, ["model"], "latency_ms", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})
    return sums.join(q, "model").select(
        *sums.columns, F.round("p50", 1).alias("p50_latency_ms"), F.round("p95", 1).alias("p95_latency_ms")
    ).orderBy(F.desc("query_count"), "model")


def routing_breakdown(log: DataFrame) -> DataFrame:
    per = log.groupBy("complexity").agg(
        n_rows().alias("queries"), r6(F.avg("cost_usd")).alias("avg_cost"), r6(F.sum("cost_usd")).alias("total_cost"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    )
    total = log.select(n_rows().alias("n")).scalar()
    return per.withColumn("percentage", F.round(F.col("queries") / total * 100, 1))


def routing_efficiency(log: DataFrame) -> DataFrame:
    def mean(level: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("complexity") == level, F.col("cost_usd"))), F.lit(0.0))

    s = log.agg(
        F.count_if(F.col("complexity") == "simple").alias("simple_queries_routed"),
        F.count_if(F.col("complexity") == "complex").alias("complex_queries_routed"),
        n_rows().alias("n"), mean("simple").alias("s"), mean("complex").alias("c"),
    )
    saving = F.when((F.col("simple_queries_routed") > 0) & (F.col("c") > 0),
                    F.col("simple_queries_routed") * (F.col("c") - F.col("s"))).otherwise(F.lit(0.0))
    return s.select(
        "simple_queries_routed", "complex_queries_routed",
        r6(F.greatest(F.lit(0.0), saving)).alias("estimated_savings_usd"),
        F.round(T.ratio(saving, F.col("n") * F.col("c")) * 100, 1).alias("savings_percentage"),
    )


def cost_trend(log: DataFrame, days: int = 7) -> DataFrame:
    """The last ``days`` days that have rows."""
    daily = log.groupBy("date").agg(
        r6(F.sum("cost_usd")).alias("cost"), n_rows().alias("queries"), F.countDistinct("model").alias("models_used")
    )
    return daily.orderBy(F.desc("date")).limit(days)


def cost_per_token(log: DataFrame) -> DataFrame:
    t = log.rollup("model").agg(
        F.sum("cost_usd").alias("c"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"), n_rows().alias("n")
    )
    return t.select(
        F.coalesce("model", F.lit("ALL")).alias("model"), r6(F.col("c")).alias("total_cost"), "total_tokens",
        r6(T.ratio(F.col("c"), F.col("total_tokens")) * 1000).alias("cost_per_1k_tokens"),
        F.round(F.col("total_tokens") / F.col("n")).alias("avg_tokens_per_query"),
    )


def token_budgets(log: DataFrame) -> DataFrame:
    return log.rollup("model").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"), n_rows().alias("queries"),
        F.round(F.sum(F.col("tokens_in") + F.col("tokens_out")) / n_rows(), 1).alias("avg_tokens_per_query"),
    ).withColumn("model", F.coalesce("model", F.lit("ALL")))


def cost_breakdown(log: DataFrame) -> DataFrame:
    """By complexity, by model and by hour in one pass."""
    hours = log.withColumn("hour", F.date_format("ts", "yyyy-MM-dd'T'HH':00'"))
    g = hours.groupingSets([["complexity"], ["model"], ["hour"]], "complexity", "model", "hour").agg(
        r6(F.sum("cost_usd")).alias("cost"), n_rows().alias("queries"), F.grouping_id().alias("g")
    )
    return g.select(
        F.when(F.col("g") == 3, "complexity").when(F.col("g") == 5, "model").otherwise("hour").alias("dimension"),
        F.coalesce("complexity", "model", "hour").alias("key"), "cost", "queries",
    )


def estimate_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost from token counts; a model without a price costs nothing."""
    return log.join(prices, "model", "left").withColumn(
        "estimated_usd",
        F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000,
                   F.lit(0.0)),
    )


def savings_report(log: DataFrame, prices: DataFrame, large_model: str) -> DataFrame:
    """Cost of the log as routed against the same tokens at the large model's price."""
    per_model = log.groupBy("model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    big = prices.where(F.col("model") == large_model)
    p_in, p_out = big.select("price_in").scalar(), big.select("price_out").scalar()
    priced = per_model.join(prices, "model", "left").select(
        F.coalesce((F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out")) / 1e6, F.lit(0.0)).alias("a"),
        ((F.col("i") * p_in + F.col("o") * p_out) / 1e6).alias("h"),
    ).agg(F.sum("a").alias("a"), F.sum("h").alias("h"))
    return priced.select(
        r6(F.col("a")).alias("actual_cost"), r6(F.col("h")).alias("large_model_cost"),
        r6(F.col("h") - F.col("a")).alias("total_saved"),
        F.round(T.ratio(F.col("h") - F.col("a"), F.col("h")) * 100, 2).alias("routing_efficiency"),
    )


def optimization_hints(log: DataFrame, cache: DataFrame, large_model: str, budget: float = fixed.COST_BUDGET) -> DataFrame:
    """``cache`` has one row with ``hits`` and ``misses``."""
    hits, misses = cache.select("hits").scalar(), cache.select("misses").scalar()
    s = log.agg(
        n_rows().alias("n"), F.avg("cost_usd").alias("avg"), F.count_if(F.col("latency_ms") > 5000).alias("slow"),
        F.count_if((F.col("complexity") == "simple") & F.contains(F.col("model"), F.lit(large_model))).alias("big"),
    ).select("*", hits.alias("hits"), misses.alias("misses"))

    def hint(kind: str, impact: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(impact).alias("impact"), value.cast("double").alias("value"))

    lookups = F.col("hits") + F.col("misses")
    hints = F.filter(F.array(
        F.when(F.col("big") > 0, hint("routing", "medium", F.col("big"))),
        F.when(F.col("avg") > budget, hint("budget", "high", r6(F.col("avg")))),
        F.when(F.col("slow") > 0, hint("latency", "medium", F.col("slow"))),
        F.when((T.ratio(F.col("hits"), lookups) < 0.1) & (lookups > 10),
               hint("cache", "low", r6(T.ratio(F.col("hits"), lookups)))),
    ), lambda h: h.isNotNull())
    normal = F.array(hint("info", "none", F.lit(0)))
    return s.select(F.explode(F.when(F.size(hints) > 0, hints).otherwise(normal)).alias("h")).select("h.*")


def latency_stats(entries: DataFrame, hours: int = 24) -> DataFrame:
    """``entries(us, total_ms, components map<string,double>)``: per component and ``overall``."""
    recent = since(entries, hours * HOUR_US)
    parts = recent.select(F.explode(
        F.map_concat(F.col("components"), F.create_map(F.lit("overall"), F.col("total_ms")))
    ).alias("component", "ms"))
    sums = parts.groupBy("component").agg(
        n_rows().alias("n"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.round(F.min("ms"), 3).alias("min_ms"),
        F.round(F.max("ms"), 3).alias("max_ms"),
    )
    q = ranks.exact_quantiles(parts, ["component"], "ms", {f"p{p}": ("linear", p / 100) for p in (50, 95, 99)})
    return sums.join(q, "component").select(
        *sums.columns, *[F.round(f"p{p}", 3).alias(f"p{p}_ms") for p in (50, 95, 99)]
    )


def latency_trend(entries: DataFrame, hours: int = 24, bucket: str = "1 hour") -> DataFrame:
    recent = since(entries, hours * HOUR_US)
    return recent.groupBy(F.window("ts", bucket).alias("w")).agg(
        F.round(F.avg("latency_ms"), 3).alias("avg_ms"), n_rows().alias("n")
    ).select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("bucket"), "avg_ms", "n")


def ab_results(entries: DataFrame, latencies: DataFrame) -> DataFrame:
    """Variants A and B; latency comes from the newest latency row of the same query text."""
    newest = latencies.where(F.col("query") != "").groupBy("query").agg(
        F.max_by("latency_ms", F.struct("us", "event_id")).alias("ms")
    )
    # rows sharing a text share its latency: count them first, so that a hot text joins once
    counted = entries.groupBy("variant", "query").agg(n_rows().alias("c"))
    matched = materialize(counted.join(newest, "query", "left"), "matched")
    sums = matched.groupBy("variant").agg(
        F.sum("c").alias("query_count"), F.coalesce(F.sum(F.col("c") * F.col("ms")), F.lit(0.0)).alias("ms_sum")
    )
    q = ranks.exact_quantiles(matched, ["variant"], "ms", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)}, weight="c")
    both = entries.sparkSession.createDataFrame([("A",), ("B",)], "variant string")
    total = entries.select(n_rows().alias("n")).scalar()
    zero = F.lit(0.0)
    count = F.coalesce("query_count", F.lit(0))
    return both.join(sums, "variant", "left").join(q, "variant", "left").select(
        "variant", count.alias("query_count"),
        F.round(F.coalesce(T.ratio(F.col("ms_sum"), F.col("query_count")), zero), 3).alias("avg_latency_ms"),
        F.round(F.coalesce("p50", zero), 3).alias("p50_latency_ms"),
        F.round(F.coalesce("p95", zero), 3).alias("p95_latency_ms"),
        F.round(count / total * 100, 1).alias("share_pct"),
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    s = feedback.agg(
        n_rows().alias("total"), F.count_if(F.col("rating") > 0).alias("positive"),
        F.count_if(F.col("rating") < 0).alias("negative"), F.count_if(F.col("rating") == 0).alias("neutral"),
    )
    return s.withColumn("avg_score", F.round(T.ratio(F.col("positive") - F.col("negative"), F.col("total")), 3))


def feedback_recent(feedback: DataFrame, limit: int = 20) -> DataFrame:
    """Newest day first; rows of one day stay in file order (``seq``)."""
    return feedback.orderBy(F.desc("date"), "seq").limit(limit)


def tenant_budget(tenants: DataFrame, usage: DataFrame, today: Column) -> DataFrame:
    used = usage.where(F.col("date") == today).groupBy("tenant_id").agg(F.sum("tokens").alias("used"))
    joined = tenants.join(used, "tenant_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("daily_limit") - F.col("used"))
    return joined.select("tenant_id", "used", "daily_limit", left.alias("remaining"), (left > 0).alias("allowed"))


def tenant_usage(usage: DataFrame, days: int = 7) -> DataFrame:
    """Per tenant and day, with a total row per tenant (``date`` = ``ALL``)."""
    recent = since(usage, days * DAY_US, strict=True)
    return recent.groupingSets([["tenant_id", "date"], ["tenant_id"]], "tenant_id", "date").agg(
        F.sum("tokens").alias("tokens"), r6(F.sum("cost_usd")).alias("cost"), n_rows().alias("queries")
    ).withColumn("date", F.coalesce("date", F.lit("ALL")))


def audit_query(events: DataFrame, actor: str | None = None, action: str | None = None, limit: int = 100) -> DataFrame:
    if actor:
        events = events.where(F.col("actor") == actor)
    if action:
        events = events.where(F.col("action") == action)
    return newest_first(events, limit)


def audit_summary(events: DataFrame, hours: int = 24) -> DataFrame:
    """Counts by action, outcome and actor in one pass, and the total."""
    recent = since(events, hours * HOUR_US)
    named = recent.select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("action", "outcome", "actor")])
    g = named.groupingSets([["action"], ["outcome"], ["actor"], []], "action", "outcome", "actor").agg(
        n_rows().alias("n"), F.grouping_id().alias("g")
    )
    kind = F.when(F.col("g") == 3, "action").when(F.col("g") == 5, "outcome").when(F.col("g") == 6, "actor").otherwise("total")
    return g.select(kind.alias("dimension"), F.coalesce("action", "outcome", "actor", F.lit("ALL")).alias("key"), "n")


def audit_failures(events: DataFrame, hours: int = 24, limit: int = 10) -> DataFrame:
    return newest_first(since(events, hours * HOUR_US).where(F.col("outcome") == "failure"), limit)


def load_metrics(results: DataFrame) -> DataFrame:
    """``results(status_code, latency_ms, cost_usd, us)`` of a load run."""
    s = results.agg(
        n_rows().alias("total_requests"),
        F.count_if((F.col("status_code") < 200) | (F.col("status_code") >= 300)).alias("errors"),
        ((F.max("us") - F.min("us")) / 1e6).alias("secs"),
        F.round(F.min("latency_ms"), 2).alias("min_ms"), F.round(F.max("latency_ms"), 2).alias("max_ms"),
        F.round(F.avg("latency_ms"), 2).alias("mean_ms"), F.round(F.stddev_samp("latency_ms"), 2).alias("stdev_ms"),
        r6(F.sum("cost_usd")).alias("total_usd"),
    )
    q = ranks.exact_quantiles(results, [], "latency_ms", {f"p{p}": ("linear", p / 100) for p in (50, 95, 99)})
    return s.select(
        "total_requests", "errors", F.round(T.ratio(F.col("errors"), F.col("total_requests")) * 100, 2).alias("error_rate_pct"),
        F.round(T.ratio(F.col("total_requests"), F.col("secs")), 4).alias("requests_per_second"),
        "min_ms", "max_ms", "mean_ms", "stdev_ms", "total_usd",
        *[F.round(q.select(f"p{p}").scalar(), 2).alias(f"p{p}_ms") for p in (50, 95, 99)],
    )
