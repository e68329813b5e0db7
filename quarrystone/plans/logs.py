"""Log reports: cost, latency, routing, tenants, audit, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, usage
from ..sources.tables import table
from .inputs import LARGE_MODEL, PRICES, REQ, prices, requests
from .registry import query

W = "WITH " + REQ


@query("cost_summary", W + """
SELECT coalesce(model, 'ALL') AS model, count(*) AS queries, round(sum(cost_usd), 6) AS total_cost,
  round(avg(cost_usd), 6) AS avg_cost, round(avg(latency_ms), 1) AS avg_latency_ms
FROM req GROUP BY ROLLUP (model)""")
def cost_summary(spark, d):
    return usage.cost_summary(requests(spark, d))


@query("budget_check", W + """, r AS (SELECT avg(cost_usd) AS a FROM (SELECT cost_usd FROM req ORDER BY us DESC, event_id DESC LIMIT 10))
SELECT CAST(0.05 AS DOUBLE) AS budget_per_query, round(a, 6) AS recent_avg_cost, a <= 0.05 AS under_budget, round(CAST(0.05 AS DOUBLE) - a, 6) AS headroom FROM r""")
def budget_check(spark, d):
    return usage.budget_check(requests(spark, d))


@query("model_comparison", W + """, s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS i,
  count(*) OVER (PARTITION BY model) AS n FROM req)
SELECT model, count(*) AS query_count, round(sum(cost_usd), 6) AS total_cost, round(avg(cost_usd), 6) AS avg_cost,
  round(min(cost_usd), 6) AS min_cost, round(max(cost_usd), 6) AS max_cost, round(avg(latency_ms), 1) AS avg_latency_ms,
  round(max(CASE WHEN i = n // 2 THEN latency_ms END), 1) AS p50_latency_ms,
  round(max(CASE WHEN i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) THEN latency_ms END), 1) AS p95_latency_ms
FROM s GROUP BY model""")
def model_comparison(spark, d):
    return usage.model_comparison(requests(spark, d))


@query("routing_breakdown", W + """
SELECT complexity, count(*) AS queries, round(avg(cost_usd), 6) AS avg_cost, round(sum(cost_usd), 6) AS total_cost,
  round(avg(latency_ms), 1) AS avg_latency_ms, round(count(*) / (SELECT count(*) FROM req) * 100, 1) AS percentage
FROM req GROUP BY complexity""")
def routing_breakdown(spark, d):
    return usage.routing_breakdown(requests(spark, d))


@query("routing_efficiency", W + """, s AS (SELECT count(*) FILTER (complexity = 'simple') AS ns, count(*) FILTER (complexity = 'complex') AS nc,
  count(*) AS n, avg(cost_usd) FILTER (complexity = 'simple') AS s, avg(cost_usd) FILTER (complexity = 'complex') AS c FROM req)
SELECT ns AS simple_queries_routed, nc AS complex_queries_routed, round(greatest(0, ns * (c - s)), 6) AS estimated_savings_usd,
  round(ns * (c - s) / (n * c) * 100, 1) AS savings_percentage FROM s""")
def routing_efficiency(spark, d):
    return usage.routing_efficiency(requests(spark, d))


@query("cost_trend", W + """
SELECT date, round(sum(cost_usd), 6) AS cost, count(*) AS queries, count(DISTINCT model) AS models_used
FROM req GROUP BY date ORDER BY date DESC LIMIT 7""")
def cost_trend(spark, d):
    return usage.cost_trend(requests(spark, d))


@query("cost_per_token", W + """
SELECT coalesce(model, 'ALL') AS model, round(sum(cost_usd), 6) AS total_cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens,
  round(sum(cost_usd) / sum(tokens_in + tokens_out) * 1000, 6) AS cost_per_1k_tokens,
  round(sum(tokens_in + tokens_out) / count(*)) AS avg_tokens_per_query
FROM req GROUP BY ROLLUP (model)""")
def cost_per_token(spark, d):
    return usage.cost_per_token(requests(spark, d))


@query("token_budgets", W + """
SELECT coalesce(model, 'ALL') AS model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, count(*) AS queries,
  round(sum(tokens_in + tokens_out) / count(*), 1) AS avg_tokens_per_query
FROM req GROUP BY ROLLUP (model)""")
def token_budgets(spark, d):
    return usage.token_budgets(requests(spark, d))


@query("cost_breakdown", W + """, h AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:00') AS hour FROM req)
SELECT 'complexity' AS dimension, complexity AS key, round(sum(cost_usd), 6) AS cost, count(*) AS queries FROM h GROUP BY complexity
UNION ALL SELECT 'model', model, round(sum(cost_usd), 6), count(*) FROM h GROUP BY model
UNION ALL SELECT 'hour', hour, round(sum(cost_usd), 6), count(*) FROM h GROUP BY hour""")
def cost_breakdown(spark, d):
    return usage.cost_breakdown(requests(spark, d))


@query("estimate_cost", W + ", " + PRICES + """
SELECT event_id, model, round(coalesce((tokens_in * price_in + tokens_out * price_out) / 1000000, 0), 9) AS estimated_usd
FROM req LEFT JOIN prices USING (model)""")
def estimate_cost(spark, d):
    out = usage.estimate_cost(requests(spark, d), prices(spark))
    return out.select("event_id", "model", F.round("estimated_usd", 9).alias("estimated_usd"))


@query("savings_report", W + ", " + PRICES + f""", s AS (
  SELECT sum(coalesce((tokens_in * p.price_in + tokens_out * p.price_out) / 1e6, 0)) AS a,
    sum((tokens_in * b.price_in + tokens_out * b.price_out) / 1e6) AS h
  FROM req LEFT JOIN prices p USING (model) JOIN prices b ON b.model = '{LARGE_MODEL}')
SELECT round(a, 6) AS actual_cost, round(h, 6) AS large_model_cost, round(h - a, 6) AS total_saved,
  round((h - a) / h * 100, 2) AS routing_efficiency FROM s""")
def savings_report(spark, d):
    return usage.savings_report(requests(spark, d), prices(spark), LARGE_MODEL)


@query("optimization_hints", W + f""", s AS (SELECT count(*) FILTER (complexity = 'simple' AND model = '{LARGE_MODEL}') AS big,
  avg(cost_usd) AS a, count(*) FILTER (latency_ms > 5000) AS slow,
  count(*) FILTER (model = 'view' AND tokens_in < 5) AS hits, count(*) FILTER (model = 'view' AND tokens_in >= 5) AS misses FROM req),
h AS (SELECT 'routing' AS type, 'medium' AS impact, CAST(big AS DOUBLE) AS value FROM s WHERE big > 0
  UNION ALL SELECT 'budget', 'high', round(a, 6) FROM s WHERE a > 0.05
  UNION ALL SELECT 'latency', 'medium', CAST(slow AS DOUBLE) FROM s WHERE slow > 0
  UNION ALL SELECT 'cache', 'low', round(hits / (hits + misses), 6) FROM s WHERE hits / (hits + misses) < 0.1 AND hits + misses > 10)
SELECT * FROM h UNION ALL SELECT 'info', 'none', 0.0 WHERE NOT EXISTS (SELECT * FROM h)""")
def optimization_hints(spark, d):
    log = requests(spark, d)
    views = log.where("model = 'view'")
    cache = views.agg(F.count_if(F.col("tokens_in") < 5).alias("hits"), F.count_if(F.col("tokens_in") >= 5).alias("misses"))
    return usage.optimization_hints(log, cache, LARGE_MODEL)


def _latency_entries(spark, d):
    ms = F.col("latency_ms")
    return requests(spark, d).select(
        "event_id", "us", "ts", ms.alias("total_ms"),
        F.create_map(F.lit("retrieval"), ms * 0.25, F.lit("generation"), ms * 0.5,
                     F.concat(F.lit("tool_"), F.col("model")), ms * 0.125).alias("components"),
    )


@query("latency_stats", W + """, e AS (SELECT * FROM req WHERE us >= (SELECT max(us) FROM req) - 168 * 3600000000),
p AS (SELECT 'overall' AS component, latency_ms AS ms FROM e UNION ALL SELECT 'retrieval', latency_ms * 0.25 FROM e
  UNION ALL SELECT 'generation', latency_ms * 0.5 FROM e UNION ALL SELECT 'tool_' || model, latency_ms * 0.125 FROM e)
SELECT component, count(*) AS n, round(avg(ms), 3) AS avg_ms, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms,
  round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, round(quantile_cont(ms, 0.99), 3) AS p99_ms
FROM p GROUP BY component""")
def latency_stats(spark, d):
    return usage.latency_stats(_latency_entries(spark, d), hours=168)


@query("latency_trend", W + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS bucket, round(avg(latency_ms), 3) AS avg_ms, count(*) AS n
FROM req WHERE us >= (SELECT max(us) FROM req) - 168 * 3600000000 GROUP BY 1""")
def latency_trend(spark, d):
    return usage.latency_trend(requests(spark, d), hours=168)


@query("latency_recent", W + "SELECT event_id, us, query, latency_ms FROM req ORDER BY us DESC, event_id DESC LIMIT 100")
def latency_recent(spark, d):
    return usage.newest_first(requests(spark, d), 100).select("event_id", "us", "query", "latency_ms")


@query("ab_results", W + """, ab AS (SELECT *, CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < '5' THEN 'B' ELSE 'A' END AS variant
  FROM (SELECT event_id, query FROM req UNION ALL SELECT -1 - event_id, 'never answered: ' || query FROM req WHERE event_id % 9 = 0)),
lat AS (SELECT query, arg_max(latency_ms, us * 1000000 + event_id % 1000000) AS ms FROM req GROUP BY query),
v AS (SELECT * FROM (VALUES ('A'), ('B')) t(variant)),
m AS (SELECT v.variant, event_id, ms FROM v LEFT JOIN ab USING (variant) LEFT JOIN lat USING (query))
SELECT variant, count(event_id) AS query_count, round(coalesce(sum(ms), 0) / count(event_id), 3) AS avg_latency_ms,
  round(coalesce(quantile_cont(ms, 0.5), 0), 3) AS p50_latency_ms, round(coalesce(quantile_cont(ms, 0.95), 0), 3) AS p95_latency_ms,
  round(count(event_id) / (SELECT count(*) FROM ab) * 100, 1) AS share_pct
FROM m GROUP BY variant""".replace("us * 1000000 + event_id % 1000000", "{'us': us, 'id': event_id}"))
def ab_results(spark, d):
    log = requests(spark, d)
    # entries whose text has no latency row, so that the unmatched case occurs
    unmatched = log.where("event_id % 9 = 0").select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("never answered: "), "query").alias("query"))
    entries = log.select("event_id", "query").unionByName(unmatched).withColumn(
        "variant", F.when(F.substring(F.md5(F.col("event_id").cast("string")), 1, 1) < "5", "B").otherwise("A"))
    return usage.ab_results(entries, log)


@query("feedback_stats", """SELECT count(*) AS total, count(*) FILTER (quality - toxic > 0) AS positive,
  count(*) FILTER (quality - toxic < 0) AS negative, count(*) FILTER (quality - toxic = 0) AS neutral,
  round((count(*) FILTER (quality - toxic > 0) - count(*) FILTER (quality - toxic < 0)) / count(*), 3) AS avg_score FROM labels""")
def feedback_stats(spark, d):
    return usage.feedback_stats(table(spark, d, "labels").select((F.col("quality") - F.col("toxic")).alias("rating")))


@query("feedback_recent", """SELECT doc_id AS seq, strftime(ts, '%Y-%m-%d') AS date, quality - toxic AS rating
FROM labels JOIN events ON event_id = doc_id ORDER BY date DESC, seq LIMIT 20""")
def feedback_recent(spark, d):
    rated = table(spark, d, "labels").join(
        table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("date")), "doc_id")
    return usage.feedback_recent(rated.select(F.col("doc_id").alias("seq"), "date", (F.col("quality") - F.col("toxic")).alias("rating")))


def _usage(spark, d):
    return requests(spark, d).select(
        F.col("user_id").alias("tenant_id"), "date", "us", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "cost_usd")


@query("tenant_budget", W + """, u AS (SELECT user_id AS tenant_id, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS used FROM req
  WHERE date = (SELECT max(date) FROM req) GROUP BY 1)
SELECT c_custkey AS tenant_id, coalesce(used, 0) AS used, CAST(floor(c_acctbal / 10) AS BIGINT) AS daily_limit,
  greatest(0, CAST(floor(c_acctbal / 10) AS BIGINT) - coalesce(used, 0)) AS remaining,
  greatest(0, CAST(floor(c_acctbal / 10) AS BIGINT) - coalesce(used, 0)) > 0 AS allowed
FROM customer LEFT JOIN u ON tenant_id = c_custkey""")
def tenant_budget(spark, d):
    tenants = table(spark, d, "customer").select(
        F.col("c_custkey").alias("tenant_id"), F.floor(F.col("c_acctbal") / 10).alias("daily_limit"))
    used = _usage(spark, d)
    return usage.tenant_budget(tenants, used, used.select(F.max("date")).scalar())


@query("tenant_usage", W + """
SELECT user_id AS tenant_id, coalesce(date, 'ALL') AS date, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens,
  round(sum(cost_usd), 6) AS cost, count(*) AS queries
FROM req WHERE us > (SELECT max(us) FROM req) - 7 * 86400000000 GROUP BY GROUPING SETS ((user_id, date), (user_id))""")
def tenant_usage(spark, d):
    return usage.tenant_usage(_usage(spark, d))


def _audit(spark, d):
    return requests(spark, d).select(
        "event_id", "us", F.nullif(F.col("user_id"), F.lit(7)).cast("string").alias("actor"), F.col("model").alias("action"),
        F.when(F.col("model") == "error", "failure").otherwise("success").alias("outcome"))


@query("audit_query", W + "SELECT event_id, us, CAST(nullif(user_id, 7) AS VARCHAR) AS actor, model AS action FROM req WHERE model = 'error' ORDER BY us DESC, event_id DESC LIMIT 100")
def audit_query(spark, d):
    return usage.audit_query(_audit(spark, d), action="error").select("event_id", "us", "actor", "action")


@query("audit_summary", W + """, a AS (SELECT coalesce(CAST(nullif(user_id, 7) AS VARCHAR), 'unknown') AS actor, model AS action,
  CASE WHEN model = 'error' THEN 'failure' ELSE 'success' END AS outcome FROM req WHERE us >= (SELECT max(us) FROM req) - 168 * 3600000000)
SELECT 'action' AS dimension, action AS key, count(*) AS n FROM a GROUP BY action UNION ALL SELECT 'outcome', outcome, count(*) FROM a GROUP BY outcome
UNION ALL SELECT 'actor', actor, count(*) FROM a GROUP BY actor UNION ALL SELECT 'total', 'ALL', count(*) FROM a""")
def audit_summary(spark, d):
    return usage.audit_summary(_audit(spark, d), hours=168)


@query("audit_failures", W + """SELECT event_id, us, CAST(nullif(user_id, 7) AS VARCHAR) AS actor FROM req WHERE model = 'error' AND us >= (SELECT max(us) FROM req) - 168 * 3600000000
ORDER BY us DESC, event_id DESC LIMIT 10""")
def audit_failures(spark, d):
    return usage.audit_failures(_audit(spark, d), hours=168).select("event_id", "us", "actor")


@query("load_metrics", W + """
SELECT count(*) AS total_requests, count(*) FILTER (model = 'error') AS errors, round(count(*) FILTER (model = 'error') / count(*) * 100, 2) AS error_rate_pct,
  round(count(*) / ((max(us) - min(us)) / 1e6), 4) AS requests_per_second, round(min(latency_ms), 2) AS min_ms, round(max(latency_ms), 2) AS max_ms,
  round(avg(latency_ms), 2) AS mean_ms, round(stddev_samp(latency_ms), 2) AS stdev_ms, round(sum(cost_usd), 6) AS total_usd,
  round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 2) AS p99_ms
FROM req""")
def load_metrics(spark, d):
    results = requests(spark, d).withColumn("status_code", F.when(F.col("model") == "error", 500).otherwise(200))
    return usage.load_metrics(results)


_SPIKE = "(SELECT avg({v}) + {k} * stddev_samp({v}) FROM req)"


@query("cost_spikes", W + f"""SELECT 'cost_spike' AS type, CASE WHEN cost_usd > {_SPIKE.format(v='cost_usd', k=3)} THEN 'critical' ELSE 'warning' END AS severity,
  event_id, us, round(cost_usd, 6) AS value FROM req WHERE cost_usd > {_SPIKE.format(v='cost_usd', k=2)}""")
def cost_spikes(spark, d):
    return anomaly.cost_spikes(requests(spark, d))


@query("latency_spikes", W + f"""SELECT 'latency_spike' AS type, 'warning' AS severity, event_id, us, round(latency_ms, 6) AS value
FROM req WHERE latency_ms > {_SPIKE.format(v='latency_ms', k=2)}""")
def latency_spikes(spark, d):
    return anomaly.latency_spikes(requests(spark, d))


@query("rapid_queries", W + """, g AS (SELECT us, us - lag(us) OVER (ORDER BY us, event_id) AS gap FROM req)
SELECT 'rapid_queries' AS type, 'info' AS severity, us, round(gap / 1e6, 1) AS value FROM g WHERE gap < 5000000 ORDER BY us LIMIT 1""")
def rapid_queries(spark, d):
    return anomaly.rapid_queries(requests(spark, d))


@query("rapid_queries_per_user", W + """, g AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM req)
SELECT user_id, 'rapid_queries' AS type, 'info' AS severity, min(us) AS us, round(arg_min(gap, us) / 1e6, 1) AS value FROM g WHERE gap < 3600000000 GROUP BY user_id""")
def rapid_queries_per_user(spark, d):
    return anomaly.rapid_queries(requests(spark, d), ["user_id"], gap_us=3_600_000_000)


@query("routing_imbalance", W + f"""SELECT 'routing_imbalance' AS type, 'warning' AS severity, round(count(*) FILTER (model = '{LARGE_MODEL}') / count(*), 6) AS value
FROM req HAVING count(*) >= 5 AND count(*) FILTER (model = '{LARGE_MODEL}') / count(*) > 0.15""")
def routing_imbalance(spark, d):
    return anomaly.routing_imbalance(requests(spark, d), LARGE_MODEL, limit=0.15)


@query("anomaly_report", W + f""", w AS (SELECT * FROM req WHERE us > (SELECT max(us) FROM req) - 168 * 3600000000),
a AS (SELECT 'cost_spike' AS type, CASE WHEN cost_usd > {_SPIKE.format(v='cost_usd', k=3).replace('req', 'w')} THEN 'critical' ELSE 'warning' END AS severity
  FROM w WHERE cost_usd > {_SPIKE.format(v='cost_usd', k=2).replace('req', 'w')}
  UNION ALL SELECT 'latency_spike', 'warning' FROM w WHERE latency_ms > {_SPIKE.format(v='latency_ms', k=2).replace('req', 'w')}
  UNION ALL (SELECT 'rapid_queries', 'info' FROM (SELECT us, us - lag(us) OVER (ORDER BY us, event_id) AS gap FROM w) WHERE gap < 5000000 LIMIT 1)
  UNION ALL SELECT 'routing_imbalance', 'warning' FROM w HAVING count(*) >= 5 AND count(*) FILTER (model = '{LARGE_MODEL}') / count(*) > 0.8)
SELECT type, severity, count(*) AS n FROM a GROUP BY type, severity""")
def anomaly_report(spark, d):
    return anomaly.anomaly_report(requests(spark, d), LARGE_MODEL, window_hours=168)


@query("health", W + """, r AS (SELECT * FROM req ORDER BY us DESC, event_id DESC LIMIT 10),
s AS (SELECT avg(cost_usd) AS c, avg(latency_ms) AS l, count(*) FILTER (latency_ms > 30000 OR cost_usd > 0.1) / count(*) AS e, count(*) AS n FROM r)
SELECT CASE WHEN e > 0.2 THEN 'degraded' WHEN l > 15000 THEN 'slow' ELSE 'healthy' END AS status, round(c, 6) AS avg_cost, round(l, 1) AS avg_latency_ms,
  round(e, 3) AS error_rate, (SELECT count(*) FROM req) AS total_queries, n AS recent_queries FROM s""")
def health(spark, d):
    return anomaly.health(requests(spark, d))
