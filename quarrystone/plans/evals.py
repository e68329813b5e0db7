"""Answer metrics, gates, runs and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..operators import evaluation as E
from ..sources.tables import table
from .inputs import ANSWERS, REQ, answers, choose, requests, sql_list
from .questions import set_sql, words_sql
from .registry import query

WA = "WITH " + ANSWERS
_BI = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
BASE = WA + f""", b1 AS (SELECT *, {words_sql('answer')} AS aw, {words_sql('truth')} AS tw, {set_sql('query')} AS q, {set_sql("array_to_string(contexts, ' ')")} AS cx FROM qa),
b2 AS (SELECT *, {_BI.format('aw')} AS ab, {_BI.format('tw')} AS tb, list_distinct(tw) AS ts FROM b1)"""


def _lap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


RAGAS = BASE + f""", rg AS (SELECT qid, CASE WHEN len(tb) > 0 THEN least(1, 0.6 * {_lap('ab', 'tb')} / len(tb) + 0.4 * {_lap('aw', 'ts')} / len(ts)) ELSE 0.5 END AS faithfulness,
  CASE WHEN len(q) > 0 THEN least(1, {_lap('q', 'aw')} / len(q) * least(1, len(aw) / 10)) ELSE 0.5 END AS answer_relevancy,
  CASE WHEN len(contexts) = 0 THEN 0 WHEN len(q) > 0 THEN {_lap('q', 'cx')} / len(q) ELSE 0.5 END AS context_precision,
  CASE WHEN len(contexts) > 0 AND len(ts) > 0 THEN {_lap('ts', 'cx')} / len(ts) ELSE 0 END AS context_recall FROM b2)"""


def _rounded(cols, places=6):
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


@query("ragas_heuristic", RAGAS + f" SELECT qid, {_rounded(E.METRICS)} FROM rg")
def ragas_heuristic(spark, d):
    out = E.ragas_heuristic(answers(spark, d).withColumnRenamed("query", "question"))
    return out.select("qid", *[T.rounded(F.col(m), 6).alias(m) for m in E.METRICS])


_OVERALL = "avg(faithfulness) * 0.3 + avg(answer_relevancy) * 0.3 + avg(context_precision) * 0.2 + avg(context_recall) * 0.2"


@query("ragas_aggregate", RAGAS + f" SELECT count(*) AS num_samples, {', '.join(f'round(avg({m}), 4) AS {m}' for m in E.METRICS)}, round({_OVERALL}, 4) AS overall_score FROM rg")
def ragas_aggregate(spark, d):
    return E.ragas_aggregate(E.ragas_heuristic(answers(spark, d).withColumnRenamed("query", "question")))


def _jac(a: str, b: str) -> str:
    return f"{_lap(a, b)} / nullif(len(list_distinct(list_concat({a}, {b}))), 0)"


HEUR = BASE + f""", dl AS (SELECT *, list_transform(contexts, lambda t: {set_sql('t')}) AS ds, CASE WHEN conv_id % 4 = 1 THEN CAST([] AS VARCHAR[][]) ELSE [list_distinct(tw)] END AS es FROM b2),
hm AS (SELECT qid, CASE WHEN len(es) = 0 OR len(ds) = 0 THEN 0.5 ELSE len(list_filter(ds, lambda x: coalesce({_jac('x', 'es[1]')}, 0) > 0.3)) / len(ds) END AS retrieval_precision,
  CASE WHEN len(es) = 0 THEN 0.5 ELSE len(list_filter(es, lambda y: len(list_filter(ds, lambda x: coalesce({_jac('x', 'y')}, 0) > 0.3)) > 0)) / len(es) END AS retrieval_recall,
  CASE WHEN len(ds) = 0 THEN 0 ELSE least(1, list_sum(list_transform(ds, lambda x: {_lap('q', 'x')} / len(q))) / len(ds)) END AS context_relevance,
  CASE WHEN len(ds) = 0 OR answer = '' THEN 0.5 ELSE 1 - (len(list_distinct(aw)) - {_lap('list_distinct(aw)', 'cx')}) / len(list_distinct(aw)) END AS answer_faithfulness,
  CASE WHEN answer = '' THEN 0 WHEN len(q) > 0 THEN {_lap('q', 'aw')} / len(q) ELSE 0.5 END AS answer_relevance FROM dl)"""
HM = ("retrieval_precision", "retrieval_recall", "context_relevance", "answer_faithfulness", "answer_relevance")


def _heuristics(spark, d):
    a = answers(spark, d)
    expected = F.when(F.col("conv_id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("truth"))
    out = E.heuristic_metrics(a.select("qid", "query", "answer", F.col("contexts").alias("retrieved"), expected.alias("expected")))
    return out.select("qid", *[T.rounded(F.col(m), 6).alias(m) for m in (*HM, "overall_score")])


HEUR_R = HEUR + f", hr AS (SELECT qid, {_rounded(HM)}, round(({' + '.join(HM)}) / 5, 6) AS overall_score FROM hm)"


@query("heuristic_metrics", HEUR_R + " SELECT * FROM hr")
def heuristic_metrics(spark, d):
    return _heuristics(spark, d)


@query("ci_gates", HEUR_R + ", ug AS (SELECT qid AS report, metric, value FROM (UNPIVOT hr ON " + ", ".join((*HM, "overall_score")) + " INTO NAME metric VALUE value)), th AS (SELECT * FROM (VALUES "
       + ", ".join(f"('{m}', {t})" for m, t in fixed.CI_THRESHOLDS.items()) + """) t(metric, threshold))
SELECT report, count(*) AS gates, count(*) FILTER (value < threshold) AS failed, bool_and(value >= threshold) AS passed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (value < threshold), '') AS failed_metrics FROM ug JOIN th USING (metric) GROUP BY report""")
def ci_gates(spark, d):
    values = E.unpivot(_heuristics(spark, d).withColumnRenamed("qid", "report"), ["report"], [*HM, "overall_score"])
    return E.ci_gates(values, fixed.CI_THRESHOLDS)


@query("eval_averages", HEUR_R + ", nw AS (SELECT * FROM hr ORDER BY qid DESC LIMIT 10) SELECT metric, round(avg(value), 6) AS avg_value FROM (UNPIVOT nw ON " + ", ".join((*HM, "overall_score")) + " INTO NAME metric VALUE value) GROUP BY metric")
def eval_averages(spark, d):
    h = _heuristics(spark, d).withColumn("report", F.col("qid")).withColumn("ts", F.col("qid"))
    return E.eval_averages(h, [*HM, "overall_score"])


_NUM = r"list_distinct(regexp_extract_all({}, '{}'))"
SCORES = BASE + f""", nx AS (SELECT *, {_NUM.format('lower(answer)', r'\d+\.?\d*')} AS an, {_NUM.format('lower(truth)', r'\d+\.?\d*')} AS en, {_NUM.format('answer', r'\d+\.?\d+')} AS hn, {_NUM.format('context', r'\d+\.?\d+')} AS cn FROM b2),
sc AS (SELECT qid, {_lap('q', 'aw')} / len(q) AS relevance, CASE WHEN len(en) = 0 THEN CASE WHEN lower(answer) = lower(truth) THEN 1 ELSE 0.5 END ELSE {_lap('an', 'en')} / len(en) END AS accuracy,
  {_lap('ts', 'aw')} / len(ts) AS completeness, len(hn) > 0 AND len(cn) > 0 AND len(hn) - {_lap('hn', 'cn')} > len(hn) * 0.5 AS hallucination FROM nx),
so AS (SELECT *, (relevance + accuracy + completeness) / 3 AS overall FROM sc)"""


def _scored(spark, d):
    return E.answer_scores(answers(spark, d).withColumnRenamed("truth", "expected"))


@query("answer_scores", SCORES + f" SELECT qid, {_rounded(('relevance', 'accuracy', 'completeness', 'overall'))}, hallucination FROM so")
def answer_scores(spark, d):
    return _scored(spark, d).select("qid", *[T.rounded(F.col(c), 6).alias(c) for c in ("relevance", "accuracy", "completeness", "overall")], "hallucination")


@query("answer_summary", SCORES + " SELECT count(*) AS total_queries, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in ("relevance", "accuracy", "completeness", "overall")) + ", round(avg(CAST(hallucination AS INT)), 6) AS hallucination_rate FROM so")
def answer_summary(spark, d):
    return E.answer_summary(_scored(spark, d))


HARNESS = BASE + f""", hs AS (SELECT qid, conv_id, turn, answer, CASE WHEN len(tb) > 0 THEN {_lap('ab', 'tb')} / len(tb) ELSE 0.5 END AS faithfulness, CAST(0.5 AS DOUBLE) AS answer_relevancy,
  CASE WHEN len(contexts) = 0 THEN 0 WHEN len(q) > 0 THEN {_lap('q', 'cx')} / len(q) ELSE 0.5 END AS context_precision, CASE WHEN len(contexts) > 0 AND len(ts) > 0 THEN {_lap('ts', 'cx')} / len(ts) ELSE 0 END AS context_recall FROM b2),
ho AS (SELECT *, round(faithfulness * 0.3 + answer_relevancy * 0.3 + context_precision * 0.2 + context_recall * 0.2, 9) AS overall_score FROM hs),
he AS (SELECT *, 'c' || CAST(conv_id % 5 AS VARCHAR) AS category, conv_id % 2 AS run, qid % 97 * CAST(10.5 AS DOUBLE) AS latency_ms, qid % 13 / 1000 AS cost_usd,
  CASE WHEN qid % 11 = 0 THEN 'Timeout after 3 s' WHEN qid % 11 = 5 THEN 'boom' END AS error, CASE WHEN qid % 17 = 0 THEN ' ' ELSE answer END AS said FROM ho),
hb AS (SELECT *, CASE WHEN error LIKE 'Timeout%' THEN 'timeout' WHEN error IS NOT NULL THEN 'wrong_answer' WHEN said = ' ' THEN 'no_answer' WHEN overall_score >= 0.7 THEN 'correct' WHEN overall_score >= 0.4 THEN 'partial' ELSE 'wrong_answer' END AS bucket FROM he)"""


def _entries(spark, d):
    h = E.harness_score(answers(spark, d))
    q, c = F.col("qid"), F.col("conv_id")
    error = F.when(q % 11 == 0, "Timeout after 3 s").when(q % 11 == 5, "boom")
    said = F.when(q % 17 == 0, " ").otherwise(F.col("answer"))
    return h.select(
        "qid", *E.METRICS, "overall_score", F.concat(F.lit("c"), (c % 5).cast("string")).alias("category"), (c % 2).alias("run"),
        (q % 97 * 10.5).alias("latency_ms"), (q % 13 / 1000).alias("cost_usd"), E.failure_bucket(error, said, F.col("overall_score")).alias("bucket"))


@query("harness_score", HARNESS + f" SELECT qid, {_rounded((*E.METRICS, 'overall_score'))} FROM hb")
def harness_score(spark, d):
    return _entries(spark, d).select("qid", *[T.rounded(F.col(m), 6).alias(m) for m in (*E.METRICS, "overall_score")])


@query("failure_bucket", HARNESS + " SELECT qid, bucket FROM hb")
def failure_bucket(spark, d):
    return _entries(spark, d).select("qid", "bucket")


def _report_sql(keys: str = "") -> str:
    return f"""SELECT {keys + ',' if keys else ''} count(*) AS total_entries, {', '.join(f'round(avg({m}), 4) AS {m}' for m in E.REPORT_METRICS)}, round(avg(cost_usd), 6) AS cost_per_answer_usd, round(sum(cost_usd), 6) AS total_cost_usd,
  round(quantile_cont(latency_ms, 0.5), 2) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS latency_p95_ms FROM hb {'GROUP BY ' + keys if keys else ''}"""


@query("harness_report", HARNESS + " " + _report_sql())
def harness_report(spark, d):
    return E.harness_report(_entries(spark, d), [])


@query("category_breakdown", HARNESS + " " + " UNION ALL ".join(f"""SELECT '{k}' AS grouping, {k} AS name, count(*) AS n, round(avg(overall_score), 4) AS avg_score, round(avg(faithfulness), 4) AS avg_faithfulness,
  round(avg(latency_ms), 2) AS avg_latency_ms, round(avg(cost_usd), 6) AS avg_cost_usd FROM hb GROUP BY {k}""" for k in ("category", "bucket")))
def category_breakdown(spark, d):
    return E.category_breakdown(_entries(spark, d))


_CMP = (*E.REPORT_METRICS, "latency_p50_ms", "cost_per_answer_usd")
COMPARED = HARNESS + ", rr AS (" + _report_sql("run") + f"), ru AS (SELECT run, metric, value FROM (UNPIVOT (SELECT run, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CMP)} FROM rr) ON {', '.join(_CMP)} INTO NAME metric VALUE value)),"  \
    + f""" bc AS (SELECT c.metric, c.value AS current, b.value AS baseline, round(c.value - b.value, 6) AS delta, c.metric IN ({', '.join(repr(m) for m in E.REPORT_METRICS)}) AND b.value > 0 AND (b.value - c.value) / b.value > 0.1 AS regressed
  FROM ru c JOIN ru b ON c.metric = b.metric AND c.run = 1 AND b.run = 0)"""


def _two_runs(spark, d):
    report = E.harness_report(_entries(spark, d), ["run"])
    return report.where("run = 1"), report.where("run = 0")


@query("baseline_compare", COMPARED + " SELECT * FROM bc")
def baseline_compare(spark, d):
    return E.baseline_compare(*_two_runs(spark, d))


@query("harness_gates", COMPARED + """, g AS (SELECT overall_score >= 0.7 AS overall_score, faithfulness >= 0.5 AS faithfulness, (SELECT NOT bool_or(regressed) FROM bc) AS no_major_regression FROM rr WHERE run = 1)
SELECT *, overall_score AND faithfulness AND no_major_regression AS all_passed FROM g""")
def harness_gates(spark, d):
    current, baseline = _two_runs(spark, d)
    return E.harness_gates(current, E.baseline_compare(current, baseline))


CI = BASE + f""", cr AS (SELECT conv_id % 2 AS run, CASE WHEN len(aw) = 0 THEN 0 ELSE {_lap('ts', 'aw')} / len(ts) END AS score, qid % 97 * (1 + conv_id % 2) AS latency_ms, qid % 13 / 1000 AS cost_usd FROM b2),
cs AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM cr),
cm AS (SELECT run, count(*) AS total_queries, round(avg(round(score, 4)), 4) AS overall_score, round(sum(cost_usd), 6) AS total_cost, round(CAST(max(CASE WHEN i = n // 2 THEN latency_ms END) AS DOUBLE), 2) AS latency_p50,
  round(CAST(max(CASE WHEN i = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN latency_ms END) AS DOUBLE), 2) AS latency_p95 FROM cs GROUP BY run)"""


def _ci_results(spark, d):
    q, c = F.col("qid"), F.col("conv_id")
    return answers(spark, d).select(
        (c % 2).alias("run"), E.word_recall(F.col("truth"), F.col("answer")).alias("score"), (q % 97 * (1 + c % 2)).alias("latency_ms"), (q % 13 / 1000).alias("cost_usd"))


@query("ci_report", CI + " SELECT * FROM cm")
def ci_report(spark, d):
    return E.ci_summary(_ci_results(spark, d), ["run"])


@query("ci_regression", CI + """, f AS (SELECT b.overall_score > 0 AND (b.overall_score - c.overall_score) / b.overall_score > 0.1 AS score_regressed, c.latency_p50 > b.latency_p50 * 1.5 AS latency_regressed, c.total_cost > b.total_cost * 2 AS cost_regressed
  FROM cm c JOIN cm b ON c.run = 1 AND b.run = 0) SELECT *, score_regressed OR latency_regressed OR cost_regressed AS regressed FROM f""")
def ci_regression(spark, d):
    s = E.ci_summary(_ci_results(spark, d), ["run"])
    return E.ci_regression(s.where("run = 1"), s.where("run = 0"))


# --- runs -------------------------------------------------------------------------------------

RUNS = """res AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'P' THEN 'partial' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'no_answer' ELSE 'wrong_answer' END END AS bucket FROM orders),
runs AS (SELECT DISTINCT run_id, CAST(replace(run_id, '-', '') AS BIGINT) AS seq, CASE WHEN right(run_id, 1) IN ('5', '9') THEN 'failed' ELSE 'completed' END AS status FROM res)"""


def _results(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), k,
        F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "P", "partial").when(k % 3 == 0, "no_answer").otherwise("wrong_answer").alias("bucket"))


def _runs(spark, d):
    return _results(spark, d).select("run_id").distinct().select(
        "run_id", F.regexp_replace("run_id", "-", "").cast("bigint").alias("seq"), F.when(F.right("run_id", F.lit(1)).isin("5", "9"), "failed").otherwise("completed").alias("status"))


@query("eval_store", "WITH " + RUNS + ", l AS (SELECT * FROM runs WHERE status = 'completed' ORDER BY seq DESC LIMIT 1) SELECT l.run_id, seq, status, count(*) AS results FROM l JOIN res USING (run_id) GROUP BY ALL")
def eval_store(spark, d):
    from ..sources import logs

    store = logs.EvalStore(spark)
    store.create_runs(_runs(spark, d).withColumn("status", F.lit("running")))
    store.save_results(_results(spark, d))
    store.set_status(_runs(spark, d).select("run_id", "status"))
    base = E.latest_completed(store.runs())
    counts = store.results().groupBy("run_id").agg(F.count(F.lit(1)).alias("results"))
    return base.join(counts, "run_id").select("run_id", "seq", "status", "results")


@query("failure_analysis", "WITH " + RUNS + """, l AS (SELECT run_id FROM runs WHERE status = 'completed' ORDER BY seq DESC LIMIT 1), o AS (SELECT * FROM res JOIN l USING (run_id))
SELECT run_id, bucket, count(*) AS n, (SELECT count(*) FROM o) AS total_queries, round(count(*) / (SELECT count(*) FROM o) * 100, 2) AS share FROM o WHERE bucket <> 'correct' GROUP BY run_id, bucket""")
def failure_analysis(spark, d):
    return E.failure_analysis(_runs(spark, d), _results(spark, d))


@query("failure_trends", "WITH " + RUNS + """, r AS (SELECT run_id, seq, count(*) AS total_queries, count(*) FILTER (bucket <> 'correct') AS failures, round(count(*) FILTER (bucket <> 'correct') / count(*) * 100, 2) AS failure_rate FROM runs JOIN res USING (run_id) WHERE status = 'completed' GROUP BY run_id, seq),
p AS (SELECT *, failure_rate - lag(failure_rate) OVER (ORDER BY seq) AS delta FROM r) SELECT run_id, failure_rate, round(delta, 2) AS delta, delta < 0 AS improved, total_queries, failures FROM p WHERE delta IS NOT NULL""")
def failure_trends(spark, d):
    return E.failure_trends(_runs(spark, d), _results(spark, d))


@query("prompt_regression", """WITH m AS (SELECT 'p' || CAST(user_id % 3 AS VARCHAR) AS prompt, 'v' || CAST(user_id % 12 AS VARCHAR) AS version, round(avg(least(1, value / 100)), 4) AS avg_score, count(*) AS num_queries FROM events GROUP BY ALL),
l AS (SELECT *, lag(avg_score) OVER w AS p, lag(version) OVER w AS prev_version FROM m WINDOW w AS (PARTITION BY prompt ORDER BY version))
SELECT prompt, version, avg_score, num_queries, prev_version, round(p - avg_score, 4) AS score_drop, coalesce(round(p - avg_score, 4) > 0.05, false) AS regressed FROM l""")
def prompt_regression(spark, d):
    e = table(spark, d, "events")
    return E.prompt_regression(e.select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("prompt"), F.concat(F.lit("v"), (F.col("user_id") % 12).cast("string")).alias("version"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score")))


@query("online_sample", "WITH " + REQ + """, s AS (SELECT *, tokens_in / 100 AS faithfulness, least(1, cost_usd * 10) AS overall_score, tokens_in % 4 > 0 AS evaluated FROM req WHERE CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) / 4294967296 < 0.05),
m AS (SELECT date, string_agg(model || '=' || CAST(n AS VARCHAR), ',' ORDER BY model || '=' || CAST(n AS VARCHAR)) AS models FROM (SELECT date, model, count(*) AS n FROM s WHERE evaluated GROUP BY ALL) GROUP BY date)
SELECT date, count(*) AS total_samples, count(*) FILTER (evaluated) AS evaluated, """ + ", ".join(f"round(round(coalesce(avg({c}) FILTER (evaluated), 0), 9), 4) AS avg_{c}" for c in ("faithfulness", "overall_score", "latency_ms"))
       + ", coalesce(max(models), '') AS models FROM s LEFT JOIN m USING (date) GROUP BY date")
def online_sample(spark, d):
    r = requests(spark, d).withColumn("faithfulness", F.col("tokens_in") / 100).withColumn("overall_score", F.least(F.lit(1.0), F.col("cost_usd") * 10)).withColumn("evaluated", F.col("tokens_in") % 4 > 0)
    return E.daily_stats(E.online_sample(r, "event_id"))


@query("golden_filter", f"""WITH g AS (SELECT item_id % 30 AS id, item_id AS seq, ({sql_list(fixed.TICKERS)})[item_id % 7 + 1] AS company, (['factual', 'comparison'])[item_id % 2 + 1] AS category, text FROM benchmark)
SELECT id, count(*) AS copies, min(seq) AS seq, arg_min(text, seq) AS text FROM g WHERE company = 'AMZN' AND category = 'factual' GROUP BY id""")
def golden_filter(spark, d):
    i = F.col("item_id")
    golden = table(spark, d, "benchmark").select((i % 30).alias("id"), i.alias("seq"), choose(i % 7, fixed.TICKERS).alias("company"), choose(i % 2, ("factual", "comparison")).alias("category"), "text")
    return E.golden_filter(golden, "amzn", "factual").select("id", "copies", "seq", "text")
