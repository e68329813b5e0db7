"""Ranking metrics, answer metrics, gates and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import each
from ..session import materialize

GRAM = 4


def contained_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``item_id, doc_id`` where the document holds the whole passage; an empty one is in no document.

    A containing document repeats the inner words of the passage between the same blanks, so a run of
    inner words is an equality key.  A passage of one or two words has none; its first three characters
    are its key.  Only pairs that agree on a key are checked in full.
    """

    def runs(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)])))

    given = passages.select("item_id", F.col("text").alias("passage")).where(F.length("passage") > 0).withColumn("w", F.split("passage", " "))
    # a hash is enough, since what agrees on it is checked in full
    inner = F.least(F.size("w") - 2, F.lit(GRAM))
    key = F.coalesce(*[F.when(inner == n, F.xxhash64(*[F.get("w", F.lit(k + 1)) for k in range(n)])) for n in range(1, GRAM + 1)])
    p = given.where(F.size("w") >= 3).select("item_id", key.alias("run"))
    sizes = sorted(r.n for r in given.where(F.size("w") >= 3).select(inner.alias("n")).distinct().collect())
    # the word list is a column of its own: inside the lambda it must be read, not split again
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    pairs = p.select("item_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")).where(F.lit(False))
    if sizes:
        pairs = each(words, ["doc_id"], F.concat(*[runs(F.col("w"), n) for n in sizes]), "run").join(p, "run").select("item_id", "doc_id")
    short = given.where(F.size("w") < 3).select("item_id", F.left("passage", F.lit(3)).alias("run"))
    if not short.isEmpty():
        letters = docs.select("doc_id", F.split("text", "").alias("w"))
        starts = F.sequence(F.lit(1), F.size("w"))
        heads = F.flatten(F.transform(starts, lambda i: F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.array_join(F.slice("w", i, n), ""))))
        pairs = pairs.unionByName(each(letters, ["doc_id"], F.array_distinct(heads), "run").join(short, "run").select("item_id", "doc_id"))
    # written out so that the planner knows how few there are
    pairs = materialize(pairs.distinct(), "passage-pairs")
    return (
        pairs.join(docs.select("doc_id", "text"), "doc_id").join(given.select("item_id", "passage"), "item_id")
        .where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    )


# --- rankings ------------------------------------------------------------------------------


def relevance_lists(rankings: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: relevance of the retrieved rows in rank order (as long as the ranking), number relevant.

    ``rankings(qid, doc_id, rank)``, ``qrels(qid, doc_id)``.
    """
    judged = rankings.select("qid", "doc_id", "rank").join(qrels.withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left").fillna(0, ["rel"])
    lists = judged.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel"))), lambda s: s["rel"]).alias("rels"))
    n_rel = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return queries.select("qid").join(lists, "qid", "left").join(n_rel, "qid", "left").select(
        "qid", F.coalesce("rels", F.array().cast("array<int>")).alias("rels"), F.coalesce("n_rel", F.lit(0)).alias("n_rel"))


def dcg(rels: Column, k: int) -> Column:
    gains = F.transform(F.slice(rels, 1, k), lambda r, i: r / F.log2(i + 2))
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def ndcg(rels: Column, k: int) -> Column:
    return T.ratio(dcg(rels, k), dcg(F.sort_array(rels, asc=False), k))


def reciprocal_rank(rels: Column) -> Column:
    at = F.array_position(F.transform(rels, lambda r: F.when(r > 0, 1).otherwise(0)), 1)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def hits_at(rels: Column, k: int) -> Column:
    return F.size(F.filter(F.slice(rels, 1, k), lambda r: r > 0))


def recall_at(rels: Column, n_rel: Column, k: int) -> Column:
    return T.ratio(hits_at(rels, k), n_rel)


def precision_at(rels: Column, k: int) -> Column:
    return hits_at(rels, k) / F.lit(k)


def query_metrics(lists: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    rels = F.col("rels")
    return lists.select(
        "qid", F.round(reciprocal_rank(rels), 6).alias("mrr"),
        *[F.round(ndcg(rels, k), 6).alias(f"ndcg_{k}") for k in ks],
        *[F.round(recall_at(rels, F.col("n_rel"), k), 6).alias(f"recall_{k}") for k in ks],
        *[F.round(precision_at(rels, k), 6).alias(f"precision_{k}") for k in ks],
        (hits_at(rels, 10) > 0).cast("double").alias("hit_rate"),
    )


def retrieval_report(lists: DataFrame) -> DataFrame:
    m = query_metrics(lists)
    return m.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in m.columns if c != "qid"])


# --- answers -------------------------------------------------------------------------------


def with_words(rows: DataFrame, query: str) -> DataFrame:
    """Words, sets and bigrams of ``answer``, ``truth``, ``query`` and ``contexts`` as columns: each is computed once and read where it is used.

    An overlap hashes its second side, so the shorter text stands there.
    """
    ws = rows.select(
        "*", T.words(F.col("answer")).alias("_a"), T.words(F.col("truth")).alias("_g"), T.word_set(F.col(query)).alias("_q"),
        T.words(F.array_join("contexts", " ")).alias("_c"), (F.size("contexts") > 0).alias("_has"))
    return ws.select("*", T.bigrams(F.col("_a")).alias("_ab"), T.bigrams(F.col("_g")).alias("_gb"), F.array_distinct("_g").alias("_gs"))


def ragas_heuristic(rows: DataFrame) -> DataFrame:
    """``question, answer, truth, contexts array<string>``: four overlap metrics per row."""
    a, q, ctx, gb, gs = (F.col(c) for c in ("_a", "_q", "_c", "_gb", "_gs"))
    grounded = 0.6 * T.ratio(T.overlap(gb, F.col("_ab")), F.size(gb)) + 0.4 * T.ratio(T.overlap(gs, a), F.size(gs))
    return with_words(rows, "question").select(
        *rows.columns,
        F.when(F.size(gb) > 0, F.least(F.lit(1.0), grounded)).otherwise(0.5).alias("faithfulness"),
        F.when(F.size(q) > 0, F.least(F.lit(1.0), T.ratio(T.overlap(q, a), F.size(q)) * F.least(F.lit(1.0), F.size(a) / 10))).otherwise(0.5).alias("answer_relevancy"),
        F.when(~F.col("_has"), 0.0).when(F.size(q) > 0, T.ratio(T.overlap(ctx, q), F.size(q))).otherwise(0.5).alias("context_precision"),
        F.when(F.col("_has") & (F.size(gs) > 0), T.ratio(T.overlap(ctx, gs), F.size(gs))).otherwise(0.0).alias("context_recall"),
    )


METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
WEIGHTS = (0.3, 0.3, 0.2, 0.2)


def weighted_score(cols=METRICS) -> Column:
    return sum((F.col(c) * w for c, w in zip(cols[1:], WEIGHTS[1:])), F.col(cols[0]) * WEIGHTS[0])


def ragas_aggregate(scored: DataFrame) -> DataFrame:
    means = scored.agg(F.count(F.lit(1)).alias("num_samples"), *[F.avg(m).alias(m) for m in METRICS])
    return means.select("num_samples", *[F.round(m, 4).alias(m) for m in METRICS], F.round(weighted_score(), 4).alias("overall_score"))


def heuristic_metrics(rows: DataFrame) -> DataFrame:
    """``query, answer, retrieved array<string>, expected array<string>``; documents match above Jaccard 0.3."""
    q, a = T.word_set(F.col("query")), T.word_set(F.col("answer"))
    docs = F.transform("retrieved", T.word_set)
    want = F.transform("expected", T.word_set)
    rows = rows.select("*", docs.alias("_d"), want.alias("_e"), q.alias("_q"), a.alias("_a"))

    def matched(side: str, other: str) -> Column:
        return F.size(F.filter(side, lambda x: F.exists(F.col(other), lambda y: T.jaccard(x, y) > 0.3)))

    n_d, n_e = F.size("_d"), F.size("_e")
    context = F.flatten("_d")
    overlap_sum = F.aggregate("_d", F.lit(0.0), lambda s, d: s + T.ratio(T.overlap(F.col("_q"), d), F.size("_q")))
    scored = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.when((n_e == 0) | (n_d == 0), 0.5).otherwise(T.ratio(matched("_d", "_e"), n_d)).alias("retrieval_precision"),
        F.when(n_e == 0, 0.5).otherwise(T.ratio(matched("_e", "_d"), n_e)).alias("retrieval_recall"),
        F.when(n_d == 0, 0.0).otherwise(F.least(F.lit(1.0), T.ratio(overlap_sum, n_d))).alias("context_relevance"),
        F.when((n_d == 0) | (F.col("answer") == ""), 0.5)
        .otherwise(F.greatest(F.lit(0.0), 1 - T.ratio(F.size(F.array_except("_a", context)), F.size("_a")))).alias("answer_faithfulness"),
        F.when(F.col("answer") == "", 0.0).otherwise(T.ratio(T.overlap(F.col("_q"), F.col("_a")), F.size("_q"), 0.5)).alias("answer_relevance"),
        F.lit(1.0).alias("latency"),
    )
    five = ["retrieval_precision", "retrieval_recall", "context_relevance", "answer_faithfulness", "answer_relevance"]
    return scored.withColumn("overall_score", sum((F.col(c) for c in five[1:]), F.col(five[0])) / 5)


def unpivot(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.unpivot(ids, cols, "metric", "value")


def ci_gates(values: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``values(report, metric, value)``: each gated metric, and whether its report passes all gates."""
    limit = F.create_map(*[x for m, t in thresholds.items() for x in (F.lit(m), F.lit(t))])
    gated = values.withColumn("threshold", F.try_element_at(limit, F.col("metric"))).where(F.col("threshold").isNotNull())
    return gated.groupBy("report").agg(
        F.count(F.lit(1)).alias("gates"), F.count_if(F.col("value") < F.col("threshold")).alias("failed"),
        F.bool_and(F.col("value") >= F.col("threshold")).alias("passed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") < F.col("threshold"), F.col("metric")))), ",").alias("failed_metrics"),
    )


def eval_averages(reports: DataFrame, metrics: list[str], window: int = 10) -> DataFrame:
    """Means over the ``window`` newest reports (``ts`` and ``report`` order them)."""
    newest = reports.orderBy(F.desc("ts"), F.desc("report")).limit(window)
    return unpivot(newest, ["report"], metrics).groupBy("metric").agg(F.round(F.avg("value"), 6).alias("avg_value"))


def numbers(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def answer_scores(rows: DataFrame) -> DataFrame:
    """``query, answer, expected, context``: relevance, number accuracy, completeness, hallucination."""
    a, e = F.lower("answer"), F.lower("expected")
    en, an = numbers(e, r"\d+\.?\d*"), numbers(a, r"\d+\.?\d*")
    words_a, words_e, words_q = T.word_set(a), T.word_set(e), T.word_set(F.col("query"))
    hn, cn = numbers(F.col("answer"), r"\d+\.?\d+"), numbers(F.col("context"), r"\d+\.?\d+")
    scored = rows.select(
        "*",
        T.ratio(T.overlap(words_q, words_a), F.size(words_q)).alias("relevance"),
        F.when(F.size(en) == 0, F.when(a == e, 1.0).otherwise(0.5)).otherwise(T.ratio(T.overlap(an, en), F.size(en))).alias("accuracy"),
        T.ratio(T.overlap(words_e, words_a), F.size(words_e)).alias("completeness"),
        F.when((F.size(hn) > 0) & (F.size(cn) > 0), F.size(F.array_except(hn, cn)) > F.size(hn) * 0.5).otherwise(F.lit(False)).alias("hallucination"),
    )
    return scored.withColumn("overall", (F.col("relevance") + F.col("accuracy") + F.col("completeness")) / 3)


def answer_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_queries"),
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("relevance", "accuracy", "completeness", "overall")],
        F.round(F.avg(F.col("hallucination").cast("double")), 6).alias("hallucination_rate"),
    )


def harness_score(rows: DataFrame) -> DataFrame:
    """``query, answer, truth, contexts``: bigram faithfulness, neutral relevancy, context overlaps, weighted sum."""
    q, ctx, gb, gs = (F.col(c) for c in ("_q", "_c", "_gb", "_gs"))
    scored = with_words(rows, "query").select(
        *rows.columns,
        T.ratio(T.overlap(gb, F.col("_ab")), F.size(gb), 0.5).alias("faithfulness"),
        F.lit(0.5).alias("answer_relevancy"),
        F.when(F.col("_has"), T.ratio(T.overlap(ctx, q), F.size(q), 0.5)).otherwise(0.0).alias("context_precision"),
        F.when(F.col("_has"), T.ratio(T.overlap(ctx, gs), F.size(gs))).otherwise(0.0).alias("context_recall"),
    )
    return scored.withColumn("overall_score", F.round(weighted_score(), 9))


def failure_bucket(error: Column, answer: Column, score: Column, wrong: str = "wrong_answer") -> Column:
    has_error = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(has_error & F.contains(F.lower(error), F.lit("timeout")), "timeout").when(has_error, wrong)
        .when(T.strip(F.coalesce(answer, F.lit(""))) == "", "no_answer")
        .when(score >= 0.7, "correct").when(score >= 0.4, "partial").otherwise(wrong)
    )


# --- runs, gates and regressions ------------------------------------------------------------

REPORT_METRICS = ("overall_score", *METRICS)


def harness_report(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Means, interpolated latency percentiles and cost per ``keys`` (a run, or nothing)."""
    from . import ranks

    # scores come from long texts: they are computed once, the report reads numbers
    entries = materialize(entries.select(*keys, *REPORT_METRICS, "cost_usd", "latency_ms"), "entries")
    sums = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entries"), *[F.round(F.avg(m), 4).alias(m) for m in REPORT_METRICS],
        F.round(F.avg("cost_usd"), 6).alias("cost_per_answer_usd"), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"))
    q = ranks.exact_quantiles(entries, keys, "latency_ms", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    joined = sums.join(q, keys) if keys else sums.withColumn("p50", q.select("p50").scalar()).withColumn("p95", q.select("p95").scalar())
    return joined.select(*sums.columns, F.round("p50", 2).alias("latency_p50_ms"), F.round("p95", 2).alias("latency_p95_ms"))


def category_breakdown(entries: DataFrame) -> DataFrame:
    """Per category and bucket in one pass (``grouping``: which of the two)."""
    g = entries.groupingSets([["category"], ["bucket"]], "category", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("overall_score"), 4).alias("avg_score"), F.round(F.avg("faithfulness"), 4).alias("avg_faithfulness"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"), F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"))
    kind = F.when(F.col("category").isNotNull(), "category").otherwise("bucket")
    return g.select(kind.alias("grouping"), F.coalesce("category", "bucket").alias("name"), "n", "avg_score", "avg_faithfulness", "avg_latency_ms", "avg_cost_usd")


def baseline_compare(current: DataFrame, baseline: DataFrame, drop: float = 0.10) -> DataFrame:
    """One-row reports side by side: delta per metric, and whether it fell by more than ``drop``."""
    cols = [*REPORT_METRICS, "latency_p50_ms", "cost_per_answer_usd"]
    doubled = [F.col(c).cast("double").alias(c) for c in cols]
    c = unpivot(current.select(F.lit(1).alias("r"), *doubled), ["r"], cols).select("metric", F.col("value").alias("current"))
    b = unpivot(baseline.select(F.lit(1).alias("r"), *doubled), ["r"], cols).select("metric", F.col("value").alias("baseline"))
    fall = T.ratio(F.col("baseline") - F.col("current"), F.col("baseline"))
    return c.join(b, "metric").select(
        "metric", "current", "baseline", F.round(F.col("current") - F.col("baseline"), 6).alias("delta"),
        (F.col("metric").isin(list(REPORT_METRICS)) & (F.col("baseline") > 0) & (fall > drop)).alias("regressed"))


def harness_gates(report: DataFrame, compared: DataFrame) -> DataFrame:
    clean = compared.select(F.coalesce(~F.bool_or("regressed"), F.lit(True))).scalar()
    gates = report.select(
        (F.col("overall_score") >= 0.7).alias("overall_score"), (F.col("faithfulness") >= 0.5).alias("faithfulness"), clean.alias("no_major_regression"))
    return gates.withColumn("all_passed", F.col("overall_score") & F.col("faithfulness") & F.col("no_major_regression"))


def word_recall(expected: Column, answer: Column) -> Column:
    e = T.word_set(expected)
    return F.when(T.strip(answer) == "", 0.0).otherwise(T.ratio(T.overlap(e, T.words(answer)), F.size(e)))


def ci_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: mean word recall, nearest-rank latency and total cost."""
    from . import ranks

    results = materialize(results.select(*keys, "score", "cost_usd", "latency_ms"), "results")
    sums = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"), F.round(F.avg(F.round("score", 4)), 4).alias("overall_score"), F.round(F.sum("cost_usd"), 6).alias("total_cost"))
    q = ranks.exact_quantiles(results, keys, "latency_ms", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})
    return sums.join(q, keys).select(*sums.columns, F.round("p50", 2).alias("latency_p50"), F.round("p95", 2).alias("latency_p95"))


def ci_regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    b = baseline.select("overall_score", "latency_p50", "total_cost")
    base = {c: b.select(c).scalar() for c in b.columns}
    d = current.select(
        F.col("overall_score").alias("score"), base["overall_score"].alias("b_score"), F.col("latency_p50").alias("p50"),
        F.coalesce(F.nullif(base["latency_p50"], F.lit(0.0)), F.lit(1.0)).alias("b_p50"), F.col("total_cost").alias("cost"),
        F.coalesce(F.nullif(base["total_cost"], F.lit(0.0)), F.lit(1e-9)).alias("b_cost"))
    score = F.coalesce((F.col("b_score") > 0) & (T.ratio(F.col("b_score") - F.col("score"), F.col("b_score")) > 0.10), F.lit(False))
    flags = d.select(score.alias("score_regressed"), (F.col("p50") > F.col("b_p50") * 1.5).alias("latency_regressed"), (F.col("cost") > F.col("b_cost") * 2.0).alias("cost_regressed"))
    return flags.withColumn("regressed", F.col("score_regressed") | F.col("latency_regressed") | F.col("cost_regressed"))


def latest_completed(runs: DataFrame) -> DataFrame:
    """The newest completed run (``runs(run_id, seq, status)``)."""
    return runs.where(F.col("status") == "completed").orderBy(F.desc("seq")).limit(1)


def failure_rates(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per completed run: queries, failures and rate."""
    counted = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("bucket") != "correct").alias("failures"))
    done = runs.where(F.col("status") == "completed").join(counted, "run_id", "left").fillna(0, ["total_queries", "failures"])
    return done.select("run_id", "seq", "total_queries", "failures", F.round(T.ratio(F.col("failures"), F.col("total_queries")) * 100, 2).alias("failure_rate"))


def failure_analysis(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Failures of the newest completed run by bucket, with the run's totals."""
    run = latest_completed(runs).select("run_id")
    own = results.join(run, "run_id", "left_semi")
    total = own.select(F.count(F.lit(1))).scalar()
    by_bucket = own.where(F.col("bucket") != "correct").groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return by_bucket.select("run_id", "bucket", "n", total.alias("total_queries"), F.round(F.col("n") / total * 100, 2).alias("share"))


def failure_trends(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Rate of each completed run against the run before."""
    from pyspark.sql import Window

    rates = failure_rates(runs, results)
    # one row per run is left here: the window holds the number of runs, not of results
    prev = F.lag("failure_rate").over(Window.orderBy("seq"))
    delta = F.col("failure_rate") - F.col("prev")
    return rates.withColumn("prev", prev).where(F.col("prev").isNotNull()).select(
        "run_id", "failure_rate", F.round(delta, 2).alias("delta"), (delta < 0).alias("improved"), "total_queries", "failures")


def prompt_regression(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``prompt, version, score``: mean per version, and the drop to the next version in text order."""
    from pyspark.sql import Window

    means = scores.groupBy("prompt", "version").agg(F.round(F.avg("score"), 4).alias("avg_score"), F.count(F.lit(1)).alias("num_queries"))
    w = Window.partitionBy("prompt").orderBy("version")
    d = means.withColumn("prev_score", F.lag("avg_score").over(w)).withColumn("prev_version", F.lag("version").over(w))
    drop = F.round(F.col("prev_score") - F.col("avg_score"), 4)
    return d.select("prompt", "version", "avg_score", "num_queries", "prev_version", drop.alias("score_drop"), F.coalesce(drop > threshold, F.lit(False)).alias("regressed"))


def online_sample(rows: DataFrame, key: str, rate: float = 0.05) -> DataFrame:
    """A repeatable share of the rows by a hash of their key."""
    draw = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("bigint") / 4294967296.0
    return rows.where(draw < rate)


def daily_stats(samples: DataFrame) -> DataFrame:
    """Per date: samples, evaluated ones, their means, and evaluated rows per model."""
    e = F.col("evaluated")
    by_model = samples.groupBy("date", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e).alias("ev"), *[F.sum(F.when(e, F.col(c))).alias(c) for c in ("faithfulness", "overall_score", "latency_ms")])
    named = F.concat_ws("=", "model", F.col("ev").cast("string"))
    return by_model.groupBy("date").agg(
        F.sum("n").alias("total_samples"), F.sum("ev").alias("evaluated"),
        *[F.round(F.round(T.ratio(F.sum(c), F.sum("ev")), 9), 4).alias(f"avg_{c}") for c in ("faithfulness", "overall_score", "latency_ms")],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("ev") > 0, named))), ",").alias("models"))


def golden_filter(items: DataFrame, company: str | None = None, category: str | None = None) -> DataFrame:
    """Items of a company or category; repeated ids keep their first row (``seq``)."""
    if company:
        items = items.where(F.col("company") == company.upper())
    if category:
        items = items.where(F.col("category") == category)
    cols = [c for c in items.columns if c != "id"]
    return items.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct(*cols), "seq").alias("r")).select("id", "copies", "r.*")
