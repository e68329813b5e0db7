"""Training and scoring the complexity router."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import router
from ..session import materialize
from ..sources.tables import table
from .registry import query


def _labelled(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "complex").otherwise("simple").alias("label"))
    return labels.join(docs, "id")


@query("train_router")
def train_router(spark, d):
    """The learnt weight of every term."""
    model = router.train_router(_labelled(spark, d))
    terms, weights = model.stages[4].vocabulary, model.stages[-1].coefficients.toArray()  # at most max_features
    rows = [(t, float(w)) for t, w in zip(terms, weights)]
    return spark.createDataFrame(rows, "term string, weight double").select("term", F.round("weight", 4).alias("weight"))


@query("router_predict")
def router_predict(spark, d):
    """Each row by the model of the fold it is not in: none is scored on what it was trained on."""
    split = materialize(router.stratified_split(_labelled(spark, d)), "split")
    return router.held_out_predictions(split).select("id", "label", "predicted", F.round("confidence", 4).alias("confidence"))


@query("router_metrics")
def router_metrics(spark, d):
    """Metrics on the held-out fifth."""
    split = materialize(router.stratified_split(_labelled(spark, d)), "split")
    model = router.train_router(split.where(~F.col("is_test")))
    return router.class_metrics(router.router_predict(split.where("is_test"), model))


@query("router_cross_validation")
def router_cross_validation(spark, d):
    split = materialize(router.stratified_split(_labelled(spark, d)), "split")
    return router.cross_validate(split)


LABELLED = "lb AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'complex' ELSE 'simple' END AS label, CASE WHEN n_chars % 3 > 0 THEN 'complex' ELSE 'simple' END AS predicted FROM labels JOIN documents USING (doc_id))"


@query("stratified_split", "WITH " + LABELLED + """, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || left(md5(CAST(id AS VARCHAR)), 13) AS BIGINT), id) AS n, count(*) OVER (PARTITION BY label) AS c FROM lb)
SELECT id, label, n <= round(c * CAST(0.2 AS DOUBLE)) AS is_test, CAST(n % 5 AS INT) AS fold FROM r""")
def stratified_split(spark, d):
    return router.stratified_split(_labelled(spark, d).drop("query"))


@query("class_metrics", "WITH " + LABELLED + """, p AS (SELECT l.label, count(*) AS support, count(*) FILTER (predicted = l.label) AS tp, (SELECT count(*) FROM lb x WHERE x.predicted = l.label) AS guessed FROM lb l GROUP BY l.label),
m AS (SELECT label, support, tp / guessed AS pr, tp / support AS re FROM p), f AS (SELECT *, 2 * pr * re / (pr + re) AS f1 FROM m)
SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, (SELECT round(avg(CAST(label = predicted AS INT)), 6) FROM lb) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM f""")
def class_metrics(spark, d):
    """The metrics on given predictions."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 > 0, "complex").otherwise("simple").alias("predicted"))
    return router.class_metrics(_labelled(spark, d).drop("query").join(docs, "id"))
