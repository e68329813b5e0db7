"""Complexity router: TF-IDF over one- and two-word terms and logistic regression, in Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import each
from ..session import materialize
from . import ranks

LABELS = ("simple", "complex")


def _label_index() -> Column:
    return F.when(F.col("label") == LABELS[1], 1.0).otherwise(0.0)


def _weighted(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with the class ``y`` as a number and the weight ``w`` that brings classes to equal sums, and how many they are."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("y", _label_index()).withColumn("w", weight), total


def _term_stages() -> list:
    return [
        RegexTokenizer(inputCol="query", outputCol="raw", pattern=r"\w\w+", gaps=False),
        StopWordsRemover(inputCol="raw", outputCol="ones"),
        NGram(inputCol="ones", outputCol="twos", n=2),
        SQLTransformer(statement="SELECT *, concat(ones, twos) AS terms FROM __THIS__"),
    ]


def _fitted(counted: DataFrame, total: int, c: float, max_iter: int, known: list[float] | None = None) -> list:
    """The stages behind term counts ``tf``; where ``known`` is 0, a term counts nothing."""
    # a term of every row still counts once: the smooth weight has one more than Spark's
    idf = IDF(inputCol="tf").fit(counted).idf.toArray() + 1
    rest = [
        ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense(idf if known is None else idf * known)),
        Normalizer(inputCol="tfidf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=max_iter, regParam=1.0 / (c * total), standardization=False),
    ]
    return Pipeline(stages=rest).fit(counted).stages


def train_router(rows: DataFrame, max_features: int = 1000, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """``query, label``.  Classes are weighted to equal sums; the penalty is that of strength ``c``."""
    given, total = _weighted(rows)
    counted = Pipeline(stages=[*_term_stages(), CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=max_features)]).fit(given)
    return PipelineModel([*counted.stages, *_fitted(counted.transform(given), total, c, max_iter)])


def router_predict(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``predicted`` and ``confidence``; without a model every query is simple at one half."""
    if model is None:
        return rows.withColumn("predicted", F.lit(LABELS[0])).withColumn("confidence", F.lit(0.5))
    out = model.transform(rows)
    return out.select(*rows.columns, F.when(F.col("prediction") == 1.0, LABELS[1]).otherwise(LABELS[0]).alias("predicted"),
                      F.array_max(vector_to_array("probability")).alias("confidence"))


def stratified_split(rows: DataFrame, test_size: float = 0.2, folds: int = 5) -> DataFrame:
    """Adds ``is_test`` (an exact share of each class) and ``fold``, by the rank of a hash within the class."""
    # 52 bits of the digest: exact as a double
    draw = F.conv(F.left(F.md5(F.col("id").cast("string")), F.lit(13)), 16, 10).cast("bigint")
    ranked = ranks.ordered_prefix(rows, ["label"], draw, F.col("id"), rank="_n")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    return ranked.join(sizes, "label").withColumn("is_test", F.col("_n") <= F.round(F.col("_c") * test_size)).withColumn(
        "fold", (F.col("_n") % folds).cast("int")).drop("_n", "_c")


def confusion(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(keys or []), "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, plus accuracy and macro F1 on every row; 0 where undefined."""
    m = confusion(predictions)
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    by_label = m.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("tp"))
    by_guess = m.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    j = by_label.join(by_guess, "label", "full_outer").fillna(0)
    p, r = T.ratio(F.col("tp"), F.col("guessed")), T.ratio(F.col("tp"), F.col("support"))
    scored = j.select("label", "support", p.alias("precision"), r.alias("recall"), T.ratio(2 * p * r, p + r).alias("f1"))
    total = m.agg(T.ratio(hit, F.sum("n")).alias("a")).scalar()
    macro = scored.agg(F.avg("f1")).scalar()
    return scored.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                         F.round(total, 6).alias("accuracy"), F.round(macro, 6).alias("macro_f1"))


def fold_terms(terms: DataFrame, folds: int, max_features: int) -> list[list[str]]:
    """For each fold the terms that the rows of all others use most, of ``terms, fold``: all folds are counted at once."""
    used = each(terms, ["fold"], F.col("terms"), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(folds)])
    used = materialize(used, "router-terms")
    rest = [used.select("term", (F.col("n") - F.col(f"n{k}")).alias("n")).where("n > 0") for k in range(folds)]
    return [[r.term for r in df.orderBy(F.desc("n"), "term").limit(max_features).collect()] for df in rest]


def held_out_predictions(rows: DataFrame, folds: int = 5, max_features: int = 1000, c: float = 1.0, max_iter: int = 1000) -> DataFrame:
    """The rows (which carry ``fold``), without ``query``, with ``predicted`` and ``confidence`` of the model trained without their fold.

    Texts are read twice, however many folds and rounds of training there are: once for the terms of each fold, once for
    the counts of all these terms, which are written.  A fold's model gives no weight to terms that are not its own.
    """
    kept = [name for name in rows.columns if name != "query"]
    terms = PipelineModel(_term_stages()).transform(rows)
    own = fold_terms(terms, folds, max_features)
    words = sorted(set().union(*own))
    if not words:
        raise ValueError("there is no term to learn from")
    counted = CountVectorizerModel.from_vocabulary(words, "terms", "tf").transform(terms).select(*kept, "tf")
    counted = materialize(counted, "router-counts")
    parts = []
    for k in range(folds):
        given, total = _weighted(counted.where(F.col("fold") != k))
        mine = set(own[k])
        model = PipelineModel(_fitted(given, total, c, max_iter, [float(w in mine) for w in words]))
        parts.append(router_predict(counted.where(F.col("fold") == k), model).select(*kept, "predicted", "confidence"))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(rows: DataFrame, folds: int = 5, **params) -> DataFrame:
    """``fold, accuracy`` of one model per fold (``rows`` carry ``fold``)."""
    return held_out_predictions(rows, folds, **params).groupBy("fold").agg(
        F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
