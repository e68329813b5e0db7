"""Combining rankings.  A ranking is ``qid, list_no, pos`` (from 0)``, text, score`` and any metadata."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extraction, ranks

PLACES = 12
#: Models that this worker has loaded, by scorer.
_MODELS: dict[str, Callable] = {}


def _key(text: str = "text") -> Column:
    return F.left(T.strip(F.col(text)), F.lit(500))


def _fuse(parts: DataFrame, meta: list[str], top_k: int) -> DataFrame:
    """Sum contributions per text key.  Equal scores keep the order of first sight."""
    seen = F.struct("list_no", "pos")
    per_list = parts.groupBy("qid", "key", "list_no").agg(
        F.sum("part").alias("part"), F.max_by("shown", "pos").alias("shown"), F.min("pos").alias("pos"),
        *[F.min_by(m, "pos").alias(m) for m in meta],
    )
    fused = per_list.groupBy("qid", "key").agg(
        F.round(F.sum("part"), PLACES).alias("score"), F.min(seen).alias("seen"),
        *[F.min_by(m, seen).alias(m) for m in meta],
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("list_"), F.col("list_no").cast("string")), F.col("shown")))).alias("source_scores"),
    )
    return ranks.top_per_group(fused, ["qid"], [F.desc("score"), F.asc("seen")], top_k).drop("seen").withColumnRenamed("key", "text")


def rrf_fusion(ranked: DataFrame, meta: list[str], k: int = 60, top_k: int = 20) -> DataFrame:
    part = F.lit(1.0) / (F.lit(k) + F.col("pos") + 1)
    return _fuse(ranked.select("qid", "list_no", "pos", *meta, _key().alias("key"), part.alias("part"), part.alias("shown")), meta, top_k)


def weighted_fusion(ranked: DataFrame, meta: list[str], weights: list[float], top_k: int = 20) -> DataFrame:
    """Scores scaled by the best of their list, times the list's share of the weights."""
    total = sum(weights)
    share = F.element_at(F.array(*[F.lit(w / total) for w in weights]), (F.col("list_no") + 1).cast("int"))
    best = ranked.groupBy("qid", "list_no").agg(F.max("score").alias("best"))
    scaled = F.col("score") / F.when(F.col("best") == 0, F.lit(1.0)).otherwise(F.col("best"))
    parts = ranked.join(best, ["qid", "list_no"]).select(
        "qid", "list_no", "pos", *meta, _key().alias("key"), (scaled * share).alias("part"), scaled.alias("shown"))
    return _fuse(parts, meta, top_k)


def hybrid_weighted(dense: DataFrame, sparse: DataFrame, top_k: int = 10, w_dense: float = 0.6, w_sparse: float = 0.4) -> DataFrame:
    """``qid, doc_id, score`` on both sides; a missing side counts zero."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        best = df.groupBy("qid").agg(F.max("score").alias("best"))
        return df.join(best, "qid").select("qid", "doc_id", T.ratio(F.col("score"), F.col("best")).alias(name))

    both = scaled(dense, "vector_score").join(scaled(sparse, "bm25_score"), ["qid", "doc_id"], "full_outer").fillna(
        0.0, ["vector_score", "bm25_score"])
    scored = both.withColumn("score", F.round(w_dense * F.col("vector_score") + w_sparse * F.col("bm25_score"), PLACES))
    return ranks.top_per_group(scored, ["qid"], [F.desc("score"), F.asc("doc_id")], top_k)


def _model(name: str, load: Callable) -> Callable:
    # a function of the module, so that workers find their own dictionary and not a copy that came with the task
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def pair_scorer(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]], rows: int = 512):
    """A scorer of (query, document) pairs for ``rerank``, such as a cross-encoder.

    ``load`` brings the model: a function of two columns.  A worker calls it once, however many tasks it runs,
    and gives the model at most ``rows`` pairs at a time.
    """

    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def scorer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for query, text in batches:
            parts = [model(query[k:k + rows], text[k:k + rows]) for k in range(0, len(query), rows)]
            yield pd.concat(parts) if parts else pd.Series([], dtype="float64")

    return scorer


def lexical_scorer(query: Column, text: Column) -> Column:
    """Share of query words found in the text."""
    q = T.word_set(query)
    return T.ratio(T.overlap(q, T.words(text)), F.size(q))


def rerank(candidates: DataFrame, scorer=None, top_k: int = 5) -> DataFrame:
    """``candidates(qid, pos, query, text)``.  Without a scorer the order stays, one hundredth less per place."""
    if scorer is None:
        kept = candidates.where(F.col("pos") < top_k)
        return kept.withColumn("rerank_score", F.round(1.0 - F.col("pos") * 0.01, PLACES)).withColumn("rank", (F.col("pos") + 1).cast("int"))
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    return ranks.top_per_group(scored, ["qid"], [F.desc("rerank_score"), F.asc("pos")], top_k)


def dedupe_best(hits: DataFrame, top_k: int = 5) -> DataFrame:
    """Union of the rankings of query variants (``qid, seq, text, score``): best row per 200-character key.

    ``seq`` is the order of arrival: the first of equal scores stays, at its key's first place.
    """
    key = F.left("text", F.lit(200))
    best = hits.groupBy("qid", key.alias("key")).agg(
        F.max("score").alias("score"), F.min("seq").alias("first_seq"),
        F.max_by(F.struct(*[c for c in hits.columns if c not in ("qid", "score")]), F.struct(F.col("score"), -F.col("seq"))).alias("row"),
    )
    top = ranks.top_per_group(best, ["qid"], [F.desc("score"), F.asc("first_seq")], top_k)
    return top.select("qid", "rank", "score", "row.*")


def build_context(hits: DataFrame, max_parts: int = 10, max_tables: int = 3) -> DataFrame:
    """One text per query (``qid, pos, ticker, year, text``): a ``[T Y] text`` block per hit, then the first tables in the hits.

    All hits are searched for tables.  The tables are one part more, and only the first ``max_parts`` parts stay.
    """
    top = ranks.top_per_group(hits, ["qid"], [F.asc("pos")], max_parts, rank="_n")
    block = F.concat(F.lit("["), F.col("ticker"), F.lit(" "), F.col("year").cast("string"), F.lit("] "), F.col("text"))
    blocks = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))), lambda s: s["b"]).alias("blocks"))
    found = extraction.extract_md_tables(hits.select("qid", F.col("pos").alias("hit"), "ticker", "year", "text"))
    first = ranks.top_per_group(found, ["qid"], [F.asc("hit"), F.asc("pos")], max_tables, rank="_t")
    tables = extraction.format_context(first.select(F.col("qid").alias("doc_id"), "ticker", "year", (F.col("_t") - 1).alias("pos"), "headers", "rows"), max_tables)
    both = blocks.join(tables.select(F.col("doc_id").alias("qid"), F.concat(F.lit("\nStructured Data:\n"), "context").alias("tables")), "qid", "left")
    parts = F.slice(F.concat("blocks", F.when(F.col("tables").isNotNull(), F.array("tables")).otherwise(F.array().cast("array<string>"))), 1, max_parts)
    return both.select("qid", F.array_join(parts, "\n\n---\n\n").alias("context"))
