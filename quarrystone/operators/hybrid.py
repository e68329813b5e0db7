"""Hybrid retrieval: filtered nearest vectors and sparse hits, fused and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, fusion
from . import understanding as U


def question_filters(questions: DataFrame) -> DataFrame:
    """Adds the ``ticker`` and ``year`` that the ``query`` names; null where it names none."""
    return questions.withColumns({"ticker": F.upper(U.entity_filter(F.col("query"))), "year": U.year(F.col("query"))})


def hybrid_retrieve(
    questions: DataFrame, vectors: DataFrame, sparse_hits: DataFrame, texts: DataFrame, top_k: int = 10,
    use_filters: bool = True, use_rrf: bool = True, scorer=None,
) -> DataFrame:
    """``qid, rank, doc_id, text, fused_score, rerank_score`` of the best ``top_k`` hits of each question.

    ``questions(qid, query, embedding)``, ``vectors(vec_id, embedding, ticker, year)``, ``sparse_hits(qid, doc_id, score,
    rank)`` and ``texts(doc_id, text)``.  With ``use_filters`` the company and the year a question names restrict its
    vector list; the sparse list is never restricted.  Three times ``top_k`` of either list are fused by reciprocal ranks,
    or by scaled scores, and reranked by ``scorer``; without one the fused order stays.
    """
    depth = 3 * top_k
    asked = questions.select("qid", "query", "embedding")
    wanted = question_filters(asked) if use_filters else asked
    near = dense.nearest(wanted.drop("query"), vectors, depth).select("qid", F.col("vec_id").alias("doc_id"), "score", "rank", F.lit(0).alias("list_no"))
    sparse = sparse_hits.where(F.col("rank") <= depth).select("qid", "doc_id", "score", "rank", F.lit(1).alias("list_no"))
    lists = near.unionByName(sparse).join(texts.select("doc_id", "text"), "doc_id").select("qid", "list_no", (F.col("rank") - 1).alias("pos"), "doc_id", "score", "text")
    if use_rrf:
        fused = fusion.rrf_fusion(lists, ["doc_id"], top_k=depth)
    else:
        fused = fusion.weighted_fusion(lists, ["doc_id"], [0.6, 0.4], top_k=depth)
    candidates = fused.select("qid", "doc_id", "text", F.col("score").alias("fused_score"), (F.col("rank") - 1).alias("pos"))
    best = fusion.rerank(candidates.join(asked.select("qid", "query"), "qid"), scorer, top_k)
    return best.select("qid", "rank", "doc_id", "text", "fused_score", "rerank_score")
