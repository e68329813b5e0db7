"""Suggestions, related questions, conversation history and the semantic cache as table jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.rows import each
from ..session import materialize
from . import dense, ranks


def normalize_query(query: Column) -> Column:
    out = F.regexp_replace(query, fixed.NORMALIZED_COMPANIES, "[COMPANY]")
    return T.strip(F.regexp_replace(out, fixed.NORMALIZED_YEARS, "[YEAR]"))


def popular_patterns(history: DataFrame, limit: int = 10) -> DataFrame:
    """``history(pos, query)``: most frequent patterns, the earlier one first among equals."""
    counted = history.groupBy(normalize_query(F.col("query")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counted.orderBy(F.desc("n"), "first_pos").limit(limit)


def suggest(history: DataFrame, sources: DataFrame, limit: int = 5, n_sources: int = 3) -> DataFrame:
    """Popular patterns, then three questions about each of the first sources, then the defaults."""
    count = F.lit(0).cast("bigint")

    def rows(df: DataFrame, query, source: str, n: Column, kind: int, *order: Column) -> DataFrame:
        place = F.struct(F.lit(kind).alias("kind"), order[0].cast("bigint").alias("a"), order[1].cast("string").alias("b"), order[2].cast("bigint").alias("c"))
        return df.select(F.col(query).alias("query"), F.lit(source).alias("source"), n.alias("count"), place.alias("place"))

    no = F.lit("")
    popular = rows(popular_patterns(history), "pattern", "popular", F.col("n"), 0, -F.col("n"), no, F.col("first_pos"))
    first = sources.select("name").distinct().orderBy("name").limit(n_sources)
    asked = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("name")) for t in fixed.SOURCE_SUGGESTIONS])
    document = rows(first.select("name", F.posexplode(asked).alias("i", "query")), "query", "document", count, 1, F.lit(0), F.col("name"), F.col("i"))
    listed = history.sparkSession.createDataFrame([(q, i) for i, q in enumerate(fixed.DEFAULT_SUGGESTIONS)], "query string, i int")
    default = rows(listed, "query", "default", count, 2, F.col("i"), no, F.lit(0))
    every = popular.unionByName(document).unionByName(default)
    return every.orderBy("place").limit(limit).select("query", "source", "count")


def related_queries(queries: DataFrame, history: DataFrame, limit: int = 3, threshold: float = 0.3) -> DataFrame:
    """Earlier questions whose word sets overlap: Jaccard above ``threshold``, other text, first ``limit``.

    ``queries(qid, query)``, ``history(pos, query)``.  Copies of a text count once, at their first place.
    Candidates share a word among the rarest of both sides: sets above the threshold must, so common
    words need not meet (prefix filter).  Each candidate is then compared in full.
    """
    q = queries.select("qid", F.lower("query").alias("low"), T.word_set(F.col("query")).alias("words"))
    h = history.groupBy("query").agg(F.min("pos").alias("hid")).select(
        "hid", "query", F.lower("query").alias("low"), T.word_set(F.col("query")).alias("words"))
    counts = each(h, ["hid"], F.col("words"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def rare_words(side: DataFrame, key: str) -> DataFrame:
        known = each(side, [key, F.size("words").alias("n")], F.col("words"), "word").join(counts, "word")
        rows = known.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
        # words unknown to the history never match and would come first: they shorten the prefix
        missing = F.col("n") - F.size("w")
        keep = F.greatest(F.col("n") - F.floor(F.col("n") * F.lit(threshold)) - missing, F.lit(0)).cast("int")
        return rows.select(key, "n", F.explode(F.slice("w", F.lit(1), keep)).alias("w")).select(key, "n", "w.word")

    left = rare_words(q, "qid").withColumnRenamed("n", "nq")
    right = rare_words(h, "hid").withColumnRenamed("n", "nh")
    sized = (F.col("nq") > F.col("nh") * threshold) & (F.col("nh") > F.col("nq") * threshold)
    pairs = left.join(right, "word").where(sized).select("qid", "hid").distinct()
    checked = (
        pairs.join(q.select("qid", F.col("low").alias("ql"), F.col("words").alias("qw")), "qid")
        .join(h.select("hid", "query", F.col("low").alias("hl"), F.col("words").alias("hw")), "hid")
        .where((F.col("ql") != F.col("hl")) & (T.jaccard(F.col("qw"), F.col("hw")) > threshold))
    )
    return ranks.top_per_group(checked.select("qid", "hid", "query"), ["qid"], [F.asc("hid")], limit).select("qid", "rank", F.col("query").alias("related"))


def session_history(turns: DataFrame, limit: int = 5, kept: int = 10) -> DataFrame:
    """The last turns of each session, of those the memory keeps."""
    top = ranks.top_per_group(turns, ["conv_id"], [F.desc("turn")], min(limit, kept), rank="back")
    return top


def session_context(turns: DataFrame, limit: int = 5) -> DataFrame:
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.left("text", F.lit(200)))
    return session_history(turns, limit).groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("context"))


def live_entries(entries: DataFrame, now: Column, ttl_s: int = 86_400) -> DataFrame:
    return entries.where(now - F.col("ts_s") < ttl_s)


def semantic_lookup(lookups: DataFrame, entries: DataFrame, now: Column, threshold: float = 0.92) -> DataFrame:
    """``lookups(qid, query, embedding)``, ``entries(entry_id, query, embedding, ts_s, response)``.

    The nearest live entry if close enough, else the first live entry with the same text, else a miss.
    """
    live = live_entries(entries, now)
    # only the vectors are handed on: a further column would be a filter on entries of the same text
    near = dense.nearest(lookups.select("qid", "embedding"), live.select(F.col("entry_id").alias("vec_id"), "embedding"), 1).where(F.col("score") >= threshold)
    near = near.select("qid", F.col("vec_id").alias("near_id"), "score")
    by_text = live.groupBy("query").agg(F.min("entry_id").alias("text_id"))
    found = lookups.select("qid", "query").join(near, "qid", "left").join(by_text, "query", "left")
    how = F.when(F.col("near_id").isNotNull(), "semantic").when(F.col("text_id").isNotNull(), "exact").otherwise("miss")
    hit = found.select("qid", how.alias("outcome"), F.coalesce("near_id", "text_id").alias("entry_id"), "score")
    return hit.join(live.select("entry_id", "response"), "entry_id", "left")


def cache_evict(entries: DataFrame, now: Column, max_entries: int = 1000) -> DataFrame:
    return live_entries(entries, now).orderBy(F.desc("ts_s"), F.desc("entry_id")).limit(max_entries)


def cache_stats(outcomes: DataFrame, entries: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("outcome") != "miss")
    total = F.count(F.lit(1))
    n_entries = entries.select(F.count(F.lit(1))).scalar()
    return outcomes.agg(hits.alias("hits"), (total - hits).alias("misses"), F.round(T.ratio(hits, total), 4).alias("hit_rate")).withColumn("entries", n_entries)


def lookup_in_time(lookups: DataFrame, entries: DataFrame, threshold: float = 0.92, ttl_s: int = 86_400, max_entries: int = 1000, block: int = 1000) -> DataFrame:
    """``lookups(qid, query, embedding, ts_s)`` against the cache as it was at their own times.

    ``entries(entry_id, query, embedding, ts_s, response)``; times are whole seconds.  A lookup sees the entries put in
    before its time, younger than ``ttl_s``, and of those put in so far only the newest ``max_entries``: the others are
    evicted.  The nearest one counts if it is close enough, else the oldest with the same text; result as ``semantic_lookup``
    with ``n_seen``.  Equal similarities go to the older entry, equal times by id.

    Entries are numbered in the order of arrival; a lookup learns how many came before it by a running count over both
    tables, so what it may see is a run of numbers.  Entries lie in blocks of ``block`` numbers, of which a lookup meets those
    that its run touches; lookups of one block are dealt into groups of about as many.
    """
    arrivals = entries.select("ts_s", F.lit(1).alias("side"), F.col("entry_id").alias("id"), F.lit(1).cast("bigint").alias("put"))
    asked = lookups.select("ts_s", F.lit(0).alias("side"), F.col("qid").alias("id"), F.lit(0).cast("bigint").alias("put"))
    # of one second, lookups come first: they see what was put in before it
    order = F.col("ts_s") * 2 + F.col("side")
    placed = ranks.ordered_prefix(arrivals.unionByName(asked), [], order, F.col("id"), running={"upto": "put"})
    placed = materialize(placed.select("side", "id", "upto"), "cache-order")
    numbered = entries.join(placed.where("side = 1").select(F.col("id").alias("entry_id"), F.col("upto").alias("no")), "entry_id")
    named = {"text": F.xxhash64("query"), "embedding": F.col("embedding").cast("array<double>")}
    e = materialize(numbered.withColumns(named).select("entry_id", "no", F.floor(F.col("no") / block).alias("b"), "ts_s", "text", "embedding", "response"), "cache-entries")
    q = lookups.join(placed.where("side = 0").select(F.col("id").alias("qid"), "upto"), "qid").withColumns(named)
    first = F.greatest(F.col("upto") - max_entries + 1, F.lit(1))
    touched = F.sequence(F.floor(first / block), F.floor(F.col("upto") / block))
    q = materialize(q.select("qid", first.alias("first"), "upto", "ts_s", "text", "embedding", F.explode_outer(F.when(F.col("upto") > 0, touched)).alias("b")), "cache-lookups")
    groups = materialize(q.where("b IS NOT NULL").groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block).alias("groups")), "cache-groups")
    left = q.join(groups, "b").withColumn("g", F.pmod(F.xxhash64("qid"), "groups")).drop("groups")
    right = e.join(groups, "b").withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))).drop("groups", "response")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: [] for c in columns})
        held = held.sort_values("no")
        no, ids, at = (held[c].to_numpy() for c in ("no", "entry_id", "ts_s"))
        seen = (no >= asked["first"].to_numpy()[:, None]) & (no <= asked["upto"].to_numpy()[:, None]) & (asked["ts_s"].to_numpy()[:, None] - at < ttl_s)
        scores = np.where(seen, np.round(dense._unit(asked["embedding"]) @ dense._unit(held["embedding"]).T, dense.DIGITS), -np.inf)
        alike = seen & (asked["text"].to_numpy()[:, None] == held["text"].to_numpy())
        out = pd.DataFrame({"qid": asked["qid"].to_numpy(), "score": scores.max(1), "n_seen": seen.sum(1)})
        # the first of equal ones is the oldest
        for kind, at_most in (("near", scores), ("text", alike)):
            place, none = at_most.argmax(1), ~(seen if kind == "near" else alike).any(1)
            out[f"{kind}_id"] = pd.Series(ids[place]).astype("Int64").mask(none)
            out[f"{kind}_no"] = pd.Series(no[place]).astype("Int64").mask(none)
        return out[columns]

    columns = ["qid", "near_id", "near_no", "score", "text_id", "text_no", "n_seen"]
    schema = "qid long, near_id long, near_no long, score double, text_id long, text_no long, n_seen long"
    parts = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(run, schema)
    close = F.when(F.col("near_id").isNotNull(), F.struct(F.col("score").alias("s"), (-F.col("near_no")).alias("o")))
    best = parts.groupBy("qid").agg(F.max_by("near_id", close).alias("near_id"), F.max(close)["s"].alias("score"), F.min_by("text_id", "text_no").alias("text_id"), F.sum("n_seen").alias("n_seen"))
    near = F.coalesce(F.col("score") >= threshold, F.lit(False))
    how = F.when(near, "semantic").when(F.col("text_id").isNotNull(), "exact").otherwise("miss")
    hit = lookups.select("qid").join(best, "qid", "left").select(
        "qid", how.alias("outcome"), F.when(near, F.col("near_id")).otherwise(F.col("text_id")).alias("entry_id"), F.when(near, F.col("score")).alias("score"), F.coalesce("n_seen", F.lit(0)).alias("n_seen"))
    return hit.join(e.select("entry_id", "response"), "entry_id", "left")
