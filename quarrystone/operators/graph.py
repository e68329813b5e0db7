"""Entities, statements and the graph they form, as node and edge tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.rows import each
from ..session import fresh_path, materialize


def extract_entities(docs: DataFrame) -> DataFrame:
    """Typed names per document, one per lower-cased name and type, as first written."""
    def typed(pattern: str, kind: str) -> Column:
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(matches, lambda m: F.struct(T.strip(m).alias("name"), F.lit(kind).alias("type")))

    found = F.flatten(F.array(*[typed(pattern, kind) for pattern, kind in fixed.ENTITY_PATTERNS]))
    rows = each(docs, ["doc_id"], found, "e", "pos")
    return rows.groupBy("doc_id", F.lower("e.name").alias("key"), F.col("e.type").alias("type")).agg(
        F.min_by("e.name", "pos").alias("name"), F.min("pos").alias("pos")).drop("key")


#: A name and a run of words as the patterns write them, and the same as Java's matcher reads them in a loop.  For each further word
#: of a group that it may give back it calls itself, and a long run of words overflows the task's stack.
_NAME, _NAME_LOOP = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*", r"[A-Z][a-zA-Z]++(?:\s++[A-Z][a-zA-Z]++)*+"
_WORDS, _WORDS_LOOP = r"[a-zA-Z]+(?:\s+[a-zA-Z]+)*", r"[a-zA-Z](?:[a-zA-Z\s]*[a-zA-Z])?"


def _statement(pattern: str) -> str:
    """A pattern of a statement that also takes names with no statement behind them, whole; their second group is empty.

    It finds the same statements.  Names and white space are given back nowhere, as no statement goes on with a part of a word, a capital
    or more white space.
    All that starts inside a name ends where the name ends, so a name without a statement is passed once, not from each of its words.
    """
    head = f"({_NAME})"
    if not pattern.startswith(head):
        raise ValueError(f"a statement starts with a name: {pattern}")
    rest = pattern[len(head):].replace(_NAME, _NAME_LOOP).replace(_WORDS, _WORDS_LOOP)
    rest = re.sub(r"(\\s[+*])(?!\+)", r"\1+", rest)
    return f"({_NAME_LOOP})(?:{rest})?"


def extract_triples(docs: DataFrame) -> DataFrame:
    """Statements in pattern order, then text order: ``doc_id, pos, subject, predicate, object, confidence``.

    Each pattern goes over the text once; its groups are taken from what it found.
    """

    def stated(predicate: str, confidence: float, pattern: str) -> Column:
        pattern = _statement(pattern)

        def triple(m: Column) -> Column:
            obj = F.regexp_extract(m, pattern, 2)
            if predicate in ("REPORTED_REVENUE", "NET_INCOME"):
                obj = F.concat(F.lit("$"), obj, F.lit(" "), F.regexp_extract(m, pattern, 3))
            return F.struct(T.strip(F.regexp_extract(m, pattern, 1)).alias("subject"), F.lit(predicate).alias("predicate"),
                            T.strip(obj).alias("object"), F.lit(confidence).alias("confidence"))

        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(F.filter(found, lambda m: F.regexp_extract(m, pattern, 2) != ""), triple)

    lists = [stated(*t) for t in fixed.TRIPLE_PATTERNS]
    return each(docs, ["doc_id"], F.flatten(F.array(*lists)), "t", "pos").select("doc_id", "pos", "t.*")


def build_graph(triples: DataFrame) -> DataFrame:
    """One edge per (subject, object); the last statement in (document, position) order names it."""
    seq = F.struct("doc_id", "pos")
    return triples.groupBy("subject", "object").agg(
        F.max_by("predicate", seq).alias("predicate"), F.max_by("confidence", seq).alias("confidence"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("subject").alias("node")).union(edges.select("object")).distinct()


def query_entity(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of each entity (``entities(entity)``), outgoing and incoming."""
    e = entities.select("entity")
    out = edges.join(e, F.col("subject") == F.col("entity")).select("entity", F.lit("outgoing").alias("direction"), F.col("predicate").alias("relation"), F.col("object").alias("other"), "confidence")
    inc = edges.join(e, F.col("object") == F.col("entity")).select("entity", F.lit("incoming").alias("direction"), F.col("predicate").alias("relation"), F.col("subject").alias("other"), "confidence")
    return out.unionByName(inc)


def within_hops(edges: DataFrame, entities: DataFrame, depth: int = 2) -> DataFrame:
    """``entity, node, hops``: nodes reached over edges of either direction, at their least distance.

    Each round joins only the newest ring; the reached set is written out so that plans stay short.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(edges.select("object", "subject")).distinct()
    both = materialize(both, "links")
    reached = materialize(entities.select("entity", F.col("entity").alias("node"), F.lit(0).alias("hops")), "hops")
    for hop in range(1, depth + 1):
        ring = reached.where(F.col("hops") == hop - 1).join(both, F.col("node") == F.col("a")).select("entity", F.col("b").alias("node")).distinct()
        new = ring.join(reached, ["entity", "node"], "left_anti").withColumn("hops", F.lit(hop))
        reached = materialize(reached.unionByName(new), "hops")
    return reached


def entity_context(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, part, other, line``: the context text of each entity, one row per line.

    In the order of ``part, other, line`` an entity's lines are its text: the header (part 0), then its outgoing (1) and
    incoming (2) statements.  A hub of any degree is many rows, never one group.
    """
    conns = query_entity(edges, entities)
    line = F.concat(F.lit("  - "), F.col("relation"), F.lit(" -> "), F.col("other"))
    lines = conns.select("entity", F.when(F.col("direction") == "outgoing", 1).otherwise(2).alias("part"), "other", line.alias("line"))
    known = conns.select("entity").distinct().withColumn("known", F.lit(True))
    heads = entities.select("entity").join(known, "entity", "left").select(
        "entity", F.lit(0).alias("part"), F.lit("").alias("other"),
        F.when(F.col("known"), F.concat(F.lit("Entity: "), F.col("entity"))).otherwise(F.concat(F.lit("No information found for "), F.col("entity"))).alias("line"))
    return heads.unionByName(lines)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node of each weakly connected part).

    Alternates two star steps: every node's larger, then smaller, neighbours are hung on its least
    neighbour.  Rounds grow with the logarithm of the diameter, edges never outgrow the input, and a
    hub is reduced map-side by ``min``.  Each round is written to the shared folder.
    """

    def links(df: DataFrame) -> DataFrame:
        return df.where(F.col("u") != F.col("v")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return links(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return links(moved.union(least.select("u", F.col("m").alias("v"))))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    every = nodes(edges)
    e = materialize(links(edges.select(F.col("subject").alias("u"), F.col("object").alias("v"))), "stars")
    seen = None
    for _ in range(max_rounds):
        e = materialize(small_star(large_star(e)), "stars")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return every.join(e.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def graph_stats(edges: DataFrame) -> DataFrame:
    parts = components(edges).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node") == F.col("component")).alias("connected_components"))
    n_edges = edges.select(F.count(F.lit(1))).scalar()
    n = F.col("nodes")
    return parts.withColumn("edges", n_edges).withColumn("density", F.round(T.ratio(F.col("edges"), n * (n - 1)), 9))


def save_graph(edges: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(edges.sparkSession, "graph")
    edges.write.parquet(f"{path}/edges")
    nodes(edges).write.parquet(f"{path}/nodes")
    return path


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def build_summary(entities: DataFrame, triples: DataFrame, graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    sizes = [df.select(F.count(F.lit(1)).alias(name)) for name, df in (
        ("entities", entities), ("triples", triples), ("graph_nodes", graph_nodes), ("graph_edges", graph_edges))]
    return reduce(lambda a, b: a.withColumn(b.columns[0], b.scalar()), sizes[1:], sizes[0])
