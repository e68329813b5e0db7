"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Conversations of one family share the first turns of its first one, fewer than so many.
FAMILY, SHARED = 20, 4
#: Nodes of a component that one task splits by itself; larger ones are split by joins.
LOCAL = 20_000
#: Ids that are joined into one string at a time.
RUN = 4096
NODE = ["conv_id", "depth"]
_MOD = Decimal(1 << 63)


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``conv, part, at, turn digest, words`` in the order of conversation and turn; written, so that ``at`` is fixed.

    Rows are range-partitioned, so a long conversation lies in many parts; ``at`` numbers the rows of a part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), words.alias("words"))
    order = ["conv", "turn", "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return materialize(ordered.select("conv", "digest", "words", at.alias("at"), F.shiftright(at, 33).alias("part")), "trie-turns")


def running(rows: DataFrame, sums: list[str]) -> DataFrame:
    """``rows`` of ``conv, part, depth`` with ``sums`` as running sums along each conversation; parts are in order of depth."""
    inside = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "part").agg(*[F.sum(s).alias(s) for s in sums])
    starts = totals.select("conv", "part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"before_{s}") for s in sums])
    local = rows.withColumns({f"up_{s}": F.sum(s).over(inside) for s in sums})
    return local.join(starts, ["conv", "part"]).withColumns({f"up_{s}": F.col(f"up_{s}") + F.col(f"before_{s}") for s in sums}).drop(*[f"before_{s}" for s in sums])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``convs(conv, length)`` and the rebuilt turns ``conv, part, depth, digest, words, length``."""
    rows = ranked_turns(turns)
    pieces = materialize(rows.groupBy("conv", "part").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")), "trie-pieces")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")

    placed = rows.join(pieces.join(convs, "conv").select("conv", "part", "first_at", "earlier", "h", "taken", "length"), ["conv", "part"])
    placed = placed.withColumn("rank", F.col("at") - F.col("first_at") + F.col("earlier") + 1)
    tails = placed.where("rank > h").select("conv", "part", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "length")
    first = placed.where((F.col("rank") < SHARED) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), "rank", "digest", "words")
    heads = first.join(convs.select("conv", "base", "h", "length"), "base").where("rank <= h").select(
        "conv", F.lit(-1).cast("bigint").alias("part"), F.col("rank").alias("depth"), "digest", "words", "length")
    return convs.select("conv", "length"), heads.unionByName(tails)


def build(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie as ``nodes`` and ``paths``.

    A node is named by its least member and its depth: ``nodes`` has ``conv_id, depth, parent_conv_id, n_convs, n_children,
    words``.  ``paths`` has for each conversation ``conv`` and depth the node there (``conv_id``), its parent and whether the
    conversation ends there.  A prefix is known by the sum of two hashes of its (place, turn) pairs, 126 bits in all, so a
    conversation of any length is hashed in parts.
    """
    convs, rebuilt = rebuilt_turns(turns)
    terms = {"t1": F.xxhash64("depth", "digest"), "t2": F.xxhash64("digest", "depth")}
    terms = rebuilt.withColumns({n: t.cast("decimal(20,0)") for n, t in terms.items()}).drop("digest")
    summed = running(materialize(terms, "trie-terms"), ["t1", "t2"])

    def key(x: Column) -> Column:
        return F.pmod(x, F.lit(_MOD)).cast("bigint")

    keyed = materialize(summed.select(
        "conv", "depth", "words", (F.col("depth") == F.col("length")).alias("ends"), key(F.col("up_t1")).alias("k1"), key(F.col("up_t2")).alias("k2"),
        key(F.col("up_t1") - F.col("t1")).alias("p1"), key(F.col("up_t2") - F.col("t2")).alias("p2")), "trie-prefixes")
    mine, above = ["depth", "k1", "k2"], ["depth", "p1", "p2"]
    nodes = keyed.groupBy(*mine).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id", "n_convs",
        F.lit(0).cast("bigint").alias("words"), *[F.lit(None).cast("bigint").alias(p) for p in ("p1", "p2")])
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, above, "left").join(children, mine, "left").fillna(0, ["n_children"])
    nodes = materialize(nodes.select(*mine, "conv_id", "parent_conv_id", "n_convs", "n_children", "words"), "trie-nodes")
    paths = keyed.select("conv", "ends", *mine).join(nodes.select(*mine, "conv_id", "parent_conv_id"), mine).select("conv", "depth", "conv_id", "parent_conv_id", "ends")
    least = nodes.where("depth = 0").select("conv_id")
    top = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), least.scalar().alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"), (F.col("length") == 0).alias("ends"))
    return nodes.drop("k1", "k2"), materialize(paths.unionByName(top), "trie-paths")


def roll_up(parent: list[int], own: list[list[int]], total: list[list[int]]) -> None:
    """Adds to ``total`` of each node the ``own`` numbers of its strict descendants; parents come before children, tops have -1.

    A component is cut at its centroid, the deepest node with over half of its nodes below.  What hangs on the centroid
    becomes components of their own, whose totals go to the centroid and to all nodes from there to the top; the rest
    is the last component.  Each node is in as many components as the logarithm of their size.
    """
    size, whole = [1] * len(parent), list(range(len(parent)))
    trees: dict[int, list[int]] = {}
    for v, p in enumerate(parent):
        whole[v] = v if p < 0 else whole[p]
        trees.setdefault(whole[v], []).append(v)
    todo = list(trees.values())
    while todo:
        nodes = todo.pop()
        if len(nodes) == 1:
            continue
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes[1:]):
            size[parent[v]] += size[v]
        centre = next(v for v in reversed(nodes) if 2 * size[v] > len(nodes))
        piece: dict[int, int] = {}
        parts: dict[int, list[int]] = {}
        upper = []
        for v in nodes:
            p = parent[v]
            if p == centre or p in piece:
                piece[v] = v if p == centre else piece[p]
                parts.setdefault(piece[v], []).append(v)
            elif v != centre:
                upper.append(v)
        for mine, sums in zip(own, total, strict=True):
            below = sum(mine[v] for v in piece)
            sums[centre] += below
            below += mine[centre]
            v = centre
            while v != nodes[0]:
                v = parent[v]
                sums[v] += below
        todo += parts.values()
        if upper:
            todo.append(upper)


def small_components(state: DataFrame, sums: list[str], bins: int) -> DataFrame:
    """Components that fit into a task, many to a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("depth")
        names = list(zip(table["conv_id"].to_pylist(), table["depth"].to_pylist(), strict=True))
        tops = zip(table["top_conv"].to_pylist(), table["top_depth"].to_pylist(), strict=True)
        at = {name: i for i, name in enumerate(names)}
        parent = [-1 if name == top else at[p, name[1] - 1] for name, top, p in zip(names, tops, table["parent_conv_id"].to_pylist(), strict=True)]
        totals = [table[f"all_{s}"].to_pylist() for s in sums]
        roll_up(parent, [table[s].to_pylist() for s in sums], totals)
        out = table.select([*NODE, "parent_conv_id", "n_convs", "n_children"])
        for s, t in zip(sums, totals, strict=True):
            out = out.append_column(s, pa.array(t, pa.int64()))
        return out

    schema = ", ".join(f"{c} bigint" for c in [*NODE, "parent_conv_id", "n_convs", "n_children", *sums])
    columns = [*NODE, "parent_conv_id", "n_convs", "n_children", *sums, *[f"all_{s}" for s in sums], "top_conv", "top_depth"]
    return state.select(F.pmod(F.xxhash64("top_conv", "top_depth"), F.lit(bins)).alias("bin"), *columns).groupBy("bin").applyInArrow(
        lambda t: run(t.drop_columns(["bin"])), schema)


def split_once(state: DataFrame, big: DataFrame, paths: DataFrame, sums: list[str]) -> DataFrame:
    """The components of ``big`` cut at their centroids; ``size`` counts the nodes below in the same component."""
    top = ["top_conv", "top_depth"]
    state = state.join(big, top)
    centre = state.where("2 * size > n").groupBy(*top).agg(F.max_by(F.struct("conv_id", "depth", "size"), "depth").alias("c"))
    centre = materialize(centre.select(*top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "trie-centres")
    seen = state.join(centre, top)
    # a node hangs on the centroid if the way to it leads there: its own conversation's path says so
    child = paths.select(F.col("conv").alias("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("conv_id").alias("child"), F.col("parent_conv_id").alias("c_conv"))
    seen = seen.join(child, ["conv_id", "c_depth", "c_conv"], "left")
    is_centre = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    seen = seen.withColumns({"under": F.col("child").isNotNull() & (F.col("depth") > F.col("c_depth")), "is_centre": is_centre})
    seen = materialize(seen, "trie-seen")
    below = seen.where("under").groupBy(*top).agg(*[F.sum(s).alias(f"below_{s}") for s in sums])
    centre = centre.join(below, top, "left").join(seen.where("is_centre").select(*top, *sums), top).fillna(0, [f"below_{s}" for s in sums])
    centre = materialize(centre.select(*top, "c_conv", "c_depth", "c_size", *[(F.col(s) + F.col(f"below_{s}")).alias(f"add_{s}") for s in sums], *[f"below_{s}" for s in sums]), "trie-totals")
    way = paths.select(F.col("conv").alias("c_conv"), "conv_id", "depth").join(centre, "c_conv").where("depth >= top_depth AND depth < c_depth")
    way = way.select(*NODE, F.col("c_size").alias("less"), *[f"add_{s}" for s in sums])
    gained = centre.select(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth"), (F.col("c_size") - 1).alias("less"), *[F.col(f"below_{s}").alias(f"add_{s}") for s in sums])
    out = seen.join(way.unionByName(gained), NODE, "left").fillna(0, ["less", *[f"add_{s}" for s in sums]])
    moved = F.col("under") | F.col("is_centre")
    return materialize(out.select(
        *NODE, "parent_conv_id", "n_convs", "n_children", *sums, *[(F.col(f"all_{s}") + F.col(f"add_{s}")).alias(f"all_{s}") for s in sums],
        F.when(F.col("under"), F.col("child")).when(F.col("is_centre"), F.col("c_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(moved, F.col("c_depth") + F.col("under").cast("bigint")).otherwise(F.col("top_depth")).alias("top_depth"),
        (F.col("size") - F.col("less")).alias("size")), "trie-state")


def subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str], local: int = LOCAL) -> DataFrame:
    """``nodes`` with each of ``sums`` added up over the subtree of each node, its top included.

    Components of over ``local`` nodes are cut at their centroids by joins, all of one level at once; the rest is cut
    inside tasks.  Subtree sizes come from the members: a conversation brings the nodes that bear its name.
    """
    spans = paths.groupBy("conv").agg(F.max("depth").alias("last"), F.min(F.when(F.col("conv") == F.col("conv_id"), F.col("depth"))).alias("first")).where("first IS NOT NULL")
    sizes = paths.join(spans, "conv").groupBy(*NODE).agg(F.sum(F.col("last") + 1 - F.greatest("depth", "first")).alias("size"))
    least = nodes.where("depth = 0").select("conv_id")
    state = nodes.join(sizes, NODE).select(
        *NODE, "parent_conv_id", "n_convs", "n_children", *sums, *[F.col(s).alias(f"all_{s}") for s in sums],
        least.scalar().alias("top_conv"), F.lit(0).cast("bigint").alias("top_depth"), "size")
    state = materialize(state, "trie-state")
    bins = max(1, -(-state.count() // local))
    small = []
    while True:
        big = state.where((F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth")) & (F.col("size") > local))
        big = materialize(big.select("top_conv", "top_depth", F.col("size").alias("n")), "trie-big")
        small.append(state.join(big, ["top_conv", "top_depth"], "left_anti"))
        if big.isEmpty():
            break
        state = split_once(state, big, paths, sums)
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    return small_components(every, sums, bins)


def digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: the hash over the ``conv``s that end at a node, ascending and joined by commas.

    Runs of ids are joined in parallel; a task then streams a node's runs through one hash, whatever their number.
    """
    order = [*NODE, "conv"]
    at = F.monotonically_increasing_id()
    placed = materialize(ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.floor(at / RUN).alias("run")), "trie-ends")
    runs = placed.groupBy(*NODE, "run").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    runs = runs.repartition(*NODE).sortWithinPartitions(*NODE, "run")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(batch["conv_id"].to_pylist(), batch["depth"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if node == (conv, depth):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(ids.encode())
            yield packed(out)
        if node:
            yield packed([(*node, state.hexdigest())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])

    return runs.select(*NODE, "ids").mapInArrow(stream, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, turn, role, text``.  A conversation is rebuilt from the first turns of the first of its family
    (``c - c % FAMILY``) and its own later ones; see :func:`build` and :func:`subtree_sums`.

    Null roles and texts are empty.  A null ``turn`` comes first; equal turns, repeated rows among them, are each a turn
    and stand in the order of a hash of role and text.  Rows without a ``conv_id`` belong to no conversation.  Texts of any length
    are read as hashes and word counts; a conversation of any length is dealt over parts.  No rows give no nodes,
    not even a root.  Other columns are not read.
    """
    nodes, paths = build(turns)
    own = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    rolled = subtree_sums(own, paths, ["n_leaves", "saved_tokens"], local)
    out = rolled.join(digests(paths.where("ends").select(*NODE, "conv")), NODE, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


#: The query over ``conversations``; the reduction over bytes and shifts is crc32.
SQL = r"""
WITH own AS (
  SELECT conv_id, list({'h': sha256(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns,
    xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [ord(s), -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS seq FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, d, seq[1:d] AS key, d = len(seq) AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, key),
kids AS (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
n AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.key = nodes.key),
below AS (SELECT a AS d, key[1:a] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * key[d].w END) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN below ON below.d = n.d AND below.key = n.key LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]"""
