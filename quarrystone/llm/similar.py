"""One text of each group of near-duplicates: five-word similarity of 0.8 or more, no pair missed."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import Scratch, materialize
from .common import Rolling, free_names, quoted, text_udf, text_word_hashes
from .simhash import fingerprint, label_parts
from .simhash import links as print_links

#: Texts are near-duplicates from this share of common five-word shingles, as a fraction of whole numbers.
SHINGLE = 5
SHARE = (4, 5)
#: One text in so many is looked at for common shingles; shingles of that many of these texts, and so many of them
#: at most, stand last in the order of prefixes.  Any choice gives the same pairs, a good one fewer candidates.
SAMPLE, COMMON, COMMON_MOST = 8, 6, 100_000
#: Members of a large bucket that one key of the join holds, about.
CHUNK = 64
#: Members before a bucket that tell whether two sets have met in an earlier one; more of them repeat fewer pairs.
BEFORE = 8
#: Parts into which the rows of one name are dealt.
SALTS = 32
#: Bits of the filter that tells rows which stay for sure from those that must be looked up.
FILTER_BITS = 1 << 24


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the distinct runs of ``size`` words, sorted; of a shorter text the whole is one."""
    hashes = text_word_hashes((text or b"").lower())
    return np.unique((Rolling(hashes).windows(min(size, len(hashes))) >> np.uint64(32)).astype(np.uint32)) if len(hashes) else np.zeros(0, np.uint32)


def set_name(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def ordered_set(text: bytes | None, common: np.ndarray) -> tuple[int, np.ndarray]:
    """A name of the shingle set, and the set in the order of prefixes: common shingles last."""
    grams = shingles(text)
    known = np.zeros(len(grams), bool)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    return set_name(grams), np.concatenate([grams[~known], grams[known]]).view(np.int32)


def named_set(text: bytes | None, common: np.ndarray) -> tuple[int, np.ndarray, int]:
    """As ``ordered_set``, and the text's fingerprint."""
    return (*ordered_set(text, common), *fingerprint(text))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles that most texts of a sample have, sorted; at most ``COMMON_MOST``."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    grams = text_udf(lambda t: ((g := shingles(t))[: len(g) // 2 + 1].view(np.int32),), {"grams": pa.list_(pa.int32())})
    counted = some.select(F.explode(grams(F.col("text"))["grams"]).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    most = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(COMMON_MOST)
    return np.sort(most.select("gram").toPandas()["gram"].to_numpy(np.int32).view(np.uint32))


def may_reach(a: Column, b: Column) -> Column:
    """Whether sets that have a member in common at ``pos`` (of ``n``), the first one they share, can be similar enough."""
    p, q = SHARE
    return (q * F.least(a["n"], b["n"]) >= p * F.greatest(a["n"], b["n"])) & (
        (p + q) * F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= p * (a["n"] + b["n"]))


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("subject"), F.greatest(x, y).alias("object")]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose ``sets`` have similarity ``SHARE`` or more, by their members.

    ``sets`` lie in buckets by name: only the pairs move, and one set of each.
    """
    p, q = SHARE
    a, b = (sets.select(F.col("fp").alias(name), F.col("grams").alias(side)) for name, side in (("subject", "a"), ("object", "b")))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "subject").join(b, "object").where((p + q) * both >= p * (F.size("a") + F.size("b"))).select("subject", "object")


def print_pairs(sets: DataFrame, own: Scratch) -> DataFrame:
    """``subject, object``: names of sets whose fingerprints are linked; sets of one fingerprint meet the least of them."""
    prints = own.write(sets.groupBy("print").agg(F.min("fp").alias("least")), "similar-prints")
    same = sets.select("fp", "print").join(prints, "print").where("fp > least").select(F.col("least").alias("subject"), F.col("fp").alias("object"))
    near = print_links(prints.select(F.col("print").alias("fp")))
    for side in ("subject", "object"):
        near = near.join(prints.select(F.col("print").alias(side), F.col("least").alias(f"{side}_least")), side)
    return same.union(near.select(*ordered(F.col("subject_least"), F.col("object_least"))))


def heads(links: DataFrame) -> DataFrame:
    """``fp, joined``: the least set that each set is linked to, itself if it has no lesser one; sets of one head are connected."""
    near = links.select(F.explode(F.array(F.struct("object", "subject"), F.struct(F.col("subject").alias("object"), "subject"))).alias("x"))
    return near.groupBy(F.col("x.object").alias("fp")).agg(F.min("x.subject").alias("joined"))


def joined_parts(parts: DataFrame | None, links: DataFrame, own: Scratch) -> DataFrame:
    """``fp, component`` (its least set) once ``links`` are added to ``parts``: only the components that they touch are linked anew."""
    if parts is None:
        return own.write(components(links).withColumnRenamed("node", "fp"), "similar-parts")
    if links.isEmpty():
        return parts
    fresh = links.select(F.explode(F.array("subject", "object")).alias("fp")).select("fp", F.col("fp").alias("component"))
    known = own.write(parts.union(fresh).groupBy("fp").agg(F.min("component").alias("component")), "similar-known")
    ends = links
    for side in ("subject", "object"):
        ends = ends.join(known.select(F.col("fp").alias(side), F.col("component").alias(f"{side}_part")), side)
    moved = components(own.write(ends.select(*ordered(F.col("subject_part"), F.col("object_part"))).where("subject < object").distinct(), "similar-ends"))
    whole = known.join(moved.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return own.write(whole.select("fp", F.coalesce("least", "component").alias("component")), "similar-parts")


def similar_parts(sets: DataFrame, own: Scratch) -> DataFrame:
    """``fp, component``: names of shingle sets that others are similar to; any two of similarity ``SHARE`` or more share a component.

    Sets whose texts have linked fingerprints are compared first; the rest is found by what sets share, and sets that
    fingerprints have linked to one set are not compared again.

    Two sets that similar share a member of their prefixes: the first fifth of each in one order, so each set
    meets its partners in the buckets of its prefix.  Members that many texts have stand last in the order, which keeps
    buckets small.  In a bucket a set is first compared with the one before it and the first one, in the order of
    names everywhere, so that sets which share many buckets are compared once.  Where these comparisons leave a
    bucket in more than one piece, every pair that they have not connected is compared too: nothing is left to chance.
    """
    p, q = SHARE
    told = own.write(print_pairs(sets, own), "similar-told")
    first_links = own.write(verified(told, sets), "similar-told-near")
    joined = own.write(heads(first_links), "similar-joined")
    prefix = F.expr(f"n - ({p} * n + {q - 1}) div {q} + 1").cast("int")
    spread = sets.where("n > 0").join(joined, "fp", "left").select("fp", "n", "joined", F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("pos", "bucket"))
    w = Window.partitionBy("bucket")
    met = spread.withColumn("members", F.count(F.lit(1)).over(w)).where("members > 1").drop("members")
    met = own.write_buckets(met, "similar-met", "bucket", "fp")
    me, by_name = F.struct("fp", "n", "pos", "joined"), w.orderBy("fp")
    others = met.select(me.alias("me"), F.lag(me).over(by_name).alias("before"), F.first(me).over(by_name).alias("first"))
    near = others.select("me", F.explode(F.array(*[F.struct(F.col(c).alias("it"), F.lit(c == "before").alias("next")) for c in ("before", "first")])).alias("o"))
    able = may_reach(F.col("me"), F.col("o.it"))
    apart = ~F.coalesce(F.col("o.it.joined") == F.col("me.joined"), F.lit(False))
    near = near.where((F.col("o.it.fp") < F.col("me.fp")) & (F.col("o.next") | able) & apart)
    touching = near.groupBy(*ordered(F.col("me.fp"), F.col("o.it.fp"))).agg(F.bool_or("o.next").alias("next"), F.bool_or(able).alias("able"))
    touching = own.write(touching, "similar-pairs")
    pairs = touching.where("able").select("subject", "object").join(told, ["subject", "object"], "left_anti")
    links = own.write(first_links.union(verified(pairs, sets)), "similar-near")
    parts = joined_parts(None, links, own)
    # a bucket is in one piece if all neighbours in it are; else it holds the greater of two that are not
    apart = touching.where("next").select("subject", "object")
    for side in ("subject", "object"):
        apart = apart.join(parts.select(F.col("fp").alias(side), F.col("component").alias(f"{side}_part")), side, "left")
    apart = apart.where(F.coalesce(F.col("subject_part") != F.col("object_part"), F.lit(True)))
    open_sets = own.write(apart.select(F.col("object").alias("fp")).distinct(), "similar-open")
    if open_sets.isEmpty():
        return parts
    strays = met.join(open_sets, "fp", "left_semi")
    full = own.write(met.join(own.write(strays.select("bucket").distinct(), "similar-strays"), "bucket", "left_semi"), "similar-full")
    # many versions of one text are often similar to that one only: it is the one with the most links so far
    hubs = own.write(hub_pairs(full, parts, links).join(pairs.union(told), ["subject", "object"], "left_anti"), "similar-hubs")
    parts = joined_parts(parts, own.write(verified(hubs, sets), "similar-near"), own)
    known = pairs.union(told).union(hubs)
    rest = own.write(open_pairs(full, parts, sets, own).join(known, ["subject", "object"], "left_anti"), "similar-rest")
    return joined_parts(parts, own.write(verified(rest, sets), "similar-near"), own)


def hub_pairs(full: DataFrame, parts: DataFrame, links: DataFrame) -> DataFrame:
    """``subject, object``: the member of each bucket that has the most links, and those of other parts that it may reach."""
    degree = links.select(F.explode(F.array("subject", "object")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("degree"))
    named = full.join(degree, "fp").join(parts, "fp")
    hub = named.groupBy("bucket").agg(F.max(F.struct("degree", F.struct("fp", "n", "pos").alias("it"), "component")).alias("h"))
    met = full.join(parts, "fp", "left").join(hub, "bucket").where(~F.coalesce(F.col("component") == F.col("h.component"), F.lit(False)))
    met = met.select(F.struct("fp", "n", "pos").alias("me"), F.col("h.it").alias("other")).where(may_reach(F.col("me"), F.col("other")))
    return met.select(*ordered(F.col("me.fp"), F.col("other.fp"))).distinct()


def open_pairs(full: DataFrame, parts: DataFrame, sets: DataFrame, own: Scratch) -> DataFrame:
    """``subject, object``: all pairs of a bucket of ``full`` that lie in different ``parts`` and may be similar enough.

    The members of a bucket's largest component need not meet each other, all others meet everyone.  A
    bucket's members are dealt into chunks of ``CHUNK``, so that no task holds a large bucket.  Two sets that share many
    buckets meet in the first one: a bucket passes over pairs that have one of their ``BEFORE`` members before it in common.
    """
    placed = full.join(parts, "fp", "left").join(sets.select("fp", "grams"), "fp")
    before = F.slice("grams", F.greatest(F.col("pos") - BEFORE + 1, F.lit(1)), F.least("pos", F.lit(BEFORE)))
    named = own.write(placed.select("bucket", "fp", "n", "pos", F.coalesce("component", "fp").alias("component"), before.alias("before")), "similar-named")
    sizes = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n_own"))
    mains = sizes.groupBy("bucket").agg(F.sum("n_own").alias("n_all"), F.max(F.struct("n_own", "component")).alias("main")).where("n_all > main.n_own")
    mains = own.write(mains.select("bucket", F.ceil(F.col("n_all") / CHUNK).alias("chunks"), F.col("main.component").alias("main")), "similar-mains")
    split = named.join(mains, "bucket").withColumn("it", F.struct("fp", "n", "pos", "before"))
    dealt = split.select("bucket", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk"), F.col("component").alias("c"), F.col("main").alias("m"), F.col("it").alias("other"))
    strays = split.where(F.col("component") != F.col("main")).select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "component", F.col("it").alias("me"))
    me, other = F.col("me"), F.col("other")
    # two strays meet from the lesser one's side only
    once = (F.col("c") == F.col("m")) | (me["fp"] < other["fp"])
    first = ~F.arrays_overlap(me["before"], other["before"])
    met = strays.join(dealt, ["bucket", "chunk"]).where((F.col("component") != F.col("c")) & once & may_reach(me, other) & first)
    return met.select(*ordered(me["fp"], other["fp"])).distinct()


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, whatever the number of rows: the bit of each ``key`` is set."""
    bit = F.expr("shiftleft(1L, cast(pmod(key, 64) AS int))")
    words = keys.groupBy(F.floor(F.pmod("key", F.lit(bits)) / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toPandas()
    out[found["word"]] = found["bits"]
    return out.view(np.uint8)


def name_and_doubt(text: bytes | None, marked: np.ndarray) -> tuple[int, bool]:
    """The name of a text's shingle set, and whether its bit is set in ``marked``."""
    name = set_name(shingles(text))
    at = name % (8 * len(marked))
    return name, bool(marked[at >> 3] >> (at & 7) & 1)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates (five-word similarity of 0.8 or more), with the columns of ``docs``.

    Groups are what links of that similarity connect, found by fingerprints first and then by shared shingles, see
    :func:`similar_parts`; texts of equal shingle sets share
    a name.  The row with the least ``doc_id`` stays (null only if there is no other; of equal ids the
    least text).  Texts without a word are one group.  Rows whose name stands alone and is in no link stay where
    they are; a filter of fixed size finds them, and only the others are shuffled with their texts.
    """
    own = Scratch(docs.sparkSession, "similar")
    fp, label, key, known, okey, oknown, doubt, stays, salt, osalt = free_names(docs, "fp", "label", "key", "known", "key2", "known2", "doubt", "stays", "salt", "salt2")
    named = text_udf(partial(named_set, common=common_shingles(docs)), {"fp": pa.int64(), "grams": pa.list_(pa.int32()), "print": pa.int64()})
    sets = docs.select("doc_id", named(F.col("text")).alias("s")).select("doc_id", "s.*")
    sets = sets.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("texts"), F.min("grams").alias("grams"), F.min("print").alias("print"))
    sets = own.write_buckets(sets.select("fp", "first", "texts", "print", F.size("grams").alias("n"), "grams"), "similar-sets", "fp")
    prints = sets.select("fp", "first", "texts")
    parts = similar_parts(sets, own)
    labels = own.write(label_parts(prints, parts), "similar-labels")
    # of a group only the name that brings the least id stays; a group without an id keeps its least name
    chosen = prints.join(labels, "fp").groupBy("label", F.when(F.col("label").isNull(), F.col("fp")).alias("own")).agg(
        F.min(F.when(F.col("first").eqNullSafe(F.col("label")), F.col("fp"))).alias("fp"))
    linked = parts.select(F.col("fp").alias("key")).union(prints.where("texts > 1").select("fp")).distinct()
    linked = own.write(linked, "similar-linked")
    marked = filter_of(linked, FILTER_BITS)
    chosen = chosen.select(F.col("fp").alias("key"), F.coalesce("label", F.lit(0)).alias(okey), F.col("label").isNotNull().alias(oknown), F.lit(True).alias(stays))
    verdict = materialize(linked.join(chosen, "key", "left").select(F.col("key").alias(label), okey, oknown, stays), "similar-verdict")
    own.drop()

    told = text_udf(partial(name_and_doubt, marked=marked), {"fp": pa.int64(), "doubt": pa.bool_()})(F.col("text"))
    sure = docs.withColumn(fp, told).where(~F.col(f"{fp}.doubt")).select(*quoted(docs.columns))
    # explode skips null; a filter would be pushed below the name and compute it twice
    asked = docs.select(*quoted(docs.columns), told.alias(doubt)).select(*quoted(docs.columns), F.explode(F.when(F.col(f"{doubt}.doubt"), F.array(f"{doubt}.fp"))).alias(fp))
    # copies of one text share its name, not their ids: a name's rows are dealt into parts, and its verdict goes to each
    keyed = asked.withColumns({key: F.coalesce("doc_id", F.lit(0)), known: F.col("doc_id").isNotNull()}).withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)))
    verdict = verdict.withColumn(osalt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    kept = keyed.join(verdict, (F.col(fp) == F.col(label)) & (F.col(salt) == F.col(osalt)), "left").where(
        F.col(label).isNull() | (F.col(stays) & (F.col(key) == F.col(okey)) & (F.col(known) == F.col(oknown))))
    one = kept.groupBy(fp, salt, key, known).agg(F.min_by(F.struct(*quoted(docs.columns)), F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return sure.union(one.select("row.*"))
