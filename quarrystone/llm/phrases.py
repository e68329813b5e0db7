"""Repeated strings of a fixed length, found by overlapping phrases that the content itself delimits.

A sequence (bytes or words) is cut into phrases at triggers: the least rolling hash among the grams of the
first ``reach`` places of a window marks the window's anchor.  Neighbouring windows mostly share one, and the
windows with one anchor form a phrase.  Phrases overlap by ``window - 1`` places, so every window lies in exactly
one phrase, and equal windows lie at equal distance from equal anchors, whatever surrounds them.  So

* a window can only be repeated if the short run of places after its anchor (its key) is;
* a phrase that is repeated has all its windows repeated;
* only of the phrases that share their key with a different phrase are single windows compared.

What is grouped is summed before the shuffle.  Apart from texts, each moved once to its keys, only 64- and 128-bit
hashes are shuffled, and for bytes the phrases of keys that few phrases share: a phrase is shorter than
the hashes of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BASES, Rolling, mix, text_udf

#: Windows are handled in stretches of so many starts: bounded memory for texts of any length.  A phrase that
#: is cut by the end of a stretch differs from its copies, and its windows are then compared one by one.
STRETCH = 1 << 17
#: Up to so many phrases of one key are compared as bytes in one group, more by the hashes of their windows, which
#: are summed before they meet: a key may open a phrase in a third of all texts.
GROUP = 4096
#: Phrases in one task's group of keys.
BUCKET = 10_000
PLACE_BITS = 20


@dataclass(frozen=True)
class Shape:
    window: int
    reach: int
    gram: int
    #: "earlier": repeated means also in a row of a smaller id; "any": anywhere else, in the same row too.
    mode: str

    @property
    def key(self) -> int:
        return self.window - self.reach + 1


@dataclass
class Stretch:
    """Windows ``at`` to ``at + n``: phrases from ``first`` to ``last`` start, with their hashes."""

    at: int
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    a: np.ndarray
    rolls: list[Rolling]
    shape: Shape

    @property
    def b(self) -> np.ndarray:
        return self.rolls[1].of(self.first, self.last + self.shape.window).view(np.int64)

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """The starts of all windows of the chosen phrases."""
        return ranges(self.first[chosen], self.last[chosen] + 1)

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        return np.stack([r.of(starts, starts + self.shape.window).view(np.int64) for r in self.rolls], 1)


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    if not lengths.sum():
        return np.zeros(0, np.int64)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span < size:
        step = min(span, size - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def stretches(values: np.ndarray, shape: Shape, second: bool = False) -> Iterator[Stretch]:
    """The phrases of a sequence of 64-bit values; none if it is shorter than a window."""
    for at in range(0, len(values) - shape.window + 1, STRETCH):
        part = values[at:at + STRETCH + shape.window - 1]
        rolls = [Rolling(part, b) for b in BASES[: 2 if second else 1]]
        grams = rolls[0].windows(shape.gram)[: len(part) - shape.window + shape.reach]
        marked = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_least(marked, shape.reach) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        keys = rolls[0].of(anchor[first], anchor[first] + shape.key).view(np.int64)
        yield Stretch(at, first, last, keys, rolls[0].of(first, last + shape.window).view(np.int64), rolls, shape)


def isin(x: np.ndarray, given: np.ndarray) -> np.ndarray:
    return np.isin(x, given) if len(given) else np.zeros(len(x), bool)


def few(rows: np.ndarray, most: int) -> np.ndarray:
    """Distinct rows, each at most ``most`` times."""
    if not len(rows):
        return rows
    found, times = np.unique(rows, axis=0 if rows.ndim > 1 else None, return_counts=True)
    return np.repeat(found, np.minimum(times, most), axis=0)


@dataclass(frozen=True)
class Kind:
    """What a text is a sequence of."""

    values: Callable[[bytes], np.ndarray]
    #: text, kept places or None for all -> digest of what is kept
    digest: Callable[[bytes, np.ndarray | None], str]
    shape: Shape

    #: Whether phrases can be sent as they are: a byte each place, so shorter than window hashes.
    sends: bool = False

    @property
    def most(self) -> int:
        return 2 if self.shape.mode == "any" else 1

    def keys(self, text: bytes | None) -> tuple[np.ndarray]:
        found = [np.zeros(0, np.int64), *(s.keys for s in stretches(self.values(text or b""), self.shape))]
        return (few(np.concatenate(found), self.most),)

    def phrases(self, packed: bytes | None, keys: np.ndarray) -> tuple[int, np.ndarray, str | None]:
        text = unpack(packed)
        values, found = self.values(text), [np.zeros((0, 3), np.int64)]
        if len(keys):
            for s in stretches(values, self.shape, True):
                chosen = isin(s.keys, keys)
                if chosen.any():
                    found.append(np.stack([s.keys, s.a, s.b], 1)[chosen])
        rows = few(np.concatenate(found), self.most)
        return len(values), rows, None if len(rows) else self.digest(text, None)

    def open_windows(self, packed: bytes | None, light: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray]:
        """Hashes of the windows of open phrases, those of heavy ones twice."""
        found = [np.zeros((0, 2), np.int64)]
        for s in stretches(self.values(unpack(packed)), self.shape, True):
            for which, times in ((light, 1), (heavy, 2)):
                if (chosen := isin(s.a, which)).any():
                    found += [s.window_hashes(s.windows(chosen))] * times
        return (few(np.concatenate(found), self.most),)

    def open_phrases(self, packed: bytes | None, light: np.ndarray, heavy: np.ndarray) -> tuple[list[int], list[bytes], list[int]]:
        """Key, bytes and weight of open phrases."""
        text, out = unpack(packed), {}
        for s in stretches(self.values(text), self.shape):
            for which, weight in ((light, 1), (heavy, 2)):
                for k in np.flatnonzero(isin(s.a, which)).tolist():
                    out[text[s.at + s.first[k]:s.at + s.last[k] + self.shape.window]] = (int(s.keys[k]), weight)
        return [k for k, _ in out.values()], list(out), [w for _, w in out.values()]

    def remove(self, packed: bytes | None, dropped: np.ndarray, windows: np.ndarray) -> tuple[int, int, int, str]:
        text = unpack(packed)
        values = self.values(text)
        change = np.zeros(len(values) + 1, np.int64)
        for s in stretches(values, self.shape):
            whole = isin(s.a, dropped)
            starts = s.windows(whole)
            if len(windows):
                every = np.arange(s.last[-1] + 1)
                starts = np.union1d(starts, every[isin(s.rolls[0].of(every, every + self.shape.window).view(np.int64), windows)])
            starts = starts + s.at
            np.add.at(change, starts, 1)
            np.add.at(change, starts + self.shape.window, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
        return len(values), int(gone.sum()), spans, self.digest(text, ~gone if spans else None)


def pack(text: bytes | None) -> tuple[bytes | None]:
    return (None if text is None else zstandard.compress(text, 3),)


def unpack(packed: bytes | None) -> bytes:
    return zstandard.decompress(packed) if packed else b""


def compare_phrases(kind: Kind):
    """The windows that occur more than once among the phrases of a group of keys, told to the phrases that stand alone.

    The windows of the group's dictionary are sorted by name; equal names are neighbours.
    """

    def run(group: pa.Table) -> pa.Table:
        size = kind.shape.window
        texts = group["phrase"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        lengths = np.array([len(t.as_buffer()) for t in texts], np.int64)
        rolls = [Rolling(kind.values(b"".join(t.as_py() for t in texts)), b) for b in BASES]
        first = np.cumsum(lengths) - lengths
        starts = ranges(first, first + lengths - size + 1)
        owner = np.repeat(np.arange(len(lengths)), lengths - size + 1)
        w, v = (r.of(starts, starts + size).view(np.int64) for r in rolls)
        order = np.lexsort((v, w))
        new = np.ones(len(order), bool)
        new[1:] = (w[order][1:] != w[order][:-1]) | (v[order][1:] != v[order][:-1])
        name = np.cumsum(new) - 1
        weight = group["weight"].to_numpy()
        total = np.bincount(name, weight[owner[order]])
        again = np.zeros(len(order), bool)
        again[order] = total[name] > 1
        again &= weight[owner] == 1
        found = np.unique(np.stack([group["id"].to_numpy()[owner[again]], w[again]], 1), axis=0)
        return pa.table({"id": pa.array(found[:, 0], pa.int64()), "w": pa.array(found[:, 1], pa.int64())})

    run.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return run


LONGS = pa.list_(pa.int64())
PHRASES = pa.list_(pa.struct([(n, pa.int64()) for n in ("key", "a", "b")]))
WINDOWS = pa.list_(pa.struct([(n, pa.int64()) for n in ("w", "v")]))


def remove_repeats(docs: DataFrame, kind: Kind, label: str) -> DataFrame:
    """``id, n, n_removed, n_spans, kept`` of each row of ``id, text``.

    Rows of equal id may differ: what is sent back to a row are hashes, never places.
    """
    earlier = kind.shape.mode == "earlier"
    usable = F.col("id").isNotNull() if earlier else F.lit(True)

    # keys that more than one phrase begins with
    keys = text_udf(kind.keys, {"keys": LONGS})
    marks = materialize(docs.where(usable).select("id", F.explode(keys(F.col("text"))["keys"]).alias("key")), f"{label}-marks")
    several = F.min("id") < F.max("id") if earlier else F.count(F.lit(1)) > 1
    shared = materialize(marks.groupBy("key").agg(several.alias("shared")).where("shared").select("key"), f"{label}-keys")
    wanted = marks.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("keys"))

    # their phrases; the texts are moved once here, packed, and later only those that hold such phrases
    squeeze = text_udf(pack, {"text": pa.binary()})
    phrases = text_udf(kind.phrases, {"n": pa.int64(), "phrases": PHRASES, "kept": pa.string()}, 1)
    packed = docs.select("id", squeeze(F.col("text"))["text"].alias("text"))
    parsed = packed.join(wanted, "id", "left").select("id", "text", phrases(F.col("text"), F.col("keys")).alias("p"))
    parsed = parsed.select("id", F.when(F.col("p.kept").isNull(), F.col("text")).alias("text"), "p.*")
    parsed = materialize(parsed, f"{label}-parsed")
    touched = parsed.where(F.col("kept").isNull()).select("id", "text", "phrases")

    # the dictionary of distinct phrases, with the least id and the number of their places
    rows = touched.select("id", F.explode("phrases").alias("p")).select("id", "p.*")
    words = materialize(rows.groupBy("key", "a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), f"{label}-words")
    mixed = materialize(words.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{label}-mixed")
    words = materialize(words.join(mixed, "key", "left").select("key", "a", "b", "least", "n", "size"), f"{label}-dictionary")

    drop = F.col("least") < F.col("id") if earlier else F.col("n") > 1
    stays = F.col("size").isNotNull() & F.col("id").eqNullSafe(F.col("least"))
    grouped = (F.col("size") <= GROUP) if kind.sends else F.lit(False)
    light = stays if earlier else stays & ~drop
    heavy = F.lit(False) if earlier else stays & drop
    verdict = rows.join(words, ["key", "a", "b"]).where(drop | stays)
    pick: Callable[[Column], Column] = lambda c: F.collect_set(F.when(c, F.col("a")))
    sets = {"drop": drop, "light": light & ~grouped, "heavy": heavy & ~grouped, "lone": light & grouped, "twin": heavy & grouped}
    verdict = materialize(verdict.groupBy("id").agg(*[pick(c).alias(k) for k, c in sets.items()]), f"{label}-verdict")

    # single windows of the phrases that are still open
    opened = text_udf(kind.open_windows, {"windows": WINDOWS}, 2)
    still = verdict.where((F.size("light") > 0) | (F.size("heavy") > 0)).select("id", "light", "heavy")
    single = touched.select("id", "text").join(still, "id").select("id", opened(F.col("text"), F.col("light"), F.col("heavy"))["windows"].alias("ws"))
    single = materialize(single, f"{label}-windows").select("id", F.explode("ws").alias("x")).select("id", "x.*")
    if earlier:
        least = materialize(single.groupBy("w", "v").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w", "v", "least"), f"{label}-repeated")
        found = single.join(least, ["w", "v"]).where("least < id")
    else:
        often = materialize(single.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "v"), f"{label}-repeated")
        found = single.join(often, ["w", "v"])
    found = found.select("id", "w")
    if kind.sends:
        sent = text_udf(kind.open_phrases, {"key": LONGS, "phrase": pa.list_(pa.binary()), "weight": LONGS}, 2)
        few_ = verdict.where((F.size("lone") > 0) | (F.size("twin") > 0)).select("id", "lone", "twin")
        n = few_.agg(F.sum(F.size("lone") + F.size("twin"))).first()[0] or 0
        pieces = touched.select("id", "text").join(few_, "id").select("id", sent(F.col("text"), F.col("lone"), F.col("twin")).alias("p"))
        pieces = pieces.select("id", F.explode(F.arrays_zip("p.key", "p.phrase", "p.weight")).alias("p")).select("id", "p.phrase", "p.weight", F.pmod("p.key", F.lit(n // BUCKET + 1)).alias("bucket"))
        found = found.unionByName(pieces.groupBy("bucket").applyInArrow(compare_phrases(kind), "id bigint, w bigint"))
    found = found.groupBy("id").agg(F.collect_set("w").alias("ws"))

    remove = text_udf(kind.remove, {"n": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string()}, 2)
    told = verdict.select("id", "drop").join(found, "id", "left")
    cut = touched.select("id", "text").join(told, "id", "left").select("id", remove(F.col("text"), F.col("drop"), F.col("ws")).alias("r")).select("id", "r.*")
    whole = parsed.where(F.col("kept").isNotNull()).select("id", "n", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), "kept")
    return whole.unionByName(cut)


def byte_values(text: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(text, np.uint8)]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_digest(text: bytes, kept: np.ndarray | None) -> str:
    return hashlib.sha256(text if kept is None else np.frombuffer(text, np.uint8)[kept].tobytes()).hexdigest()


def bytes_kind(shape: Shape) -> Kind:
    return Kind(byte_values, byte_digest, shape, True)


