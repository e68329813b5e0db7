"""Benchmark decontamination: one automaton over the test items, one pass over the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free_names, quoted

WINDOW = 10
#: Bytes to bytes: A-Z to a-z; what is not a letter, a digit or beyond ASCII to a space.  The length stays, so
#: a place in the normalised text is the same place in the original.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The most normalised item text, in bytes, that one automaton holds (some 100 MB in a Python worker).
PART_BYTES = 200_000


def windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    """The windows of an item, words joined and bounded by spaces."""
    words = (text or b"").translate(NORMAL).split()
    return {b" " + b" ".join(words[i:i + size]) + b" " for i in range(max(1, len(words) - size + 1))} if words else set()


class Scanner:
    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                # an item without an id is hit like any other, only there is no id to report
                owners.setdefault(w, set()).update([] if item is None else [item])
        self.found = ahocorasick.Automaton()
        for w, who in owners.items():
            # bytes as characters of equal number: offsets in characters are offsets in bytes
            self.found.add_word(w.decode("latin-1"), (len(w), tuple(sorted(who))))
        if owners:
            self.found.make_automaton()
        self.any = bool(owners)

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, set[str]]:
        """Number of words, their starts and ends in the original text, whether each is hit, and the items found."""
        flat = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
        edges = np.flatnonzero(np.diff(flat, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        hit, items = np.zeros(len(starts), bool), set()
        if self.any and len(starts):
            words = text.translate(NORMAL).split()
            joined = b" " + b" ".join(words) + b" "
            at = np.cumsum(ends - starts + 1) - (ends - starts)  # where each word starts in joined
            change = np.zeros(len(starts) + 1, np.int64)
            for last, (n, who) in self.found.iter(joined.decode("latin-1")):
                first = np.searchsorted(at, last - n + 2)
                change[first] += 1
                change[np.searchsorted(at, last)] -= 1
                items.update(who)
            hit = np.cumsum(change[:-1]) > 0
        return len(starts), starts, ends, hit, items


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(part, size: int) -> Scanner:
    """One automaton per Python worker and part."""
    key = (part.value[0], size)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(part.value[1], size)
    return _SCANNERS[key]


def item_parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in parts of ``part_bytes`` (or one longer item); there is at least one part.

    A part is given before the next is read, so a caller that sends it on holds one at a time.  The benchmark's size
    decides the number of passes, not what is found.
    """
    part, room = [], part_bytes
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.encode(F.col("text"), "UTF-8").alias("t")).where("t IS NOT NULL").toLocalIterator():
        size = len(r.t)
        if part and size > room:
            yield part
            part, room = [], part_bytes
        part.append((r.i, bytes(r.t)))
        room -= size
    yield part


SPANS_KIND = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "start", "end")]))
SPANS = "array<struct<word:bigint,start:bigint,end:bigint>>"
SCHEMA = f"n_words bigint, spans {SPANS}, items array<string>"


def scan_column(texts: Column, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> Column:
    """Array with, for each part of the benchmark, ``n_words``, ``spans`` (the hit words) and ``items``.
    """
    context = benchmark.sparkSession.sparkContext
    calls = []
    for rows in item_parts(benchmark, part_bytes):
        name = hashlib.sha256(repr(rows).encode()).hexdigest()
        calls.append(F.arrow_udf(_scan_with(context.broadcast((name, rows)), size), SCHEMA)(texts))
    return F.array(*calls)


def _scan_with(part, size: int):
    def run(texts: pa.Array) -> pa.Array:
        scanner = _scanner(part, size)
        out = []
        for t in texts.cast(pa.binary()):
            n, starts, ends, hit, items = scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"")
            w = np.flatnonzero(hit)
            out.append((n, np.stack([w, starts[w], ends[w]], 1), sorted(items)))
        n, spans, items = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), arrow_column(spans, SPANS_KIND), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of ``docs`` with one struct column more, the result's last.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  A window is ``size``
    consecutive words of an item, or the whole of a shorter one.  The struct has ``n_words``; ``spans``,
    the hit words of the text as ``word, start, end`` (byte offsets in the original text, end exclusive);
    and ``items``, the sorted ids of items of which a window occurs.

    Null and empty texts have no words and no hits; items of null text or without a word match nothing; an item of null id
    hits words but is not among ``items``; equal items are all reported.  No column of ``docs`` is changed, and no row moves.
    """
    raw, out = free_names(docs, "scan", "leak")
    scanned = docs.withColumn(raw, scan_column(F.col("text"), benchmark, size, part_bytes))
    r = F.col(raw)
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(r, lambda p: p["spans"]))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(r, lambda p: p["items"]))))
    return scanned.select(*quoted(docs.columns), F.struct(r[0]["n_words"].alias("n_words"), spans.alias("spans"), items.alias("items")).alias(out))


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row, and ``items``."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    x = F.col(found.columns[-1])
    n_hit = F.size(x["spans"]).cast("bigint")
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(x["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", x["items"]), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), x["items"].alias("items"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    found = find_leaks(docs, benchmark, **options)
    return found.where(F.size(F.col(f"{found.columns[-1]}.spans")) == 0).select(*quoted(docs.columns))
