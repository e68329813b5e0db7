"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: The white space that parts words: space and \t \n \v \f \r, which is also what ``bytes.split`` takes.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that continue a code point in UTF-8.
TAIL = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_udf(fn: Callable[..., tuple], kinds: dict[str, pa.DataType], lists: int = 0) -> Callable[..., Column]:
    """An Arrow function of a text column and ``lists`` columns of bigint arrays that returns a struct.

    ``fn`` gets a whole text as UTF-8 (``None`` for null) and a numpy array for each list (empty for null).
    """
    names, types = list(kinds), list(kinds.values())

    def each(texts: pa.Array, *more: pa.Array) -> pa.Array:
        # one text at a time: a batch of very long texts is never held twice
        rows = []
        for i, t in enumerate(texts.cast(pa.binary())):
            given = [m[i].values.to_numpy() if m[i].is_valid else np.zeros(0, np.int64) for m in more]
            rows.append(fn(t.as_buffer().to_pybytes() if t.is_valid else None, *given))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([arrow_column(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run0(t):
        return each(t)

    def run1(t, a):
        return each(t, a)

    def run2(t, a, b):
        return each(t, a, b)

    run = (run0, run1, run2)[lists]
    # Spark tells the kind of function by its annotations
    run.__annotations__ = dict.fromkeys(["t", "a", "b"][: lists + 1] + ["return"], pa.Array)
    return F.arrow_udf(run, T.StructType([T.StructField(n, from_arrow_type(t)) for n, t in kinds.items()]))


def arrow_column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values of a column; lists are given as numpy arrays, lists of structs as two-dimensional ones."""
    if not pa.types.is_list(kind) or pa.types.is_binary(kind.value_type):
        return pa.array(values, kind)
    ends = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    inner = kind.value_type
    if pa.types.is_struct(inner):
        flat = np.concatenate([np.zeros((0, inner.num_fields), np.int64), *values])
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(inner.num_fields)], [f.name for f in inner]))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


#: Bytes of text that are cut into words at a time: a word list takes ten times the room of its text.
PIECE = 1 << 20
_BREAK = re.compile(rb"[ \t-\r]")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text of any length, in lists of bounded size; there may be none."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        if words := text[at:end].split():
            yield words
        at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of a text."""
    return np.concatenate([np.zeros(0, np.uint64), *map(word_hashes, word_pieces(text))])


#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits over all bits (the final step of a common 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, after one pass over it."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, size: int) -> np.ndarray:
        """The hash of each run of ``size`` values, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def least_positions(values: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` values the position of its least one (the first of equals)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        keep = best[:-step] <= best[step:]
        best, at = np.where(keep, best[:-step], best[step:]), np.where(keep, at[:-step], at[step:])
        span += step
    return at


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """True for each of ``n`` places that a run of ``size`` places from one of ``starts`` covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:n]) > 0


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores added until none is a column of ``df``; Spark compares without case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]
