"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_udf

#: Tokens of a sequence, and the id that ends each document.
SIZE, END = 1024, 0
#: A piece of n tokens costs n * (1 + n / PIVOT): linear layers plus attention, which are equal at n = PIVOT.
PIVOT = 1024
#: Documents that are packed together.  Each such shard fills its sequences to the last token, so shards cost no padding.
SHARD = 8192
#: Characters that are tokenised at a time, and words whose ids a worker remembers.
STRETCH, KNOWN = 1 << 20, 1_000_000
#: Characters of the longest word that is remembered.
LONG = 64

_CUT = re.compile(r"(?<=\S)(?=\s)")
_RUN = re.compile(r"\s\s")
#: Letters and the marks behind them: to the tokenizer's pattern one word and another, in any version of Unicode.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """The letters for which bytes stand in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*shown, *(b for b in range(256) if b not in set(shown))], map(chr, [*shown, *range(256, 512)])))


class Spaced(dict):
    """Ids of words behind a blank, by the words without it."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> bytes:
        return self.words.keep(self, word, self.words.asked(self, " ", word))


class Words(dict):
    """Ids of words as bytes, each asked of the tokenizer once; forgets all when it is full."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) + ")")

        self.letters = byte_letters()
        self.model = self.tokenizer.model if self.parts_plainly() else None
        self.spaced, self.line_end = Spaced(self), self.encoded("\n")

    def parts_plainly(self) -> bool:
        """Whether the model gets words as the pattern parts them, by bytes, and nothing else is done to them."""
        t, probe = self.tokenizer, " Añ.,"
        if t.normalizer or t.truncation or t.padding or not t.pre_tokenizer or type(t.model).__name__ != "BPE":
            return False
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(probe)] == [self.spelt(" Añ"), self.spelt(".,")]

    def spelt(self, word: str) -> str:
        return word.encode().decode("latin1").translate(self.letters)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def encoded(self, word: str) -> bytes:
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def asked(self, known: dict, before: str, word: str) -> bytes:
        """Ids of a word behind ``before``: its letters are asked of the model alone, and known without their marks."""
        plain = _PLAIN.fullmatch(word) if self.model else None
        if not plain:
            return self.encoded(before + word)
        letters, marks = plain.groups()
        return known[letters] + self[marks] if marks else self.packed([t.id for t in self.model.tokenize(self.spelt(before + letters))])

    def keep(self, known: dict, word: str, ids: bytes) -> bytes:
        if len(word) <= LONG:
            if len(self) + len(self.spaced) >= KNOWN:
                self.clear()
                self.spaced.clear()
            known[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        return self.keep(self, word, self.asked(self, "", word))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Where no white space follows another, a word of the pattern begins at every blank, and before and behind every
        line end: the text is parted there, and only its other words by the pattern.
        """
        if _RUN.search(text):
            return b"".join(map(self.__getitem__, self.find(text)))
        lines = []
        for line in text.split("\n"):
            first, *more = line.split(" ")
            lines.append((self[first] if first else b"") + b"".join(map(self.spaced.__getitem__, more)))
        return self.line_end.join(lines)

    def ids(self, text: str) -> bytes:
        """As the tokenizer gives them for the whole ``text``: it never joins what its pattern parts."""
        parts = self.special.split(text)  # special tokens at the odd places
        return b"".join(self[p] if i % 2 else self.plain(p) for i, p in enumerate(parts) if p)


@lru_cache(1)
def words_of(path: str | None) -> Words:
    return Words(path)


def stretches(text: str) -> Iterator[str]:
    """A text of any length in parts that are tokenised apart: a word begins wherever space follows something else."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def crc(ids: bytes, kind: str) -> int:
    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())


def tokenised(text: bytes | None, path: str | None, size: int) -> tuple[int, np.ndarray, bytes]:
    """Number of ids, checksums of the whole pieces of ``size``, and the ids that are left over."""
    words = words_of(path)
    width = np.dtype(words.kind).itemsize
    n, crcs, rest = 0, [], b""
    end = np.array([END], words.kind).tobytes()
    for ids in (*map(words.ids, stretches((text or b"").decode("utf-8", "replace"))), end):
        n += len(ids) // width
        rest += ids
        whole = len(rest) // (size * width) * size * width
        crcs += [crc(rest[a:a + size * width], words.kind) for a in range(0, whole, size * width)]
        rest = rest[whole:]
    return n, np.array(crcs, np.int64), rest


def capacities(tokens: int, size: int) -> list[int]:
    """Whole sequences, and a power of two for each bit of what is left: none of them needs padding."""
    left = tokens % size
    return [size] * (tokens // size) + [1 << b for b in range(left.bit_length())[::-1] if left >> b & 1]


def assign(lengths: list[int], rooms: list[int], pivot: int = PIVOT) -> list[tuple[int, int, int, int, int]]:
    """``item, start, length, sequence, offset`` of pieces of the items; ``rooms`` have space for all of them.

    Items go in descending order of cost, each to the sequence of least cost that has room for it.  One that fits nowhere
    fills the largest room there is, and what it leaves takes its turn among the items of that length.
    """
    most = max([*lengths, *rooms, 1])
    turn: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
    for i, n in enumerate(lengths):
        turn[n].append((i, 0))
    with_room: list[list[tuple[float, int]]] = [[] for _ in range(most + 1)]  # by room left: heaps of (cost, sequence)
    for s, room in enumerate(rooms):
        heappush(with_room[room], (0.0, s))
    least = np.array([h[0][0] if h else np.inf for h in with_room])
    out = []
    for n in range(most, 0, -1):
        for item, start in turn[n]:
            room = n + int(least[n:].argmin())
            if not with_room[room]:
                room = int(np.flatnonzero(np.isfinite(least[1:n]))[-1]) + 1
            take = min(n, room)
            cost, s = heappop(with_room[room])
            least[room] = with_room[room][0][0] if with_room[room] else np.inf
            out.append((item, start, take, s, rooms[s] - room))
            if take < room:
                heappush(with_room[room - take], (cost + take * (1 + take / pivot), s))
                least[room - take] = with_room[room - take][0][0]
            if take < n:
                turn[n - take].append((item, start + take))
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_shard(rows: pa.Table, size: int, pivot: int) -> pa.Table:
    """The pieces of a shard's documents; sequences are numbered from the shard's own number times 2**32."""
    if not rows.num_rows:
        return PIECES.empty_table()
    ids, tokens = rows["doc_id"].to_pylist(), rows["n"].to_numpy()
    rest, crcs = rows["rest"].to_pylist(), rows["crcs"].to_pylist()
    lengths = (tokens % size).tolist()
    rooms = capacities(sum(lengths), size)
    base, out = rows["shard"][0].as_py() << 32, []
    for item, start, length, s, offset in assign(lengths, rooms, pivot):
        width = len(rest[item]) // lengths[item]
        ids_crc = crc(rest[item][start * width:(start + length) * width], f"<u{width}")
        out.append((ids[item], int(tokens[item]) - lengths[item] + start, length, ids_crc, int(tokens[item]), base + s, offset))
    s = base + len(rooms)
    for item, whole in enumerate(crcs):
        for k, c in enumerate(whole):
            out.append((ids[item], k * size, size, c, int(tokens[item]), s, 0))
            s += 1
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)


def pack(docs: DataFrame, size: int = SIZE, pivot: int = PIVOT, vocabulary: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids, ended by ``END``, are cut into whole sequences of ``size`` and a rest.  Rests are dealt into shards of
    about ``shard`` documents; a shard assigns its rests by descending cost to its cheapest sequence with room (see
    :func:`assign`), cutting what fits nowhere, so that every sequence is full: ``size`` long, or for what is left of a shard
    a power of two.  ``vocabulary`` is a file of a ``tokenizers`` byte-level BPE, else the public one.

    A null or empty text is the closing id alone.  Repeated rows are packed as often as they are given, a null ``doc_id``
    stays null, other columns are not read.  A very long text is tokenised in stretches; only its checksums and its rest
    leave the row.  Rows are dealt by their place in the input, so no key or group of copies makes a shard large, and a
    task that runs again deals the same.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("a power of two is needed: shorter sequences are the powers below it")
    shards = max(1, -(-docs.count() // shard))
    cut = text_udf(partial(tokenised, path=vocabulary, size=size), {"n": pa.int64(), "crcs": pa.list_(pa.int64()), "rest": pa.binary()})
    rows = docs.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"), F.col("doc_id").cast("bigint").alias("doc_id"), cut(F.col("text")).alias("t"))

    def run(table: pa.Table) -> pa.Table:
        return pack_shard(table, size, pivot)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.select("shard", "doc_id", "t.*").groupBy("shard").applyInArrow(run, schema)
