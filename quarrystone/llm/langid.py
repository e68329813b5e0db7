"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are read in one go; the state starts anew with each chunk, in training and in prediction.
CHUNK = 64
#: Chunks that are worked on at once.
LANES = 2048
HIDDEN = 8
_LETTER = re.compile(rb"[A-Za-z]")


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): the squashing function of the network; its slope is (1 - |soft|) ** 2."""
    return x / (1 + np.abs(x))


def slope(s: np.ndarray) -> np.ndarray:
    return np.square(1 - np.abs(s))


@dataclass
class Network:
    """``inputs`` and ``loops`` of either direction, gates stacked as reset, update, candidate; then the labels' weights."""

    labels: list[str]
    inputs: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        return cls(labels, [draw(3 * hidden, 256) for _ in range(2)], [draw(3 * hidden, hidden) for _ in range(2)], draw(len(labels), 2 * hidden), np.zeros((len(labels), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.loops, self.out, self.bias]

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states at each position: ``data`` is chunk length by lanes, the result positions, both directions' states, lanes."""
        steps, lanes = data.shape
        hidden = self.loops[0].shape[1]
        states = np.empty((steps, 2 * hidden, lanes), np.float32)
        for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            h, w, u = np.zeros((hidden, lanes), np.float32), self.inputs[d], self.loops[d]
            for t in order:
                x, g = np.take(w, data[t], axis=1), u @ h
                gates = 0.5 + 0.5 * soft(x[: 2 * hidden] + g[: 2 * hidden])
                r, z = gates[:hidden], gates[hidden:]
                n = soft(x[2 * hidden:] + r * g[2 * hidden:])
                if keep is not None:
                    keep.append((d, t, h, r, z, n, g[2 * hidden:]))
                h = n + z * (h - n)
                states[t, d * hidden:(d + 1) * hidden] = h
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each label at each position: positions, labels, lanes."""
        scores = np.matmul(self.out, states) + self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, truth: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean log loss over the positions in ``mask``."""
        keep: list = []
        states = self.states(data, keep)
        delta = self.probabilities(states)
        delta[:, truth, np.arange(len(truth))] -= 1
        delta *= mask[:, None] / mask.sum()
        d_out, d_bias = np.einsum("tkb,thb->kh", delta, states), delta.sum((0, 2))[:, None]
        d_states = np.matmul(self.out.T, delta)
        hidden = self.loops[0].shape[1]
        d_inputs, d_loops = [np.zeros((256, 3 * hidden), np.float32) for _ in range(2)], [np.zeros_like(u) for u in self.loops]
        carried = [np.zeros((hidden, len(truth)), np.float32) for _ in range(2)]
        for d, t, h, r, z, n, g in reversed(keep):
            dh = carried[d] + d_states[t, d * hidden:(d + 1) * hidden]
            dn = dh * (1 - z) * slope(n)
            dz = dh * (h - n) * 0.5 * slope(2 * z - 1)
            dr = dn * g * 0.5 * slope(2 * r - 1)
            back = np.concatenate([dr, dz, dn * r])
            d_loops[d] += back @ h.T
            carried[d] = dh * z + self.loops[d].T @ back
            np.add.at(d_inputs[d], data[t], np.concatenate([dr, dz, dn]).T)
        return [*(x.T for x in d_inputs), *d_loops, d_out, d_bias]

    def train(self, data: np.ndarray, truth: np.ndarray, mask: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam; the batches are drawn from a seeded generator, so the same sample gives the same network."""
        r, ws = np.random.default_rng(seed), self.weights()
        first, second = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
        for step in range(1, steps + 1):
            at = r.integers(0, len(truth), batch)
            for w, g, m, v in zip(ws, self.gradients(data[:, at], truth[at], mask[:, at]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts as columns of ``CHUNK`` bytes, padded with zeros, and the number of bytes in each."""
    sizes = [min(CHUNK, len(t) - at) for t in texts for at in range(0, len(t), CHUNK)]
    padded = b"".join(t.ljust(-(-len(t) // CHUNK) * CHUNK, b"\0") for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(-1, CHUNK).T, np.array(sizes, np.int64)


def filled(sizes: np.ndarray) -> np.ndarray:
    return (np.arange(CHUNK)[:, None] < sizes).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows_per_lang: int, chunks_per_row: int) -> list[tuple[str, bytes]]:
    """At most ``rows_per_lang`` labelled rows of each language, ``chunks_per_row`` pieces of ``CHUNK`` bytes spread over each.

    The rows are those of least hash; each task sends no more than its least ones.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang", rank.alias("rank")).where(F.col("rank") <= rows_per_lang).select("doc_id").distinct()
    # as many ids as languages times rows: the bound holds at any size of the table
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", F.xxhash64("doc_id").alias("h"), F.encode("text", "UTF-8").alias("t"))
    last = F.greatest(F.octet_length("t") - CHUNK, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(chunks_per_row - 1)), lambda k: F.substring("t", F.floor(k * last / max(chunks_per_row - 1, 1)).cast("int") + 1, F.lit(CHUNK)))
    got = rows.select("lang", "h", pieces.alias("p")).collect()
    return sorted((r.lang, bytes(p)) for r in got for p in r.p if p)


def fit(docs: DataFrame, rows_per_lang: int = 200, chunks_per_row: int = 8, hidden: int = HIDDEN, steps: int = 250, batch: int = 256, rate: float = 0.03, seed: int = 1) -> Network | None:
    """A network trained on a bounded sample, see :func:`sample`; None if there is no labelled text."""
    rows = sample(docs, rows_per_lang, chunks_per_row)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    data, sizes = chunked([p for _, p in rows])
    network = Network.new(labels, hidden, seed)
    network.train(data, np.array([labels.index(lang) for lang, _ in rows]), filled(sizes), steps, batch, rate, seed)
    return network


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def label(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each label over all positions of each non-empty text: texts by labels."""
    data, sizes = chunked(texts)
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // CHUNK) for t in texts])
    pooled = np.zeros((len(texts), len(network.labels)))
    for at in range(0, len(sizes), LANES):
        part = slice(at, at + LANES)
        found = np.einsum("tkb,tb->bk", network.probabilities(network.states(data[:, part])), filled(sizes[part]))
        np.add.at(pooled, owner[part], found)
    return pooled / np.array([[len(t)] for t in texts])


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: Bytes of text that are labelled together.
GROUP_BYTES = 1 << 20


def predictor(network: Network | None):
    def run(texts: pa.Array) -> pa.Array:
        names, scores, group, room = ["und"] * len(texts), [0.0] * len(texts), [], GROUP_BYTES

        def flush():
            if group:
                p = label(network, [t for _, t in group])
                for (i, _), k, s in zip(group, p.argmax(1), p.max(1), strict=True):
                    names[i], scores[i] = network.labels[k], min(1.0, float(s))
                group.clear()

        for i, t in enumerate(texts.cast(pa.binary()) if network else ()):
            text = t.as_buffer().to_pybytes() if t.is_valid else b""
            if has_letter(text):
                group.append((i, text))
                room -= len(text)
                if room <= 0:
                    flush()
                    room = GROUP_BYTES
        flush()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, PREDICTION)


def identify(docs: DataFrame, network: Network | None = None, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    The network, fitted here if none is given, labels every byte of the text; the document's probabilities are the
    mean over its positions and ``score`` is the largest.  ``und`` with score 0 if the text is null, has no letter, or nothing
    was there to learn from.  Only text and ``lang`` are learned from, of rows that are not held out; a null
    ``doc_id`` is not held out, but not learned from either.  Repeated rows get equal predictions.
    """
    network = network or fit(docs.select("doc_id", "text", "lang"), **options)
    found = docs.select("doc_id", predictor(network)(F.col("text")).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
