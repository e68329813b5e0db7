"""BM25 as tables.

The index is partitioned by document: one part holds all postings of a document.  Texts are counted in
arrays, so no token becomes a row, and postings are written as they come, unsorted.  A search brings the postings of the asked terms, by slices of documents, to the weighted query
terms, so scores are complete inside a task and only the best ``top_k`` rows per query and slice are
shuffled.  A term that occurs in every document is spread over all parts and slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import fixed
from ..functions import text as T
from ..session import fresh_path, materialize
from . import ranks

K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.75, 0.25


STOP_WORDS = pa.array(fixed.STOP_WORDS)
#: The bytes of ``[a-z0-9]``.
TOKEN_BYTES = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Text counted at once in a task, and rows of a batch that it returns.
PIECE_BYTES, BATCH_ROWS = 8 << 20, 100_000
#: A matrix of scores has so many rows at most, and about so many columns: 40 MB.
BLOCK_QUERIES, SLICE_DOCS = 1000, 5000
#: Scores are compared at so many digits; bounds must not lose to rounding.
DIGITS, ROUNDING = 6, 1e-5
#: Terms of a query that set its floor: more make it higher and cost their postings twice.
SEEDS = 3


@dataclass
class SparseIndex:
    postings: DataFrame  # doc_id, term, tf, dl
    terms: DataFrame  # term, df, idf, most
    stats: DataFrame  # one row: n_docs, avgdl
    name: str
    buckets: int


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of (key, text) that are sorted by key: about ``PIECE_BYTES`` of text at once, and all rows of a key together."""
    rest = None
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // PIECE_BYTES, prepend=0))
        for start, end in pairwise([0, *cuts.tolist(), len(size)]):
            if start == end:
                continue
            part = pa.Table.from_batches([batch.slice(start, end - start)])
            part = (part if rest is None else pa.concat_tables([rest, part])).combine_chunks()
            code = part[0].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            whole = int(np.argmax(code == code[-1]))
            if whole:
                yield part.slice(0, whole)
            rest = part.slice(whole)
    if rest is not None:
        yield rest


def _tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of ``[a-z0-9]`` of a string column, and the row of each."""
    text = pc.cast(pc.fill_null(text, ""), pa.large_binary())
    text = pa.concat_arrays([text])  # a slice gets offsets of its own
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    ends = ends - ends[0]
    kept = TOKEN_BYTES[data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = kept[heads]  # no run goes from one text into the next
    at = np.flatnonzero(begins)
    offsets = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return words, np.searchsorted(ends, at, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of (key, lower-cased text) rows that are sorted by key: columns as of ``postings``."""
    for piece in _pieces(batches):
        keys = piece[0].combine_chunks().dictionary_encode("encode")
        words, row = _tokens(piece[1].combine_chunks())
        words = words.dictionary_encode()
        vocabulary = words.dictionary.cast(pa.string())
        kept = pc.and_(pc.greater(pc.binary_length(vocabulary), 1), pc.invert(pc.is_in(vocabulary, STOP_WORDS)))
        terms = T.stem(vocabulary).dictionary_encode()
        # the term of each word; of a dropped word none
        term = np.where(kept.to_numpy(zero_copy_only=False), terms.indices.to_numpy(), -1)[words.indices.to_numpy()]
        doc = keys.indices.to_numpy()[row][term >= 0].astype(np.int64)
        n = max(1, len(terms.dictionary))
        pairs, counts = np.unique(doc * n + term[term >= 0], return_counts=True)
        doc, lengths = pairs // n, np.bincount(doc, minlength=len(keys.dictionary))
        for k in range(0, len(pairs), BATCH_ROWS):
            mine = slice(k, k + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([
                keys.dictionary.take(pa.array(doc[mine])), terms.dictionary.take(pa.array(pairs[mine] % n)), pa.array(counts[mine]), pa.array(lengths[doc[mine]]),
            ], ["key", "term", "tf", "dl"])


def postings(docs: DataFrame, text: str = "text", parts: int | None = None, key: str = "doc_id") -> DataFrame:
    """``key, term, tf, dl``: counts of the kept tokens (no stop words, stemmed) per document, and their sum.

    The texts are hashed by document, which is the only shuffle; tokens are then counted where they lie, and none becomes a row.
    """
    spread = docs.select(key, F.lower(text).alias("text"))
    spread = spread.repartition(parts, key) if parts else spread.repartition(key)
    schema = StructType([spread.schema[key], *(StructField(n, t) for n, t in (("term", StringType()), ("tf", LongType()), ("dl", LongType())))])
    return spread.sortWithinPartitions(key).mapInArrow(_counted, schema)


def term_stats(counted: DataFrame, n_docs: Column) -> DataFrame:
    """Idf beside document frequencies; a negative idf becomes a share of the mean idf."""
    raw = counted.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.select(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, mean * NEGATIVE_IDF_SHARE).otherwise(F.col("raw")).alias("idf"), "most")


def build_index(docs: DataFrame, text: str = "text", buckets: int | None = None) -> SparseIndex:
    """Build and store the index.  Documents without kept tokens still count in ``n_docs``.

    There are as many parts (``buckets``) as the texts are read in splits, and as the session has shuffle partitions at least, so
    a part is about as large as a split.
    """
    spark = docs.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    name = f"postings_{uuid.uuid4().hex}"
    _store(docs, text, buckets, name, fresh_path(spark, "postings"))
    return _summaries(spark, name, buckets, docs.agg(F.count(F.lit(1)).alias("n_docs")))


def add_documents(index: SparseIndex, docs: DataFrame, text: str = "text") -> SparseIndex:
    """The index with further documents: their postings are appended, and the two small tables made anew.

    The given index must not be used any more: it reads the longer table with its old statistics.
    """
    _store(docs, text, index.buckets, index.name, None)
    n = index.stats.select("n_docs").scalar()
    return _summaries(docs.sparkSession, index.name, index.buckets, docs.agg((F.count(F.lit(1)) + n).alias("n_docs")))


def drop_index(index: SparseIndex) -> None:
    """Take the postings out of the catalog; their files stay in the shared folder."""
    index.postings.sparkSession.sql(f"DROP TABLE IF EXISTS {index.name}")


def _store(docs: DataFrame, text: str, buckets: int, name: str, path: str | None) -> None:
    writer = postings(docs, text, buckets).write.mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def _factor(avgdl: Column) -> Column:
    """What a posting brings to a score, for a weight of one."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def _summaries(spark: SparkSession, name: str, buckets: int, size: DataFrame) -> SparseIndex:
    stored = spark.table(name)
    stats = materialize(
        stored.agg(F.sum("tf").alias("tokens")).select(size.scalar().alias("n_docs"), (F.col("tokens") / size.scalar()).alias("avgdl")),
        "sparse-stats",
    )
    # a hot term is reduced map-side; written out, since the mean idf and each idf both need it
    factor = _factor(stats.select("avgdl").scalar())
    counted = materialize(stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(factor).alias("most")), "sparse-counts")
    terms = materialize(term_stats(counted, stats.select("n_docs").scalar()), "sparse-terms")
    return SparseIndex(stored, terms, stats, name, buckets)


def query_weights(queries: DataFrame, index: SparseIndex) -> DataFrame:
    """``qid, term, weight``: idf times the number of times the query repeats the term."""
    terms = postings(queries, "query", key="qid")
    return terms.join(index.terms, "term").select("qid", "term", (F.col("idf") * F.col("tf")).alias("weight"))


# --- queries in blocks meet documents in slices --------------------------------------------


def _places(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids in order, and the place of each given one among them."""
    coded = pc.dictionary_encode(ids.combine_chunks(), null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def _by_term(terms: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """The rows of each term."""
    order = np.argsort(terms, kind="stable")
    names, starts = np.unique(terms[order], return_index=True)
    return dict(zip(names.tolist(), zip(*(np.split(c[order], starts[1:]) for c in columns), strict=True), strict=True)) if len(names) else {}


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, document places and rounded scores of the best ``k`` positive ones per query; of equal scores the first documents."""
    scores = np.round(scores, DIGITS)
    kept = scores > 0
    if scores.shape[1] > k:
        kept &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    row, col = np.nonzero(kept)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], scores[row[first], col[first]]


def _match(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """A block of query terms on a slice of postings: the best ``k`` documents per query, and per query (without a document) the postings scored.

    Terms marked weak are scored last, and only in documents that one of the query's other terms found and that its weak terms
    could lift over its floor.
    """
    qids, q = _places(asked["qid"])
    doc_ids, d = _places(held["doc_id"])
    t, part = held["t"].to_numpy(), held["part"].to_numpy()
    # a document that was added twice has its postings summed
    order = np.lexsort((d, t))
    t, d, part = t[order], d[order], part[order]
    new = np.flatnonzero(np.r_[len(t) > 0, (t[1:] != t[:-1]) | (d[1:] != d[:-1])][: len(t)])
    found = _by_term(t[new], d[new], np.add.reduceat(part, new)) if len(new) else {}
    weak = asked["weak"].to_numpy(zero_copy_only=False).astype(bool)
    lift, floor = np.zeros(len(qids)), np.full(len(qids), -np.inf)
    np.add.at(lift, q[weak], asked["lift"].to_numpy()[weak])
    known = asked["floor"].is_valid().to_numpy()
    floor[q[known]] = asked["floor"].to_numpy()[known]

    scores = np.zeros((len(qids), len(doc_ids)))
    read = np.zeros(len(qids), np.int64)
    open_ = np.zeros(scores.shape, bool) if weak.any() else None
    for late in (False, True):
        mine = weak == late
        if late and open_ is not None:
            open_ &= scores + lift[:, None] >= floor[:, None] - ROUNDING
        for term, (qs, ws) in _by_term(asked["t"].to_numpy()[mine], q[mine], asked["weight"].to_numpy()[mine]).items():
            if term not in found:
                continue
            ds, ps = found[term]
            at, more = np.ix_(qs, ds), np.outer(ws, ps)
            if late:
                hit = open_[at]
                more *= hit
                read[qs] += hit.sum(axis=1)
            else:
                read[qs] += len(ds)
                if open_ is not None:
                    open_[at] = True
            scores[at] += more
    if open_ is not None:
        # a document below the floor is left without its weak terms, and cannot be among the best
        scores[~open_] = 0
    row, col, best = _best(scores, k)
    every = np.arange(len(qids))
    return pa.table({
        "qid": qids.take(pa.array(np.r_[row, every])),
        "doc_id": pa.concat_arrays([doc_ids.take(pa.array(col)), pa.nulls(len(every), doc_ids.type)]),
        "score": pa.array(np.r_[best, np.zeros(len(every))]),
        "postings": pa.array(np.r_[np.zeros(len(row), np.int64), read]),
    })


def _matches(weights: DataFrame, index: SparseIndex, top_k: int) -> DataFrame:
    """``qid, doc_id, score, postings`` by slice of documents, as ``_match`` has them.

    ``weights(qid, term, weight, weak, lift, floor)`` is a written table.  Blocks and slices are of bounded size, whatever the number of queries and
    documents; a slice gets the postings of a block's terms only.
    """
    queries = weights.select("qid").distinct().count()
    held = index.postings.where(F.col("doc_id").isNotNull())
    blocks, slices = max(1, -(-queries // BLOCK_QUERIES)), max(1, -(-index.stats.first().n_docs // SLICE_DOCS))
    numbered = weights.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    # written out, so numbers are fixed and the planner knows the size: few terms are broadcast, many joined
    terms = materialize(numbered.select("b", "term").distinct().withColumn("t", F.monotonically_increasing_id()), "query-terms")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
    asked = numbered.join(terms, ["b", "term"]).select("b", every.alias("s"), "qid", "t", "weight", "weak", "lift", "floor")
    part = _factor(index.stats.select("avgdl").scalar())
    # both sides of the cogroup come from the numbered terms, so one has new names of its own
    held = held.join(terms, "term").select(F.col("b").alias("b"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("s"), "doc_id", F.col("t").alias("t"), part.alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _match(left, right, top_k)

    schema = StructType([weights.schema["qid"], held.schema["doc_id"], StructField("score", DoubleType()), StructField("postings", LongType())])
    return asked.groupBy("b", "s").cogroup(held.groupBy("b", "s")).applyInArrow(run, schema)


def _best_of(matches: DataFrame, top_k: int) -> DataFrame:
    return ranks.top_per_group(matches.where("doc_id IS NOT NULL").select("qid", "doc_id", "score"), ["qid"], [F.desc("score"), F.asc("doc_id")], top_k)


def _plain(weights: DataFrame) -> DataFrame:
    """No term is weak."""
    return weights.select("qid", "term", "weight", F.lit(False).alias("weak"), F.lit(0.0).alias("lift"), F.lit(None).cast("double").alias("floor"))


def search(queries: DataFrame, index: SparseIndex, top_k: int = 10) -> DataFrame:
    """``qid, doc_id, score, rank`` (from 1): positive scores only, ties by document."""
    weights = materialize(_plain(query_weights(queries, index)), "query-weights")
    return _best_of(_matches(weights, index, top_k), top_k)




def term_bounds(index: SparseIndex) -> DataFrame:
    """``term, most``: the greatest factor that any document has for a term."""
    return index.terms.select("term", "most")


def bounded_search(queries: DataFrame, index: SparseIndex, bounds: DataFrame, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """As ``search``, without scoring most postings of common terms; and ``qid, postings, skipped``: those scored and those not.

    A query's ``SEEDS`` strongest terms, by the most they can bring to a score, are scored first: the ``top_k``-th document's
    sum is a floor that the result cannot fall below.  The weakest terms whose bounds together stay under it cannot lift a
    document into the result alone, so only documents with one of the other terms are candidates, and of those only
    the ones that the weak terms' bounds could lift over the floor.  Only they look up their weak terms.  Hits are exact.
    """
    lifted = query_weights(queries, index).join(bounds, "term").withColumn("lift", F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)))
    by_lift = Window.partitionBy("qid").orderBy("lift", "term")
    # terms of one question are few: its words
    terms = materialize(lifted.withColumns({"below": F.sum("lift").over(by_lift), "place": F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lift"), "term"))}), "bounded-terms")

    seeds = materialize(_plain(terms.where(F.col("place") <= SEEDS)), "bounded-seeds")
    top = _best_of(_matches(seeds, index, top_k), top_k)
    floor = materialize(top.where(F.col("rank") == top_k).select("qid", F.col("score").alias("floor")), "bounded-floor")
    split = terms.join(floor, terms["qid"].eqNullSafe(floor["qid"]), "left").drop(floor["qid"])
    split = split.withColumn("weak", F.coalesce(F.col("below") < F.col("floor") - ROUNDING, F.lit(False)))
    split = materialize(split.select("qid", "term", "weight", "weak", "lift", "floor"), "bounded-split")

    matches = materialize(_matches(split, index, top_k), "bounded-matches")
    all_ = split.join(index.terms.select("term", "df"), "term").select("qid", F.lit(0).cast("bigint").alias("postings"), "df")
    counted = all_.unionByName(matches.select("qid", "postings", F.lit(0).cast("bigint").alias("df"))).groupBy("qid").agg(F.sum("postings").alias("postings"), F.sum("df").alias("df"))
    return _best_of(matches, top_k), counted.select("qid", "postings", (F.col("df") - F.col("postings")).alias("skipped"))
