"""Repeated windows of words and bytes against direct counting."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import phrases
from quarrystone.llm.substrings import dedup_substrings
from quarrystone.llm.suffixes import dedup_bytes

WORD_COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"]
BYTE_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("seed,vocabulary", [(1, 60), (2, 3)])
def test_substrings(spark, seed, vocabulary):
    rows = brute.corpus(seed, vocabulary)
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(5).withColumns({"id": F.lit(1), "n_words": F.lit("x"), "kept": F.lit(2)})
    brute.same(dedup_substrings(docs), brute.dedup_substrings(rows), WORD_COLUMNS)


def test_other_window(spark):
    rows = brute.corpus(4, 8, 30)
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    brute.same(dedup_substrings(docs, 7), brute.dedup_substrings(rows, 7), WORD_COLUMNS)


@pytest.mark.parametrize("seed,vocabulary,group", [(1, 60, 256), (3, 3, 256), (1, 60, 0), (1, 60, 3)])
def test_bytes(spark, monkeypatch, seed, vocabulary, group):
    monkeypatch.setattr(phrases, "GROUP", group)
    monkeypatch.setattr(phrases, "BUCKET", 100)
    rows = brute.corpus(seed, vocabulary)
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(5).withColumns({"id": F.lit(1), "n_bytes": F.lit("x")})
    brute.same(dedup_bytes(docs), brute.dedup_bytes(rows), BYTE_COLUMNS)


def test_empty(spark):
    docs = spark.createDataFrame([], brute.SCHEMA)
    assert dedup_substrings(docs).collect() == [] and dedup_bytes(docs).collect() == []


def test_stretches_cover_each_window_once(monkeypatch):
    values = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint64)
    shape = phrases.Shape(200, 128, 16, "any")
    for size in (phrases.STRETCH, 700):
        monkeypatch.setattr(phrases, "STRETCH", size)
        starts = np.concatenate([s.windows(np.ones(len(s.first), bool)) + s.at for s in phrases.stretches(values, shape)])
        assert starts.tolist() == list(range(4801))


def test_texts_longer_than_a_stretch(spark, monkeypatch):
    # the workers take the size from their own module, so the kind is exercised directly
    monkeypatch.setattr(phrases, "STRETCH", 300)
    kind = phrases.bytes_kind(phrases.Shape(200, 128, 16, "any"))
    text = (b"0123456789abcdefghijklmnop" * 60)[:1500]
    keys = kind.keys(text)[0]
    packed = phrases.pack(text)[0]
    n, rows, kept = kind.phrases(packed, keys)
    assert n == 1500 and kept is None and len(rows)
    windows = kind.open_windows(packed, rows[:, 1], rows[:0, 1])[0]
    assert kind.remove(packed, rows[:0, 1], windows[:, 0])[1] == 1500
