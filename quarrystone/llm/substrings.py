"""Substring de-duplication by level-wise doubling over windows of words."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_word_hashes, word_pieces
from .phrases import Kind, Shape, remove_repeats


def word_digest(text: bytes, kept: np.ndarray | None) -> str:
    """SHA-256 of the kept words, joined by one space."""
    out, at, gap = hashlib.sha256(), 0, b""
    for words in word_pieces(text):
        if kept is not None:
            words, at = [w for w, k in zip(words, kept[at:at + len(words)].tolist(), strict=True) if k], at + len(words)
        if words:
            out.update(gap)
            out.update(b" ".join(words))
            gap = b" "
    return out.hexdigest()


def levels(window: int) -> Shape:
    """The level below ``window`` has half its length.

    A window holds ``window - half + 1`` runs of half its length; the one of least hash stands for them, so that one
    run in a dozen moves at the lower level instead of every one.  A window whose run occurs in one document
    alone is out.  Those left are doubled to their full length; there the doubling ends, because a
    longer repeat covers no word that its windows do not.
    """
    half = (window + 1) // 2
    return Shape(window, window - half + 1, half, "earlier")


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row, and ``n_spans``, the number of removed runs.

    A word goes if it lies in a window of ``window`` words that also starts in a document of a smaller ``doc_id``; all
    windows are judged on the input.  So the first document keeps everything, and repeats inside one
    document stay, as do rows of equal ``doc_id`` beside each other.  A null ``doc_id`` is neither smaller nor larger:
    such a row stays whole and makes no other row lose words.  Null, empty and short texts lose nothing.
    """
    kind = Kind(text_word_hashes, word_digest, levels(window))
    found = remove_repeats(docs.select(F.col("doc_id").alias("id"), "text"), kind, "substrings")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", F.col("kept").alias("kept_sha256"), "n_spans")
