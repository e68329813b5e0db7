"""Column expressions over text.  All stay in the JVM, except ``stem``, which is for tasks in Python."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def words(text: Column) -> Column:
    """White-space separated words.  No lambda: the generated code then finds repeated words expressions once."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def words_cased(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def word_count(text: Column) -> Column:
    return F.size(words_cased(text))


def strip(text: Column) -> Column:
    """Trim any white space at both ends.  No pattern: one would be sought at every blank between."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens kept by the sparse index, before stemming."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def stemmed(df: DataFrame, word: str, out: str) -> DataFrame:
    """Add ``out``: the word with the first suffix of the rule list that leaves three characters replaced.

    Where one suffix ends another, the list has the longer first; so the rule to use is the longest
    suffix behind a stem of three or more.  The suffix is a column of its own, so it is found once.
    """
    size = F.length(word)
    suffix = F.when((size <= 3) | F.substring(word, -2, 2).isin(list(fixed.UNSTEMMED_ENDINGS)), "")
    for n in sorted({len(s) for s, _ in fixed.SUFFIX_RULES}, reverse=True):
        end = F.substring(word, -n, n)
        suffix = suffix.when((size >= n + 3) & end.isin([s for s, _ in fixed.SUFFIX_RULES if len(s) == n]), end)
    replaced = F.when(F.col("_suffix") == "", F.col(word))
    cut = F.left(word, size - F.length("_suffix"))
    for replacement in sorted({r for _, r in fixed.SUFFIX_RULES if r}):
        ends = [s for s, r in fixed.SUFFIX_RULES if r == replacement]
        replaced = replaced.when(F.col("_suffix").isin(ends), F.concat(cut, F.lit(replacement)))
    found = df.withColumn("_suffix", suffix.otherwise(""))
    return found.withColumn(out, replaced.otherwise(cut)).drop("_suffix")


def stem(words: pa.Array) -> pa.Array:
    """As ``stemmed``, of a string array inside a task; words are ``[a-z0-9]+``."""
    size = pc.binary_length(words)
    left = pc.greater(size, 3)
    for end in fixed.UNSTEMMED_ENDINGS:
        left = pc.and_not(left, pc.ends_with(words, end))
    out = words
    for suffix, replacement in fixed.SUFFIX_RULES:
        hit = pc.and_(left, pc.and_(pc.greater_equal(size, len(suffix) + 3), pc.ends_with(words, suffix)))
        cut = pc.utf8_slice_codeunits(words.filter(hit), 0, -len(suffix))
        out = pc.replace_with_mask(out, hit, pc.binary_join_element_wise(cut, replacement, "") if replacement else cut)
        left = pc.and_not(left, hit)
    return out


def contains_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def matches_any(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def phrases_in(text: Column, phrases) -> Column:
    """The phrases that occur, in list order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, fixed.SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, fixed.PARAGRAPH_END), strip)
    return F.filter(parts, lambda s: s != "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(empty))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct elements in common."""
    return F.size(F.array_intersect(a, b))


def bigrams(ws: Column) -> Column:
    """Distinct neighbouring pairs, joined by a blank (words hold none)."""
    pairs = F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))),
                       F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(ws) > 1, pairs).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: it stands in lambdas, where nothing repeated is found, so each side is read once."""
    return F.coalesce(F.try_divide(overlap(a, b), F.size(F.array_union(a, b))), F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    """The number itself rounded, as SQL does it; Spark's ``round`` takes the shortest digits: its ``round(0.145, 2)`` is 0.15."""
    return F.round(x * 10**places) / 10**places


def two_places(x: Column) -> Column:
    """``0.25`` as text; rounded first so that every engine prints the same digits."""
    return F.format_string("%.2f", rounded(x, 2))
