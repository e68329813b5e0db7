"""Quality rules with thresholds learned from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, TAIL, Rolling, free_names, quoted, text_udf, word_hashes

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counted beside them: lines with a word.
LINES = "n_lines"
#: Relative error of a sketch: neighbouring bucket borders are (1 + e) / (1 - e) apart.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: The bucket of zero lies below all others.
ZERO = -1_000_000


def _counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    repeated = 0
    if len(words) >= 3:
        grams = Rolling(word_hashes(words)).windows(3)
        _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        hit = np.zeros(len(words), bool)
        for shift in range(3):
            hit[shift:shift + len(twice)] |= twice
        repeated = int(hit.sum())
    return len(words), len(text.translate(None, SPACE + TAIL)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


text_counts = text_udf(_counts, dict.fromkeys((*COUNTS, LINES), pa.int64()))


def base_failed(c: dict[str, Column], min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * c["n_words"])


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    """What the adaptive rules look at; 0 for a text without words."""
    words = F.greatest(c["n_words"], F.lit(1))
    return {
        "word_length": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / F.greatest(c[LINES], F.lit(1)),
        "repeats": c["n_repeat_words"] / words,
    }


def bucket(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.log(x) / math.log(GAMMA))).otherwise(ZERO).cast("bigint")


def bucket_value(b: Column) -> Column:
    return F.when(b == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1))


def sketches(measured: DataFrame, keys: list[str], metrics: dict[str, Column], where: Column) -> DataFrame:
    """``keys, metric, bucket, n`` of the rows with ``where``: one row per filled bucket.

    Sketches merge by adding counts, so partial sums are taken before the shuffle, a hot group sends
    some hundred rows per task, and the result does not depend on the order of merging.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics.items()])
    # explode skips null; a filter would be pushed below the counts and compute them twice
    rows = measured.select(*keys, F.explode(F.when(where, pairs)).alias("p")).select(*keys, "p.metric", "p.bucket")
    return rows.groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """``keys, metric, rows`` and a column per wanted quantile, within ``ERROR`` of the exact one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "metric")
    up_to = F.sum("n").over(w.orderBy("bucket"))
    ranked = sketch.select(*keys, "metric", "bucket", up_to.alias("c"), F.sum("n").over(w).alias("rows"))
    return ranked.groupBy(*keys, "metric").agg(
        F.max("rows").alias("rows"),
        *[bucket_value(F.min(F.when(F.col("c") >= F.ceil(F.col("rows") * q), F.col("bucket")))).alias(name) for name, q in at.items()],
    )


#: A metric's fence lies ``width`` times the way from one quantile to the other beyond the outer one, and ``slack`` further, so that
#: a group in which most rows have the same value (mostly 0) does not reject the rest.  Repetition is skewed: in good
#: text most rows have none and some have much, so its fence is learned from the upper tail, not from the quartiles.
RULES = {
    "word_length": {"inner": "q25", "outer": "q75", "width": 3.0, "slack": 0.75, "low": True},
    "symbols": {"inner": "q25", "outer": "q75", "width": 3.0, "slack": 0.05, "low": False},
    "dup_lines": {"inner": "q50", "outer": "q99", "width": 1.0, "slack": 0.02, "low": False},
    "repeats": {"inner": "q50", "outer": "q99", "width": 1.0, "slack": 0.02, "low": False},
}
AT = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


def thresholds(measured: DataFrame, metrics: dict[str, Column], where: Column, lang: str, source: str, prior: int) -> DataFrame:
    """One row per language and source with a ``low_`` and ``high_`` fence per metric.

    A group's quantiles are drawn towards those of its language, which count as ``prior`` rows: the fewer rows a
    group has, the more it is judged by its language, without a size at which the rule changes.  The language's
    sketch is its groups' sketches summed further.
    """
    fine = sketches(measured, [lang, source], metrics, where)
    wide = fine.groupBy(lang, "metric", "bucket").agg(F.sum("n").alias("n"))
    own, parent = quantiles(fine, [lang, source], AT), quantiles(wide, [lang], AT)
    p = parent.select(F.col(lang).alias("p_lang"), F.col("metric").alias("p_metric"), *[F.col(q).alias(f"p_{q}") for q in AT])
    both = own.join(p, F.col(lang).eqNullSafe(F.col("p_lang")) & (F.col("metric") == F.col("p_metric")))
    drawn = {q: (F.col("rows") * F.col(q) + prior * F.col(f"p_{q}")) / (F.col("rows") + prior) for q in AT}
    fences = []
    for name, rule in RULES.items():
        inner, outer = drawn[rule["inner"]], drawn[rule["outer"]]
        reach = rule["width"] * (outer - inner) + rule["slack"]
        mine = F.col("metric") == name
        fences.append(F.max(F.when(mine, outer + reach)).alias(f"high_{name}"))
        if rule["low"]:
            fences.append(F.max(F.when(mine, inner - reach)).alias(f"low_{name}"))
    return both.groupBy(lang, source).agg(*fences)


def judge(docs: DataFrame, prior: int = 200, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Every row of ``docs`` with one struct column more, named by the result's last column.

    The struct holds the five counts, ``base_failed`` and ``kept``.  Base rules reject texts of fewer
    than ``min_words`` words or with more than ``max_repeat_pct`` percent of the words in repeated
    three-word windows.  A row that passes is kept if each ratio lies within the fences of its language
    and source.  Sketches hold the rows that pass the base rules: junk does not widen its own fences.

    A null text counts as empty and fails.  Null languages and sources are groups of their own.
    Repeated rows are judged alike.  No column of ``docs`` is changed, whatever its name.
    """
    m, lang, source, fl, fs = free_names(docs, "judged", "judged_lang", "judged_source", "fence_lang", "fence_source")
    c = {k: F.col(f"{m}.{k}") for k in (*COUNTS, LINES)}
    counted = docs.withColumn(m, text_counts(F.col("text")))
    failed = base_failed(c, min_words, max_repeat_pct)
    narrow = docs.select(F.col("lang").alias(lang), F.col("source").alias(source), text_counts(F.col("text")).alias(m))
    fences = thresholds(narrow, ratios(c), ~failed, lang, source, prior).withColumnsRenamed({lang: fl, source: fs})
    f = free_names(counted, "fence")[0]
    fences = fences.select(fl, fs, F.struct(*[x for x in fences.columns if x.startswith(("high_", "low_"))]).alias(f))
    joined = counted.join(fences, F.col("lang").eqNullSafe(F.col(fl)) & F.col("source").eqNullSafe(F.col(fs)), "left")
    ok = F.lit(True)
    for name, x in ratios(c).items():
        ok = ok & (x <= F.col(f"{f}.high_{name}"))
        if RULES[name]["low"]:
            ok = ok & (x >= F.col(f"{f}.low_{name}"))
    kept = ~failed & F.coalesce(ok, F.lit(True))
    return joined.select(*quoted(docs.columns), F.struct(*[c[k].alias(k) for k in COUNTS], failed.alias("base_failed"), kept.alias("kept")).alias(m))


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` of each row."""
    narrow = judge(docs.select("doc_id", "text", "lang", "source"), **options)
    return narrow.select("doc_id", f"{narrow.columns[-1]}.*")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns only."""
    judged = judge(docs, **options)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*quoted(docs.columns))
