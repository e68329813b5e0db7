"""Periods, entities and text versions side by side."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def compare_periods(values: DataFrame) -> DataFrame:
    """``entity, year, value`` (one row per pair) with change and percentage to the year before."""
    w = Window.partitionBy("entity").orderBy("year")
    d = values.withColumn("prev", F.lag("value").over(w)).withColumn("prev_year", F.lag("year").over(w))
    change = F.col("value") - F.col("prev")
    pct = F.when(F.col("prev") != 0, F.round(change / F.abs(F.when(F.col("prev") != 0, F.col("prev"))) * 100, 2))
    return d.select("entity", "year", "value", "prev_year", change.alias("change"), pct.alias("pct_change"))


def classify_trend(compared: DataFrame) -> DataFrame:
    mean = F.avg("pct_change")
    return compared.groupBy("entity").agg(
        F.when(mean > 5, "improving").when(mean < -5, "declining").otherwise("stable").alias("trend"), F.round(mean, 6).alias("avg_pct"))


def rank_entities(values: DataFrame) -> DataFrame:
    """``id, value``: ranks from the highest value down, entities without a value last."""
    order = -F.coalesce(F.col("value").cast("double"), F.lit(float("-inf")))
    return ranks.ordered_prefix(values, [], order, F.col("id"), rank="rank")


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` on both sides: differing lines per document and whether it changed.

    Line numbers make every key unique, so a large document spreads like many small ones.
    """
    a = old.select("doc_id", "line_no", F.col("line").alias("was"))
    b = new.select("doc_id", "line_no", F.col("line").alias("now"))
    both = a.join(b, ["doc_id", "line_no"], "full_outer")
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"),
        F.count_if(F.col("was") != F.col("now")).alias("replaced"),
        F.bool_or(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"),
    )


def diff_versions(versions: DataFrame, context: int = 3) -> DataFrame:
    """``doc_id, old, new`` (texts) to ``doc_id, changed, added, removed, hunks, diff``.

    ``diff`` is the unified difference of the lines with ``context`` unchanged ones around each hunk; an inserted line is
    one added line, whatever stands below.  Only texts that differ are compared, each inside its row, and without the
    lines that both begin and end with.  A null text has no lines.
    """
    old, new = (F.coalesce(c, F.lit("")) for c in ("old", "new"))
    found = versions.select("doc_id", F.when(old != new, F.struct(old.alias("old"), new.alias("new"))).alias("pair"))

    def unified(pairs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_unified(a, b, context) for a, b in zip(pairs["old"], pairs["new"], strict=True)], columns=["added", "removed", "hunks", "diff"])

    run = F.pandas_udf(unified, "added long, removed long, hunks long, diff string")
    # rows of equal texts never reach Python
    apart = found.where("pair IS NOT NULL").select("doc_id", run(F.col("pair")).alias("d")).select("doc_id", F.lit(True).alias("changed"), "d.*")
    same = found.where("pair IS NULL").select("doc_id", F.lit(False).alias("changed"), *[F.lit(0).cast("bigint").alias(c) for c in ("added", "removed", "hunks")], F.lit("").alias("diff"))
    return apart.unionByName(same)


def _unified(old: str | None, new: str | None, context: int) -> tuple[int, int, int, str]:
    a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    skip = max(0, head - context)
    x, y = (t[skip:len(t) - max(0, tail - context)] for t in (a, b))
    lines = list(difflib.unified_diff(x, y, "old", "new", n=context))
    # a line that begins with @@ heads a hunk, all others begin with a mark; its numbers count from the whole text's first line
    body = [re.sub(r"([-+])([0-9]+)", lambda m: f"{m[1]}{int(m[2]) + skip}", t) if t.startswith("@@") else t for t in lines[2:]]
    return sum(t[0] == "+" for t in body), sum(t[0] == "-" for t in body), sum(t[0] == "@" for t in body), "".join(lines[:2] + body)
