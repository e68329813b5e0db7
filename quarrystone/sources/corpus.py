"""Corpus readers: files below ``<ticker>/<year>/`` or a table with a path column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

SUFFIXES = ("pdf", "html", "htm", "txt")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable file: ``path, text, ticker, year``."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(SUFFIXES) + "}")
    path = F.input_file_name()
    return raw.select(path.alias("path"), F.col("value").alias("text")).select("path", "text", *path_metadata(F.col("path")))


def path_metadata(path: Column, tickers: tuple[str, ...] = fixed.TICKERS) -> list[Column]:
    """Ticker and year from the path parts; the last match wins, ``UNKNOWN`` without one."""
    parts = F.split(path, "/")
    known = F.array(*[F.lit(t) for t in tickers])
    named = F.filter(F.transform(parts, F.upper), lambda p: F.array_contains(known, p))
    years = F.filter(parts, lambda p: p.rlike(r"^20\d{2}$"))

    def last(found: Column) -> Column:
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("UNKNOWN"))

    return [last(named).alias("ticker"), last(years).alias("year")]


def corpus_inventory(docs: DataFrame) -> DataFrame:
    """Count, size and chunk estimate per ticker and year."""
    size = F.sum(F.octet_length("text"))
    return docs.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("documents"), size.alias("size_bytes")).select(
        "ticker", "year", "documents", "size_bytes", F.greatest(F.lit(10), F.floor(F.col("size_bytes") / 5000)).alias("chunks"),
        F.when(F.col("size_bytes") > 1024, F.concat(F.floor(F.col("size_bytes") / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.col("size_bytes").cast("string"), F.lit(" B"))).alias("size"),
    )
