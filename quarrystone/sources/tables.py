"""Table readers.  Schemas come from the parquet footers; only the needed columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; a text table that is read in fewer splits than the session has cores is spread over the cores.

    Text work is bound by the processor, and one small file would be one task.  Splits are of bounded
    size, so what is moved is never more than a split for each core; all else is read where it lies.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXT_KEYS:
        df = spread(df, TEXT_KEYS[name])
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
