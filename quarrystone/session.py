"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrystone")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: executors on other machines
    could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def fresh_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), "quarrystone", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs then see one fixed result whatever executors are lost, column pruning and
    pushdown work on it, and its size on disk is known to the planner.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The written tables of one operation, in one folder that :meth:`drop` deletes when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.names = spark, fresh_path(spark, label), []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialize``."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_buckets(self, df: DataFrame, name: str, key: str, order: str | None = None) -> DataFrame:
        """Written so that joins, groups and windows on ``key`` need no shuffle of it."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.names.append(table)
        df.repartition(parts, key).write.bucketBy(parts, key).sortBy(order or key).option("path", f"{self.root}/{table}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
