"""Log files: JSON lines in, JSON/CSV out, evaluation runs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialize

SCHEMAS = {
    "cost": "query string, model string, complexity string, tokens_in bigint, tokens_out bigint, cost_usd double, latency_ms double, timestamp string",
    "latency": "timestamp string, query string, total_ms double, components map<string,double>",
    "ab": "timestamp string, query string, variant string, original_model string, assigned_model string, complexity string",
    "audit": "timestamp string, actor string, action string, target string, outcome string, details map<string,string>",
    "usage": "tenant_id string, tokens bigint, cost double, date string, timestamp string",
    "feedback": "id string, query string, answer string, rating int, comment string, timestamp string",
}


def scan_log(spark: SparkSession, path: str, kind: str, mode: str = "drop") -> DataFrame:
    """Rows of a JSON-lines log.

    ``drop`` skips blank and malformed lines, ``fail`` raises on a malformed one, ``keep`` adds the
    column ``malformed`` with the text of bad lines so that they can be counted.  ``stop`` reads each file up to its
    first malformed line; blank lines do not count.
    """
    if mode == "stop":
        return _up_to_bad_line(spark, path, SCHEMAS[kind])
    schema = SCHEMAS[kind]
    if mode == "keep":
        return spark.read.schema(schema + ", malformed string").option("columnNameOfCorruptRecord", "malformed").json(path)
    return spark.read.schema(schema).option("mode", {"drop": "DROPMALFORMED", "fail": "FAILFAST"}[mode]).json(path)


def _up_to_bad_line(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines before the first bad one of their file, in all tasks at once.

    A file may be read in several splits.  Within a split lines keep their order, so a line's place is the split's start and a
    number that grows along the task; the parsed lines are written once, so that both readings see the same places.
    The first bad place of a file is a minimum, and only files that have one are joined.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no")).alias("place"))
    parsed = lines.where(F.trim("value") != "").select("file", "place", F.from_json("value", schema + ", malformed string", {"columnNameOfCorruptRecord": "malformed"}).alias("r"))
    rows = materialize(parsed.withColumn("bad", F.col("r").isNull() | F.col("r.malformed").isNotNull()), "log-lines")
    first = rows.where("bad").groupBy("file").agg(F.min("place").alias("end"))
    kept = rows.join(first, "file", "left").where(F.col("end").isNull() | (F.col("place") < F.col("end")))
    return kept.select("r.*").drop("malformed")


def append_log(rows: DataFrame, path: str, date: Column | None = None) -> None:
    """Append records, one folder per day; a missing timestamp becomes now."""
    stamped = rows.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    day = F.left("timestamp", F.lit(10)) if date is None else date
    stamped.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def export_csv(history: DataFrame, path: str) -> None:
    """Question history for spreadsheets: answers cut to 500 characters, citations joined."""
    history.select(
        F.coalesce("query", F.lit("")).alias("query"), F.left(F.coalesce("answer", F.lit("")), F.lit(500)).alias("answer"), "model_used", "complexity",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.array_join("citations", "; ").alias("citations"), "timestamp",
    ).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines under their name ``file``: a file holds a run of names, so there are as many files as tasks, not as reports."""
    reports.repartitionByRange("file").sortWithinPartitions("file").write.json(path)


def read_reports(spark: SparkSession, path: str, schema: str, limit: int = 100) -> DataFrame:
    """Reports, newest name first.  A report that does not carry its name has that of its folder."""
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1)
    reports = spark.read.schema(schema + ", file string").json(path).withColumn("file", F.coalesce("file", folder))
    return reports.orderBy(F.desc("file")).limit(limit)


class EvalStore:
    """Runs, their status changes and their results as append-only tables."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "evals")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def create_runs(self, runs: DataFrame) -> None:
        runs.select("run_id", "seq", "status").write.mode("append").parquet(f"{self.path}/runs")

    def save_results(self, results: DataFrame) -> None:
        results.write.mode("append").parquet(f"{self.path}/results")

    def set_status(self, changes: DataFrame) -> None:
        """``completed`` or ``failed``; the last change counts."""
        changes.select("run_id", "status", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/status")

    def runs(self) -> DataFrame:
        last = self._read("status").groupBy("run_id").agg(F.max_by("status", "at").alias("new"))
        return self._read("runs").join(last, "run_id", "left").select("run_id", "seq", F.coalesce("new", "status").alias("status"))

    def results(self) -> DataFrame:
        return self._read("results")
