"""The log reports as Structured Streaming jobs.

Late rows: a watermark of ten minutes unless said otherwise; what comes later is dropped and shows up
in the query's progress metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from threading import Event

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.windows import ADMITTED, Admission, Limits, spread, spikes
from ..session import fresh_path

LATE = "10 minutes"


def read_stream(spark: SparkSession, folder: str, files: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """The parquet files of a folder that match ``files``, as a stream; the schema comes from one footer."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", files).parquet(folder).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.option("pathGlobFilter", files).parquet(folder)


def drain_append(stream: DataFrame, label: str) -> DataFrame:
    """Run until the input is used up and return what the sink holds."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, label + "-state")
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_update(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """As ``drain_append`` for results that change: the newest version of each key.

    A micro-batch overwrites its own folder, so one that is run again leaves no copies.
    """
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, label + "-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = [c for c in stream.columns if c not in keys]
    versions = spark.read.parquet(out)
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v")).select(*keys, "v.*")


def drain_arrivals(stream: DataFrame, folder: str, arrivals: Iterable[DataFrame], label: str, keys: list[str] | None = None, watch: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Run ``stream``, which reads ``folder``, while ``arrivals`` are written there one after another.

    Each arrival, of any number of files, is a micro-batch or more of its own, and is used up before the next one comes.
    Without ``keys`` the result is what has been appended; with them, the newest version of each key.  ``watch`` is
    called with the running query after each arrival.
    """
    spark = stream.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, label + "-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", state)
    q = (writer.outputMode("update").foreachBatch(save).start() if keys else writer.outputMode("append").format("parquet").start(out))
    try:
        for rows in arrivals:
            rows.write.mode("append").parquet(folder)
            q.processAllAvailable()
            if watch:
                watch(q)
    finally:
        q.stop()
    if not keys:
        return spark.read.schema(stream.schema).parquet(out)
    cols = [c for c in stream.columns if c not in keys]
    versions = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v")).select(*keys, "v.*")


def hourly_latency(log: DataFrame) -> DataFrame:
    w = log.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("latency_ms").alias("avg_ms"), F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("bucket"), F.round("avg_ms", 3).alias("avg_ms"), "n")


def closed_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user once the watermark has passed their end; only open ones are state.

    A row without ``event_id`` is a tick: it moves the clock and is in no session.
    """
    g = log.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("event_id").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    # the tick is counted as no row; a filter before the groups would keep it from the clock
    return g.where("rows > 0").drop("w")


def trailing_cost_spikes(log: DataFrame, again: DataFrame, value: str, hours: int = 24) -> DataFrame:
    """Rows above mean + 2 deviations of the ``hours`` full hours before their own, all of it from the stream.

    ``log`` and ``again`` are two readings of one stream of ``event_id, ts, us`` and ``value``.  The first is reduced to
    moments per hour, these to moments of the sliding ``hours`` that end at each full hour; the second waits for the hour
    its rows belong to.  A row without ``event_id`` is a tick: it moves the clock and is no part of any figure.
    State: open hours, the sliding windows over them, and the rows of hours whose figures are not yet final.
    """
    known = F.col("event_id").isNotNull()
    x = F.when(known, F.col(value))
    hourly = log.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("hour")).agg(
        F.count(x).alias("n"), F.sum(x).alias("s"), (F.var_pop(x) * F.count(x)).alias("m2"))
    hourly = hourly.where("n > 0").select(F.window_time("hour").alias("at"), "n", "s", "m2", (F.col("s") * F.col("s") / F.col("n")).alias("q"))
    fed = hourly.groupBy(F.window("at", f"{hours} hours", "1 hour").alias("day")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m2").alias("m2"), F.sum("q").alias("q"))
    # the window's last moment is the time of its row: the hour that it feeds begins right after it
    stats = fed.select(F.window_time("day").alias("until"), F.col("day.end").alias("start"), *spread())
    rows = again.where(known).withWatermark("ts", LATE).withColumn("hour_start", F.date_trunc("hour", "ts"))
    in_hour = F.expr("ts > until AND ts <= until + INTERVAL 1 HOUR")
    return spikes(rows.join(stats, (F.col("hour_start") == F.col("start")) & in_hour), value)


def recent_turns(turns: DataFrame, kept: int = 10, shown: int = 5, idle: str = "1 day") -> DataFrame:
    """``conv_id, turns``: after each micro-batch the last ``shown`` turns of every conversation that it adds to.

    ``turns`` has ``conv_id, ts, turn, role, text``.  The state of a conversation is a list of its last ``kept`` turns and a
    timer; when the watermark passes its last turn by ``idle``, both go.  Turns may come in any order within the watermark.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["turn", "role", "text"]

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.turns = handle.getListState("turns", "turn long, role string, text string")
            self.last = handle.getValueState("last", "ms long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = pd.DataFrame([tuple(t) for t in self.turns.get()] if self.turns.exists() else [], columns=columns)
            last = self.last.get()[0] if self.last.exists() else None
            newest = last or 0
            for part in rows:  # never more than a part and the kept turns at a time
                newest = max(newest, int(part["ts"].max().timestamp() * 1000))
                held = pd.concat([held, part[columns]]).sort_values("turn", kind="stable").tail(kept)
            self.turns.put(list(held.itertuples(index=False, name=None)))
            if newest != last:
                if last is not None:
                    self.handle.deleteTimer(last + idle_ms)
                self.handle.registerTimer(newest + idle_ms)
                self.last.update((newest,))
            yield pd.DataFrame({"conv_id": [key[0]], "turns": [held.tail(shown).to_dict("records")]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.turns.clear()
            self.last.clear()
            yield from ()

        def close(self) -> None:
            pass

    timed = turns.select("conv_id", "ts", *columns).withWatermark("ts", LATE)
    return timed.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=Memory(), outputStructType="conv_id long, turns array<struct<turn:long, role:string, text:string>>", outputMode="Update", timeMode="EventTime")


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because they come after their watermark; add it with ``spark.streams.addListener``."""

    SCHEMA = "query string, batch long, operator int, dropped long"

    def __init__(self):
        self.found: list[tuple] = []
        self.ended = Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.found += [(p.name or str(p.id), p.batchId, i, o.numRowsDroppedByWatermark) for i, o in enumerate(p.stateOperators) if o.numRowsDroppedByWatermark]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def awaited(self, spark: SparkSession, seconds: float = 60.0) -> DataFrame:
        """The table, once the end of a query has been told: events come after the fact, and in order."""
        self.ended.wait(seconds)
        return self.table(spark)

    def table(self, spark: SparkSession) -> DataFrame:
        """What has been dropped so far: one row per query, micro-batch and operator."""
        return spark.createDataFrame(self.found, self.SCHEMA)


def deduplicated(log: DataFrame, keys: list[str], ttl_us: int = 24 * 3_600_000_000) -> DataFrame:
    """``keys, us, event_id`` of the first row of a key and of each that comes ``ttl_us`` or more after the last kept one.

    The state of a key is the time of its last kept row and a timer: once the watermark is ``ttl_us`` past that time, every row to
    come is kept anyway, and the state goes.  Rows of a key are taken in time order within a micro-batch, so the
    number of files does not matter as long as they arrive in order; an older row that arrives later is a repeat.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = dict(log.dtypes)

    class Keeper(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "us long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.last.get()[0] if self.last.exists() else None
            # two numbers a row
            times, ids = (np.concatenate(x) for x in zip(*((r["us"].to_numpy(), r["event_id"].to_numpy()) for r in rows), strict=True))
            order = np.lexsort((ids, times))
            times, ids = times[order], ids[order]
            kept, last = [], before
            at = 0 if last is None else int(np.searchsorted(times, last + ttl_us))
            while at < len(times):
                kept.append(at)
                last = int(times[at])
                at = int(np.searchsorted(times, last + ttl_us))
            if kept:
                if before is not None:
                    self.handle.deleteTimer((before + ttl_us) // 1000)
                self.last.update((last,))
                self.handle.registerTimer((last + ttl_us) // 1000)
            yield pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(keys, key, strict=True)}, "us": times[kept], "event_id": ids[kept]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            yield from ()

        def close(self) -> None:
            pass

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", us long, event_id long"
    timed = log.select(*keys, "ts", "us", "event_id").withWatermark("ts", LATE)
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Keeper(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def daily_quota(usage: DataFrame) -> DataFrame:
    g = usage.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "tenant_id").agg(F.sum("tokens").alias("used"))
    return g.select("tenant_id", F.date_format("w.start", "yyyy-MM-dd").alias("date"), "used")


def admitted(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``tenant_id, event_id, us, duration_us`` to decisions; a tenant's memory is keyed state.

    The state is bounded by the limits themselves: at most ``per_hour`` times and ``concurrent`` ends
    per tenant.  Requests of one micro-batch are decided in time order.  Keyed state of this kind needs the RocksDB
    state store (see ``session.SETTINGS``).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.memory = handle.getValueState("memory", "hour array<long>, running array<long>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            limiter = Admission()
            if self.memory.exists():
                hour, running = self.memory.get()
                limiter.hour.extend(hour or [])
                limiter.running = list(running or [])
            # three numbers a row, in time order
            events, times, durations = (np.concatenate(x) for x in zip(*((r["event_id"].to_numpy(), r["us"].to_numpy(), r["duration_us"].to_numpy()) for r in rows), strict=True))
            order = np.lexsort((events, times))
            out = [(key[0], e, us, *limiter.decide(us, dur, limits)) for e, us, dur in zip(events[order].tolist(), times[order].tolist(), durations[order].tolist(), strict=True)]
            self.memory.update((list(limiter.hour), list(limiter.running)))
            yield pd.DataFrame(out, columns=["tenant_id", "event_id", "us", "allowed", "reason", "retry_after_s"])

        def close(self) -> None:
            pass

    return requests.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=ADMITTED, outputMode="Append", timeMode="None")
