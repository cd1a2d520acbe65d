"""Streaming forms of the batch operators: file sources, run until what has landed is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.align import KEY


def read_landed(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of a folder's Parquet files, ``files`` of them a micro-batch at most (None: all that have landed)."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def windowed(events: DataFrame, late: str = "14 days", hours: int = 3) -> DataFrame:
    """(station, species, ts, n, total, top): 3-hour aggregates with a watermark.  ``ts`` of the input is NTZ or LTZ, UTC."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    out = timed.groupBy("station", "species", F.window("t", f"{hours} hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return out.select("station", "species", F.col("w.start").cast("timestamp_ntz").alias("ts"), "n", "total", "top")


def first_reading(events: DataFrame, late: str = "14 days") -> DataFrame:
    """Readings repeated within the watermark once, the first."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark(KEY).drop("t")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Give every micro-batch of what has landed to ``each`` (for example an upsert), then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def use_state_store(spark: SparkSession) -> None:
    """Typed state, timers and expiry need this store for queries that start after."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _lag_processor(n: int, silent_ms: int):
    """A processor that keeps a series' last readings, and lets go of them ``silent_ms`` after the last one."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class LagProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.recent = handle.getListState("recent", "at long, log double")

        def handleInputRows(self, key, rows, timerValues):
            new = pd.concat(list(rows))
            at, value = new["ts"].to_numpy("datetime64[us]").astype("int64"), new["value"].to_numpy(float)
            before = list(self.recent.get())
            ats = np.concatenate([np.array([b[0] for b in before], np.int64), at])
            logs = np.concatenate([np.array([b[1] for b in before], float), np.log1p(value)])
            order = np.lexsort((logs, ats))  # a late reading stands among the earlier ones
            ats, logs, given = ats[order], logs[order], order >= len(before)
            late = timerValues.getCurrentWatermarkInMs() * 1000
            keep = max(0, int(np.searchsorted(ats, late)) - n)  # n before the first that may still be passed by a late one
            self.recent.put([(int(a), float(x)) for a, x in zip(ats[keep:], logs[keep:])])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(ats[-1]) // 1000 + silent_ms)
            for start in range(0, len(ats), 10_000):
                k = [i for i in range(start, min(start + 10_000, len(ats))) if given[i]]
                if k:
                    yield pd.DataFrame({"station": key[0], "species": key[1], "ts": ats[k].astype("datetime64[us]"), "value": np.expm1(logs[k]), "logs": [logs[max(0, i - n) : i] for i in k]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.recent.clear()
            return iter([])

        def close(self) -> None:
            pass

    return LagProcessor()


def lag_state(events: DataFrame, n: int = 56, late: str = "1 day", silent: int = 90) -> DataFrame:
    """(station, species, ts, value, logs): each reading with the logs of up to n readings before it, kept across batches.

    The state of a series is a list of its last readings: n, and those within ``late``, so that a reading that comes late
    by no more than that sees the ones before it (what was given out for later ones stays as it was); later ones are
    dropped.  ``silent`` days without a reading, by the stream's own time, end a series' state.  A batch's readings of a
    series are in one task: bound them by the stream's maxFilesPerTrigger.  Needs ``use_state_store``.
    """
    timed = events.select("station", "species", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    shape = "station string, species string, ts timestamp, value double, logs array<double>"
    return timed.groupBy("station", "species").transformWithStateInPandas(_lag_processor(n, silent * 86_400_000), shape, "Append", "EventTime")
