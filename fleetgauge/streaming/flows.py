"""Structured Streaming forms: landed text to samples, windowed counts, runs of unchanged reports, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetgauge.sources import exposition

#: Local days begin 5 h 30 min before those of UTC.
DAY_MS, LOCAL_MS = 86_400_000, 19_800_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed_samples(spark: SparkSession, folder: str, lateness: str = "1 minute") -> DataFrame:
    """Stream of samples from JSON lines (node, cluster, ts_ms, value) in a folder; value is a line of exposition text."""
    rows = spark.readStream.schema("node string, cluster string, ts_ms bigint, value string").json(folder)
    return exposition.parse(rows).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)


def bucket_deltas(samples: DataFrame, bucket_ms: int, start_ms: int = 0) -> DataFrame:
    """Per node, metric and bucket from the epoch (start_ms later): samples, first and last value by time, and the counter's
    delta, 0 after a reset."""
    w = F.window("ts", f"{bucket_ms} milliseconds", startTime=f"{start_ms} milliseconds")
    out = samples.groupBy("node", "metric", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ts_ms").alias("first"), F.max_by("value", "ts_ms").alias("last"))
    return out.select("node", "metric", F.unix_millis("w.start").alias("bucket_ms"), "n", "first", "last", F.greatest(F.col("last") - F.col("first"), F.lit(0.0)).alias("delta"))


def daily_deltas(samples: DataFrame) -> DataFrame:
    """bucket_deltas() of local days: the first value of a day is its baseline, kept in the stream's state."""
    return bucket_deltas(samples, DAY_MS, DAY_MS - LOCAL_MS)


class Throttle(StatefulProcessor):
    """Per node: every n-th snapshot, counted over restarts."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        n = self.state.get()[0] if self.state.exists() else 0
        self.state.update((n + len(table),))
        number = pd.Series(range(n + 1, n + len(table) + 1), index=table.index)
        yield table[number % self.every == 0][["node", "ts_ms"]]

    def close(self) -> None:
        pass


def throttled(snapshots: DataFrame, every: int = 10) -> DataFrame:
    """(node, ts_ms) of every n-th snapshot of a node, as history keeps them. Needs the store provider ROCKS."""
    return snapshots.select("node", "ts_ms").groupBy("node").transformWithStateInPandas(statefulProcessor=Throttle(every), outputStructType="node string, ts_ms bigint", outputMode="Append", timeMode="None")


class UnchangedRun(StatefulProcessor):
    """Per report series: how many reports in a row have had the key of the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "last_key string, unchanged bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        last, run = self.state.get() if self.state.exists() else (None, 0)
        seen, out = self.state.exists(), []
        for k in table["key"]:
            run = run + 1 if seen and k == last else 0
            last, seen = k, True
            out.append(run)
        self.state.update((last, run))
        yield pd.DataFrame({"series": key[0], "ts_ms": table["ts_ms"].to_numpy(), "key": table["key"].to_numpy(), "unchanged": out})

    def close(self) -> None:
        pass


def unchanged_stream(reports: DataFrame) -> DataFrame:
    """reports (series, ts_ms, key) with unchanged. The state is in the checkpoint and survives a restart. Needs
    spark.sql.streaming.stateStore.providerClass = ROCKS."""
    return reports.groupBy("series").transformWithStateInPandas(statefulProcessor=UnchangedRun(), outputStructType="series string, ts_ms bigint, key string, unchanged bigint", outputMode="Append", timeMode="None")


def alerts(runs: DataFrame, send: Callable[[list], None], checkpoint: str, pause_at: int = 3):
    """Start a query that hands each batch's reports below pause_at to send (a sink given by the caller), and each
    series' pause once. send runs where the reports are, once per partition with any, a series in order of time."""

    def deliver(rows: Iterator) -> None:
        if out := [r.asDict() | {"paused": r.unchanged == pause_at} for r in rows]:
            send(out)

    def batch(df: DataFrame, _: int) -> None:
        df.filter(F.col("unchanged") <= pause_at).repartition("series").sortWithinPartitions("series", "ts_ms").foreachPartition(deliver)

    return runs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
