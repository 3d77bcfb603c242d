"""Windows over counter series: deltas, activity, days, buckets, runs and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import clamped, file_key, local_date, local_label, named_voice, percent, ratio
from fleetgauge.operators.summaries import DECODE, E2E, HITS, MISSES, REQS, WS, metric_sum

MEASURES = ("ws", "reqs", "named_reqs", "named_e2e", "all_e2e", "named_decode", "hits", "misses")


def points(samples: DataFrame) -> DataFrame:
    """One row per node and snapshot with the sums that windows need; made once, so windows never see single samples."""
    named = named_voice(F.col("labels"))
    return samples.groupBy("node", "cluster", "ts_ms").agg(metric_sum(WS).alias("ws"), metric_sum(REQS).alias("reqs"), metric_sum(REQS, named).alias("named_reqs"), metric_sum(E2E, named).alias("named_e2e"), metric_sum(E2E).alias("all_e2e"), metric_sum(DECODE, named).alias("named_decode"), metric_sum(HITS).alias("hits"), metric_sum(MISSES).alias("misses"))


def since(rows: DataFrame, since_ms: int = 0) -> DataFrame:
    """Rows from a time on, inclusive; 0 for all."""
    return rows.filter(F.col("ts_ms") >= since_ms) if since_ms else rows


def trailing(rows: DataFrame, window_ms: int, now_ms: int) -> DataFrame:
    if window_ms < 0:
        raise ValueError("a window can't be negative")
    return rows.filter(F.col("ts_ms") >= now_ms - window_ms)


def tail(rows: DataFrame, last: int = 0) -> DataFrame:
    """Each node's last rows by time; 0 for all."""
    if last < 0:
        raise ValueError("last can't be negative")
    if last == 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy(F.col("ts_ms").desc()))).filter(F.col("_n") <= last).drop("_n")


def retained(rows: DataFrame, most: int = 1440) -> DataFrame:
    """Ring retention: what a bounded buffer per node would hold."""
    return tail(rows, most)


def first_and_last(rows: DataFrame, *measures: str, keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """Per key with two snapshots or more: first_x and last_x."""
    ends = [f(m, "ts_ms").alias(f"{n}_{m}") for m in measures for n, f in (("first", F.min_by), ("last", F.max_by))]
    return rows.groupBy(*keys).agg(F.count_distinct("ts_ms").alias("_n"), *ends).filter("_n >= 2").drop("_n")


def delta(measure: str) -> Column:
    """Clamped: a counter that fell counts 0. No correction for resets."""
    return clamped(F.col(f"last_{measure}") - F.col(f"first_{measure}"))


def window_latency(rows: DataFrame, now_ms: int, window_ms: int = 3_600_000) -> DataFrame:
    """Fleet latency of a trailing window: deltas per node, then one ratio of sums."""
    per = first_and_last(trailing(rows, window_ms, now_ms), "named_reqs", "named_e2e").select(delta("named_reqs").alias("r"), delta("named_e2e").alias("e"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return per.agg(ratio(s("e"), s("r")).alias("avg_ms"), s("r").cast("bigint").alias("total_reqs"), F.lit(window_ms // 60_000).cast("bigint").alias("window_min"))


def daily(rows: DataFrame) -> DataFrame:
    """Per local day over the fleet: clamped deltas from each node's first snapshot of the day, and their ratios."""
    day = rows.withColumn("day", local_date(F.col("ts_ms")))
    ends = [f(m, "ts_ms").alias(f"{n}_{m}") for m in MEASURES for n, f in (("first", F.min_by), ("last", F.max_by))]
    per = day.groupBy("day", "node").agg(*ends).select("day", *(delta(m).alias(m) for m in MEASURES if m != "ws"))
    out = per.groupBy("day").agg(F.count(F.lit(1)).alias("nodes"), *(F.sum(m).alias(m) for m in ("reqs", "named_reqs", "named_e2e", "hits", "misses")))
    return out.withColumns({"avg_ms": ratio(F.col("named_e2e"), F.col("named_reqs")), "hit_rate": percent(F.col("hits"), F.col("hits") + F.col("misses"))})


def activity(nodes: DataFrame, rows: DataFrame, now_ms: int, window_ms: int = 300_000) -> DataFrame:
    """Per node: active if named requests rose in the window; idle_since is the last rise between neighbours in it, else
    its first snapshot; nulls and no ws with fewer than two snapshots."""
    w = W.partitionBy("node").orderBy("ts_ms")
    steps = trailing(rows, window_ms, now_ms).withColumn("_up", F.col("named_reqs") > F.lag("named_reqs").over(w))
    per = steps.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), (F.max_by("named_reqs", "ts_ms") > F.min_by("named_reqs", "ts_ms")).alias("_active"), F.max_by("ws", "ts_ms").alias("_ws"), F.coalesce(F.max(F.when(F.col("_up"), F.col("ts_ms"))), F.min("ts_ms")).alias("_since"))
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= 2
    return nodes.join(per, "node", "left").select("node", F.when(enough, F.col("_active")).alias("active"), F.when(enough, F.col("_ws")).otherwise(F.lit(0.0)).alias("ws"), F.when(enough & ~F.col("_active"), F.col("_since")).alias("idle_since"))


def history(rows: DataFrame, every: int = 10) -> DataFrame:
    """Every n-th snapshot of each node as a history record."""
    n = F.row_number().over(W.partitionBy("node").orderBy("ts_ms"))
    kept = rows.withColumn("_n", n).filter(F.col("_n") % every == 0)
    return kept.select("node", "ts_ms", ratio(F.col("named_e2e"), F.col("named_reqs")).alias("e2e_ms"), ratio(F.col("named_decode"), F.col("named_reqs")).alias("decode_ms"), F.col("hits").alias("cache_hits"), F.col("named_reqs").alias("reqs"))


def write_history(records: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per local day and node file key. A node's files are few and large enough by day."""
    records.withColumns({"day": local_date(F.col("ts_ms")), "node_key": file_key(F.col("node"))}).write.mode("append").partitionBy("day", "node_key").json(path)


def read_history(spark, path: str) -> DataFrame:
    """History records; blank and broken lines are skipped one by one (not the whole node)."""
    from fleetgauge import schemas

    rows = spark.read.schema(schemas.HISTORY + ", day date, node_key string").option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("ts_ms").isNotNull()).select("node", "ts_ms", "e2e_ms", "decode_ms", "cache_hits", "reqs")


def bucketed(records: DataFrame, bucket_h: float = 5) -> DataFrame:
    """Per node and tumbling bucket from the epoch: latencies weighted by requests, mean hits, label of the first record."""
    if bucket_h <= 0:
        raise ValueError("a bucket needs a length")
    bucket = F.floor(F.col("ts_ms") / int(bucket_h * 3_600_000))
    weight = F.when(F.col("reqs") > 0, F.col("reqs"))
    out = records.withColumn("bucket", bucket).groupBy("node", "bucket").agg(F.min("ts_ms").alias("first_ms"), ratio(F.sum(F.col("e2e_ms") * weight), F.sum(weight)).alias("e2e_ms"), ratio(F.sum(F.col("decode_ms") * weight), F.sum(weight)).alias("decode_ms"), F.avg("cache_hits").cast("bigint").alias("cache_hits"))
    return out.withColumn("label", local_label(F.col("first_ms"))).orderBy("node", "bucket")


def hit_rate_history(rows: DataFrame, step_ms: int, most: int = 60) -> DataFrame:
    """(step_ms, hit_rate): the fleet's rate in percent over each node's last snapshot within each step, the last steps only."""
    step = (F.floor(F.col("ts_ms") / step_ms) * step_ms).alias("step_ms")
    per = rows.groupBy(step, "node").agg(F.max_by("hits", "ts_ms").alias("h"), F.max_by("misses", "ts_ms").alias("m"))
    out = per.groupBy("step_ms").agg(percent(F.sum("h"), F.sum("h") + F.sum("m")).alias("hit_rate"))
    return out.orderBy(F.col("step_ms").desc()).limit(most)


def latency_series(rows: DataFrame) -> DataFrame:
    """Per snapshot: all voices' latency and ws."""
    return rows.select("node", "ts_ms", ratio(F.col("all_e2e"), F.col("reqs")).alias("e2e_ms"), "ws")


def unchanged_runs(reports: DataFrame, key: str, order: str, part: tuple[str, ...], pause_at: int = 3) -> DataFrame:
    """reports plus unchanged (consecutive reports with the same key before this one) and paused. part: the columns that tell
    series apart; each is one task's work."""
    w = W.partitionBy(*part).orderBy(order)
    marked = reports.withColumn("_new", F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.row_number().over(W.partitionBy(*part, "_island").orderBy(order)) - 1
    return marked.withColumn("unchanged", run.cast("bigint")).withColumn("paused", F.col("unchanged") >= pause_at).drop("_new", "_island")


def buffer_info(rows: DataFrame, most: int = 1440) -> DataFrame:
    return rows.groupBy("node").agg(F.least(F.count_distinct("ts_ms"), F.lit(most)).alias("snapshots"), F.min("ts_ms").alias("oldest_ts"), F.lit(most).cast("bigint").alias("max_snapshots"))
