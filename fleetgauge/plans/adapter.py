"""The driver's tables as telemetry: users are nodes, event types are voices, counters are running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.operators.summaries import DECODE, E2E, HITS, MISSES, REQS, RUNNING, WS

VOICES = ("click", "", "purchase", "signup", "view")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("node"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cluster"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("voice"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), k.alias("k"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested snapshot per event: every voice's counters so far, and two gauges."""
    w = W.partitionBy("node").orderBy("ts_ms", "event_id").rowsBetween(W.unboundedPreceding, 0)
    steps = {REQS: F.lit(1), E2E: F.col("cents"), DECODE: F.floor(F.col("cents") / 3), HITS: F.when(F.col("k") < 70, 1).otherwise(0), MISSES: F.when(F.col("k") < 70, 0).otherwise(1)}
    none = F.create_map().cast("map<string,string>")
    found = [F.struct(F.lit(m).alias("metric"), F.create_map(F.lit("voice"), F.lit(v)).alias("labels"), F.sum(F.when(F.col("voice") == v, inc).otherwise(0)).over(w).cast("double").alias("value")) for m, inc in steps.items() for v in VOICES]
    found += [F.struct(F.lit(m).alias("metric"), none.alias("labels"), (F.col("k") % n).cast("double").alias("value")) for m, n in ((WS, 7), (RUNNING, 4))]
    return events(spark, sf_dir).select("node", "cluster", "ts_ms", F.array(*found).alias("samples"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select("node", "cluster", "ts_ms", F.inline("samples"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listed nodes; those without events are down."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("node"), F.concat(F.lit("c"), (F.col("c_custkey") % 3).cast("string")).alias("cluster"))


def now_ms(spark: SparkSession, sf_dir: str) -> int:
    """The last event's time: tested queries take the time as a parameter."""
    return events(spark, sf_dir).agg(F.max("ts_ms")).first()[0] or 0


#: DuckDB: e (events), p (sums per snapshot), l (each node's last snapshot), v (last counters per voice), n (nodes).
SQL = """
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS node, 'c' || CAST(user_id % 3 AS VARCHAR) AS cluster, epoch_us(ts) // 1000 AS ts_ms,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS voice, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
p AS (SELECT node, cluster, ts_ms, event_id, (k % 7)::DOUBLE AS ws, (k % 4)::DOUBLE AS running, (count(*) OVER w)::DOUBLE AS reqs, (count(*) FILTER (voice <> '') OVER w)::DOUBLE AS named_reqs,
  (sum(cents) OVER w)::DOUBLE AS all_e2e, coalesce(sum(cents) FILTER (voice <> '') OVER w, 0)::DOUBLE AS named_e2e, coalesce(sum(cents // 3) FILTER (voice <> '') OVER w, 0)::DOUBLE AS named_decode,
  (count(*) FILTER (k < 70) OVER w)::DOUBLE AS hits, (count(*) FILTER (k >= 70) OVER w)::DOUBLE AS misses
  FROM e WINDOW w AS (PARTITION BY node ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_ms DESC) = 1),
voices AS (SELECT unnest(['click', '', 'purchase', 'signup', 'view']) AS voice),
v AS (SELECT x.node, x.cluster, voices.voice, count(e.event_id)::DOUBLE AS reqs, coalesce(sum(e.cents), 0)::DOUBLE AS e2e, coalesce(sum(e.cents // 3), 0)::DOUBLE AS decode,
  count(e.event_id) FILTER (e.k < 70)::DOUBLE AS hits, count(e.event_id) FILTER (e.k >= 70)::DOUBLE AS misses
  FROM (SELECT DISTINCT node, cluster FROM e) x CROSS JOIN voices LEFT JOIN e ON e.node = x.node AND e.voice = voices.voice GROUP BY ALL),
n AS (SELECT CAST(c_custkey AS VARCHAR) AS node, 'c' || CAST(c_custkey % 3 AS VARCHAR) AS cluster FROM customer),
now AS (SELECT max(ts_ms) AS t FROM e)
"""
