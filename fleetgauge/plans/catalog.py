"""Registered queries over the driver's tables, with the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import scalars as sc
from fleetgauge.operators import series as se
from fleetgauge.operators import summaries as su
from fleetgauge.plans.adapter import SQL, events, nodes, now_ms, samples, snapshots
from fleetgauge.sources import exposition, lists

DAY = 86_400_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, common: bool = True):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = (SQL if common else "") + sql
        return fn

    return add


def r1(df: DataFrame, *columns: str) -> DataFrame:
    """One decimal by the same IEEE steps on both sides; sums of ratios depend on their order in the last bits."""
    return df.withColumns({c: sc.rounded(F.col(c), 1, exact=True) for c in columns})


def R1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


def DIV(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a}) / ({b}) END)"


def latest(spark, d):
    return su.latest_nested(snapshots(spark, d))


def points(spark, d):
    return se.points(samples(spark, d))


@query(f"""SELECT n.node, n.cluster, l.node IS NOT NULL AS up, ws, reqs, hits, misses,
  CASE WHEN l.node IS NOT NULL THEN {DIV('hits', 'hits + misses')} * 100 END AS hit_rate, CASE WHEN l.node IS NOT NULL THEN {DIV('named_e2e', 'named_reqs')} END AS avg_ms FROM n LEFT JOIN l ON n.node = l.node""")
def node_summary(spark, d):
    return su.node_rows(nodes(spark, d), latest(spark, d))


@query(f"""SELECT n.cluster, count(*) AS total_nodes, count(l.node) AS up_nodes, count(*) FILTER (ws > 0) AS active_nodes, coalesce(sum(ws), 0) AS total_ws, {DIV('coalesce(sum(ws), 0)', 'count(*) FILTER (ws > 0)')} AS avg_ws_per_active,
  coalesce(sum(reqs), 0) AS total_reqs, coalesce(sum(hits), 0) AS hits, coalesce(sum(misses), 0) AS misses, {DIV('sum(hits)', 'coalesce(sum(hits + misses), 0)')} * 100 AS hit_rate,
  {R1("coalesce(sum(t) FILTER (t > 0) / count(*) FILTER (t > 0) / 10, 0)")} AS avg_ms, coalesce(max(t) FILTER (t > 0) / 10, 0) AS max_ms FROM n LEFT JOIN (SELECT *, floor(named_e2e / nullif(named_reqs, 0) * 10 + 0.5) AS t FROM l) l ON n.node = l.node GROUP BY n.cluster""")
def cluster_summary(spark, d):
    return r1(su.cluster_rows(su.node_rows(nodes(spark, d), latest(spark, d))), "avg_ms")


@query(f"""SELECT 7 AS total_nodes, sum(ws) AS total_ws, sum(ws) / 7 AS avg_ws_per_node, sum(reqs) AS total_reqs, sum(hits) AS hits, sum(misses) AS misses, {DIV('sum(hits)', 'sum(hits + misses)')} * 100 AS hit_rate, {DIV('sum(all_e2e)', 'sum(named_reqs)')} AS avg_ms FROM l""")
def single_summary(spark, d):
    return su.single_summary(latest(spark, d))


@query("""SELECT count(*) AS total_nodes, count(l.node) AS up_nodes, coalesce(sum(ws), 0) AS total_ws, sum(CASE WHEN named_reqs = 0 THEN reqs ELSE named_reqs END) AS total_reqs,
  sum(CASE WHEN named_reqs = 0 THEN all_e2e ELSE named_e2e END) / sum(CASE WHEN named_reqs = 0 THEN reqs ELSE named_reqs END) AS avg_ms, sum(hits) / sum(hits + misses) * 100 AS hit_rate FROM n LEFT JOIN l ON n.node = l.node""")
def fleet_alert(spark, d):
    return su.fleet_stats(nodes(spark, d), latest(spark, d))


@query("SELECT node, cluster FROM n WHERE node NOT IN (SELECT node FROM l)")
def down_nodes(spark, d):
    return su.down_nodes(nodes(spark, d), latest(spark, d))


@query("SELECT cluster, sum(running) / count(*) AS mean_running, count(*) AS nodes FROM l GROUP BY cluster")
def running_mean(spark, d):
    return su.running_mean(latest(spark, d))


@query(f"""SELECT cluster, step_ms, sum(running) / count(*) AS mean_running FROM (SELECT *, ts_ms // {DAY} * {DAY} AS step_ms FROM p QUALIFY row_number() OVER (PARTITION BY node, ts_ms // {DAY} ORDER BY ts_ms DESC) = 1) GROUP BY ALL""")
def concurrent_history(spark, d):
    return su.concurrency(samples(spark, d), DAY)


@query(f"SELECT node, voice, reqs, {DIV('e2e', 'reqs')} AS avg_ms, {DIV('decode', 'reqs')} AS avg_decode_ms, 0.0::DOUBLE AS short_audio, 0.0::DOUBLE AS tokens FROM v")
def voice_rollup(spark, d):
    return su.voice_rows(latest(spark, d))


@query(f"""SELECT node, sum(hits) FILTER (voice <> '') AS hits, sum(misses) FILTER (voice <> '') AS misses, true AS has_cache, array_to_string(coalesce(list(voice ORDER BY voice) FILTER (voice <> '' AND hits > 0), []), ',') AS voices,
  {DIV("sum(hits) FILTER (voice <> '')", "sum(hits + misses) FILTER (voice <> '')")} AS rate FROM v GROUP BY node""")
def node_cache(spark, d):
    return su.cache_rows(latest(spark, d)).withColumn("voices", F.concat_ws(",", "voices")).orderBy(F.col("rate").desc(), "node")


@query(f"SELECT voice, sum(hits) AS hits, sum(misses) AS misses, {DIV('sum(hits)', 'sum(hits + misses)')} AS rate FROM v WHERE voice <> '' GROUP BY voice")
def voice_cache(spark, d):
    return su.cache_voices(latest(spark, d)).orderBy("voice")


@query(f"""SELECT count(*) AS nodes_with_cache, (SELECT node FROM c ORDER BY rate DESC, CAST(node AS BIGINT) LIMIT 1) AS best, max(rate) AS best_rate, (SELECT node FROM c ORDER BY rate, CAST(node AS BIGINT) LIMIT 1) AS worst, min(rate) AS worst_rate, {DIV('sum(h)', 'sum(h + m)')} AS overall
  FROM (SELECT node, sum(hits) AS h, sum(misses) AS m, {DIV('sum(hits)', 'sum(hits + misses)')} AS rate FROM v WHERE voice <> '' GROUP BY node) c""".replace("FROM c ORDER", f"FROM (SELECT node, {DIV('sum(hits)', 'sum(hits + misses)')} AS rate FROM v WHERE voice <> '' GROUP BY node) ORDER"))
def cache_extremes(spark, d):
    rows = su.cache_rows(latest(spark, d)).withColumn("pos", F.col("node").cast("bigint"))
    return su.best_and_worst(rows, "pos")


@query("SELECT DISTINCT voice FROM v WHERE voice <> ''")
def distinct_voices(spark, d):
    return su.distinct_voices(samples(spark, d), su.HITS, su.MISSES)


@query(f"SELECT node, {DIV('ar - nr', 'ar')} * 100 AS error_rate FROM (SELECT node, sum(reqs) AS ar, sum(reqs) FILTER (voice <> '') AS nr FROM v GROUP BY node)")
def error_rate(spark, d):
    snap = latest(spark, d)
    errors = snap.filter((F.col("metric") == su.REQS) & ~sc.named_voice(F.col("labels"))).withColumn("metric", F.lit("tts_errors_total"))
    return su.error_rate(snap.unionByName(errors))


@query(f"""SELECT {DIV('sum(named_e2e)', 'sum(named_reqs)')} AS named, {DIV('sum(all_e2e)', 'sum(named_reqs)')} AS mixed, {DIV('sum(all_e2e)', 'sum(reqs)')} AS "all", {R1('avg(named_e2e / nullif(named_reqs, 0)) FILTER (named_e2e > 0)')} AS nodes FROM l""")
def latency_variants(spark, d):
    snap = latest(spark, d)
    out = None
    for v in ("named", "mixed", "all", "nodes"):
        one = su.mean_latency(snap, v).withColumnRenamed("avg_ms", v)
        out = one if out is None else out.crossJoin(one)  # single rows
    return r1(out, "nodes")


@query(f"""SELECT node, CAST(NULL AS DOUBLE) AS llm_ms, named_decode / nullif(named_reqs, 0) AS decode_ms, named_e2e / nullif(named_reqs, 0) AS total_ms, 'counter' AS source, CASE WHEN named_reqs = 0 THEN 'no named requests' END AS error FROM l""")
def node_latency(spark, d):
    return su.node_latency(latest(spark, d))


@query("""SELECT node, CASE WHEN g THEN ws + 0.5 END AS llm_ms, CASE WHEN g THEN running ELSE named_decode / nullif(named_reqs, 0) END AS decode_ms, CASE WHEN g THEN running + 100 ELSE named_e2e / nullif(named_reqs, 0) END AS total_ms, CASE WHEN g THEN 'gauge' ELSE 'counter' END AS source,
  CASE WHEN NOT g AND named_reqs = 0 THEN 'no named requests' END AS error FROM (SELECT *, CAST(node AS BIGINT) % 2 = 0 AS g FROM l)""")
def node_latency_gauges(spark, d):
    """Nodes with even numbers report gauges, the first one in two samples."""
    snap = latest(spark, d)
    even = snap.filter(F.col("node").cast("bigint") % 2 == 0)
    gauge = lambda m, g, more: even.filter(F.col("metric") == m).withColumns({"metric": F.lit(g), "value": F.col("value") + more})
    parts = [gauge(su.WS, su.GAUGES[0], 0), gauge(su.WS, su.GAUGES[0], 1), gauge(su.RUNNING, su.GAUGES[1], 0), gauge(su.RUNNING, su.GAUGES[2], 100)]
    return su.node_latency(su.either(snap, *parts))


@query("SELECT cluster, avg(running) AS value FROM l GROUP BY cluster")
def gauge_mean(spark, d):
    return su.gauge_mean(latest(spark, d), su.RUNNING, "cluster")


@query(f"""SELECT n.node, CASE WHEN l.node IS NULL THEN json_object('node', n.node, 'up', false) ELSE json_object('node', n.node, 'up', true, 'ws', ws::BIGINT, 'reqs', reqs::BIGINT, 'cache_hits', hits::BIGINT, 'cache_misses', misses::BIGINT,
  'cache_rate', {R1(DIV('hits', 'hits + misses') + ' * 100')}, 'avg_e2e_ms', {R1(DIV('named_e2e', 'named_reqs'))}) END::VARCHAR AS body FROM n LEFT JOIN l ON n.node = l.node""")
def summary_json(spark, d):
    return su.summary_json(su.node_rows(nodes(spark, d), latest(spark, d)))


@query("SELECT node, arg_min(voice, event_id) AS voice, arg_min(CAST(k AS VARCHAR), event_id) AS build FROM e GROUP BY node")
def info_labels(spark, d):
    labels = F.create_map(F.lit("voice"), F.col("voice"), F.lit("build"), F.col("k").cast("string"))
    info = events(spark, d).select("node", "event_id", F.lit("tts_engine_info").alias("metric"), labels.alias("labels"))
    return su.info_labels(info, "event_id").select("node", F.col("labels")["voice"].alias("voice"), F.col("labels")["build"].alias("build"))


@query(f"SELECT step_ms, {DIV('sum(hits)', 'sum(hits + misses)')} * 100 AS hit_rate FROM (SELECT *, ts_ms // {DAY} * {DAY} AS step_ms FROM p QUALIFY row_number() OVER (PARTITION BY node, ts_ms // {DAY} ORDER BY ts_ms DESC) = 1) GROUP BY step_ms ORDER BY step_ms DESC LIMIT 60")
def hit_rate_history(spark, d):
    return se.hit_rate_history(points(spark, d), DAY)


@query(f"SELECT mode, count(*) AS n, min(ts_ms) AS first_ms FROM (SELECT unnest(['5m', '15m', '1h', 'custom', 'live']) AS mode, unnest([300000, 900000, 3600000, {DAY}, NULL]) AS span) m, e, now WHERE span IS NULL OR ts_ms >= t - span GROUP BY mode")
def range_presets(spark, d):
    now, out = now_ms(spark, d), []
    for mode in ("5m", "15m", "1h", "custom", "live"):
        rows = se.since(events(spark, d), sc.since_ms(mode, now, now - DAY))
        out.append(rows.groupBy(F.lit(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms")))
    return su.either(*out)


@query("SELECT node, count(*) AS n FROM e WHERE voice = 'purchase' GROUP BY node")
def label_equality(spark, d):
    s = events(spark, d).withColumn("labels", F.create_map(F.lit("voice"), F.col("voice")))
    return s.filter(sc.has_label(F.col("labels"), "voice", "purchase")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT {DIV('sum(e)', 'sum(r)')} AS avg_ms, CAST(sum(r) AS BIGINT) AS total_reqs, 14400 AS window_min FROM (SELECT greatest(0, arg_max(named_reqs, ts_ms) - arg_min(named_reqs, ts_ms)) AS r, greatest(0, arg_max(named_e2e, ts_ms) - arg_min(named_e2e, ts_ms)) AS e FROM p, now WHERE ts_ms >= t - {10 * DAY} GROUP BY node HAVING count(*) >= 2)""".replace("14400 AS", "CAST(14400 AS BIGINT) AS"))
def window_latency(spark, d):
    return se.window_latency(points(spark, d), now_ms(spark, d), 10 * DAY)


@query(f"""SELECT CAST(day AS VARCHAR) AS day, count(*) AS nodes, sum(reqs) AS reqs, sum(named_reqs) AS named_reqs, sum(named_e2e) AS named_e2e, sum(hits) AS hits, sum(misses) AS misses, {DIV('sum(named_e2e)', 'sum(named_reqs)')} AS avg_ms, {DIV('sum(hits)', 'sum(hits + misses)')} * 100 AS hit_rate FROM (
  SELECT (TIMESTAMP '1970-01-01' + to_milliseconds(ts_ms + 19800000))::DATE AS day, node, {", ".join(f"greatest(0, arg_max({m}, ts_ms) - arg_min({m}, ts_ms)) AS {m}" for m in ("reqs", "named_reqs", "named_e2e", "hits", "misses"))} FROM p GROUP BY ALL) GROUP BY day""")
def daily_delta(spark, d):
    return se.daily(points(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT n.node, CASE WHEN k >= 2 THEN a END AS active, CASE WHEN k >= 2 THEN w ELSE 0 END AS ws, CASE WHEN k >= 2 AND NOT a THEN s END AS idle_since FROM n LEFT JOIN (
  SELECT node, count(*) AS k, arg_max(named_reqs, ts_ms) > arg_min(named_reqs, ts_ms) AS a, arg_max(ws, ts_ms) AS w, coalesce(max(ts_ms) FILTER (up), min(ts_ms)) AS s
  FROM (SELECT *, named_reqs > lag(named_reqs) OVER (PARTITION BY node ORDER BY ts_ms) AS up FROM p, now WHERE ts_ms >= t - {DAY}) GROUP BY node) x ON n.node = x.node""")
def activity(spark, d):
    return se.activity(nodes(spark, d), points(spark, d), now_ms(spark, d), DAY)


HISTORY_SQL = f"SELECT node, ts_ms, {DIV('named_e2e', 'named_reqs')} AS e2e_ms, {DIV('named_decode', 'named_reqs')} AS decode_ms, hits AS cache_hits, named_reqs AS reqs FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_ms) % 10 = 0"


@query(f"SELECT *, replace(replace(node, ':', '_'), '/', '_') AS node_key FROM ({HISTORY_SQL})")
def history_export(spark, d):
    return se.history(points(spark, d)).withColumn("node_key", sc.file_key(F.col("node")))


@query(f"""SELECT node, bucket, first_ms, {R1('e')} AS e2e_ms, {R1('dd')} AS decode_ms, cache_hits, label FROM (SELECT node, ts_ms // 432000000 AS bucket, min(ts_ms) AS first_ms, {DIV('coalesce(sum(e2e_ms * reqs) FILTER (reqs > 0), 0)', 'coalesce(sum(reqs) FILTER (reqs > 0), 0)')} AS e, {DIV('coalesce(sum(decode_ms * reqs) FILTER (reqs > 0), 0)', 'coalesce(sum(reqs) FILTER (reqs > 0), 0)')} AS dd, CAST(floor(avg(cache_hits)) AS BIGINT) AS cache_hits,
  strftime(TIMESTAMP '1970-01-01' + to_milliseconds(min(ts_ms) + 19800000), '%d %b %H:%M') AS label FROM ({HISTORY_SQL}) GROUP BY ALL)""")
def history_bucketed(spark, d):
    return r1(se.bucketed(se.history(points(spark, d)), 120), "e2e_ms", "decode_ms")


@query(f"SELECT node, ts_ms, named_reqs FROM p, now WHERE ts_ms >= t - {10 * DAY} QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_ms DESC) <= 5")
def history_tail(spark, d):
    since = sc.since_ms("custom", 0, now_ms(spark, d) - 10 * DAY)
    return se.tail(se.since(points(spark, d), since), 5).select("node", "ts_ms", "named_reqs")


@query("SELECT node, ts_ms FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts_ms DESC) <= 30")
def retention(spark, d):
    return se.retained(points(spark, d), 30).select("node", "ts_ms")


@query("SELECT node, least(count(DISTINCT ts_ms), 1440) AS snapshots, min(ts_ms) AS oldest_ts, CAST(1440 AS BIGINT) AS max_snapshots FROM p GROUP BY node")
def buffer_info(spark, d):
    return se.buffer_info(points(spark, d))


@query(f"SELECT node, ts_ms, {DIV('all_e2e', 'reqs')} AS e2e_ms, ws FROM p")
def latency_series(spark, d):
    return se.latency_series(points(spark, d))


@query("""SELECT node, ts_ms, key, CAST(row_number() OVER (PARTITION BY node, island ORDER BY ts_ms) - 1 AS BIGINT) AS unchanged, row_number() OVER (PARTITION BY node, island ORDER BY ts_ms) > 3 AS paused
  FROM (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT node, ts_ms, key, CASE WHEN key IS NOT DISTINCT FROM lag(key) OVER (PARTITION BY node ORDER BY ts_ms) AND row_number() OVER (PARTITION BY node ORDER BY ts_ms) > 1 THEN 0 ELSE 1 END AS new
  FROM (SELECT node, ts_ms, CAST(k // 34 AS VARCHAR) || '|' || CASE WHEN voice = '' THEN 'e' ELSE 'v' END AS key FROM e)))""")
def unchanged_runs(spark, d):
    key = sc.fingerprint(F.floor(F.col("k") / 34), F.when(F.col("voice") == "", "e").otherwise("v"))
    return se.unchanged_runs(events(spark, d).select("node", "ts_ms", key.alias("key")), "key", "ts_ms", part=("node",))


@query(f"SELECT voice, {R1('avg(cents)')} AS mean, max(cents)::DOUBLE AS max, arg_max(cents, event_id)::DOUBLE AS last FROM e GROUP BY voice")
def panel_legend(spark, d):
    series = events(spark, d).select("voice", F.col("event_id").alias("ts_ms"), F.col("cents").cast("double").alias("value"))
    return r1(su.legend(series, ("voice",)), "mean")


def panel_samples(spark, d):
    """Users as GPUs of two jobs: memory used and free in MiB, and whether they are up."""
    e = events(spark, d)
    labels = F.create_map(F.lit("job"), F.col("cluster"), F.lit("instance"), F.col("node"))
    gauges = F.array(F.struct(F.lit("DCGM_FI_DEV_FB_USED").alias("metric"), F.col("cents").cast("double").alias("value")), F.struct(F.lit("DCGM_FI_DEV_FB_FREE").alias("metric"), (F.col("k") * 100).cast("double").alias("value")), F.struct(F.lit("up").alias("metric"), F.when(F.col("voice") == "", 0.0).otherwise(1.0).alias("value")))
    return e.select("node", "ts_ms", labels.alias("labels"), F.inline(gauges)).withColumns({"job": F.col("labels")["job"], "instance": F.col("labels")["instance"]})


@query(f"SELECT cluster AS job, node AS instance, ts_ms, {DIV('cents', 'cents + k * 100')} * 100 AS value, CASE WHEN {DIV('cents', 'cents + k * 100')} * 100 >= 90 THEN 'red' WHEN {DIV('cents', 'cents + k * 100')} * 100 >= 70 THEN 'yellow' ELSE 'green' END AS colour FROM e WHERE cluster = 'c1'")
def panel_memory(spark, d):
    s = panel_samples(spark, d)
    out = su.ratio_of(su.selected(s, job="c1"), "DCGM_FI_DEV_FB_USED", "DCGM_FI_DEV_FB_FREE", sc.used_percent, ("job", "instance", "ts_ms"))
    return out.withColumn("colour", sc.threshold_colour(F.col("value"), "memory"))


@query("SELECT cluster AS job, node AS instance, arg_max(CASE WHEN voice = '' THEN 'DOWN' ELSE 'UP' END, ts_ms) AS state, arg_max(CASE WHEN voice = '' THEN 'red' ELSE 'green' END, ts_ms) AS colour FROM e GROUP BY ALL")
def panel_up(spark, d):
    last = su.selected(panel_samples(spark, d), "up").groupBy("job", "instance").agg(F.max_by("value", "ts_ms").alias("value"))
    return last.select("job", "instance", sc.up_state(F.col("value")).alias("state"), sc.up_colour(F.col("value")).alias("colour"))


@query("SELECT node, ts_ms, 'used' AS exporter, cents * 1048576.0::DOUBLE AS value FROM e UNION ALL SELECT node, ts_ms, 'free', k * 100.0::DOUBLE FROM e")
def panel_union(spark, d):
    s = panel_samples(spark, d)
    a = su.selected(s, "DCGM_FI_DEV_FB_USED").select("node", "ts_ms", F.lit("used").alias("exporter"), sc.mib_to_bytes(F.col("value")).alias("value"))
    return su.either(a, su.selected(s, "DCGM_FI_DEV_FB_FREE").select("node", "ts_ms", F.lit("free").alias("exporter"), "value"))


@query("SELECT DISTINCT node AS instance FROM e")
def panel_label_values(spark, d):
    return su.label_values(panel_samples(spark, d), "up", "instance")


@query("SELECT node, metric, count(*) AS n, sum(value) AS value FROM (SELECT node, 'DCGM_FI_DEV_FB_USED' AS metric, cents::DOUBLE AS value FROM e WHERE node = '7' UNION ALL SELECT node, 'DCGM_FI_DEV_FB_FREE', k * 100.0::DOUBLE FROM e WHERE node = '7' UNION ALL SELECT node, 'up', CASE WHEN voice = '' THEN 0.0::DOUBLE ELSE 1.0 END FROM e WHERE node = '7') GROUP BY ALL")
def panel_explorer(spark, d):
    return su.selected(panel_samples(spark, d), instance="7").groupBy("node", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("SELECT section, name, n, n::DOUBLE / (sum(n) OVER (PARTITION BY section))::DOUBLE * 100 AS share FROM (SELECT l_returnflag AS section, l_linestatus AS name, count(*) AS n FROM lineitem GROUP BY 1, 2)", common=False)
def capacity_shares(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    freq = c.groupBy(F.col("l_returnflag").alias("section")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("config_freq"))
    return su.shares(freq, "section", "config_freq")


@query("SELECT n_name AS name, count(*) FILTER (s_acctbal > 0) AS active, count(*) FILTER (s_acctbal > 5000) AS most, least(CASE WHEN count(*) FILTER (s_acctbal > 5000) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (s_acctbal > 0)::DOUBLE / count(*) FILTER (s_acctbal > 5000) END * 100, 100.0::DOUBLE) AS used FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", common=False)
def capacity_utilisation(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = s.groupBy(F.col("n_name").alias("name")).agg(F.count_if(F.col("s_acctbal") > 0).alias("active"), F.count_if(F.col("s_acctbal") > 5000).alias("most"))
    return out.withColumn("used", su.utilisation(F.col("active"), F.col("most")))


@query("SELECT event_id, node, voice, cents::DOUBLE AS value FROM e")
def exposition_parse(spark, d):
    lines = events(spark, d).select("event_id", "node", F.format_string('tts_e2e_ms_total{voice="%s",q="a,}b"} %d 1700000000000', "voice", "cents").alias("value"))
    comments = lines.select("event_id", "node", F.lit("# HELP tts_e2e_ms_total total").alias("value"))
    return exposition.parse(lines.unionByName(comments)).select("event_id", "node", F.col("labels")["voice"].alias("voice"), "value")


@query("SELECT node, 'tts_e2e_ms_total' AS metric, array_to_string(list(cents ORDER BY cents), ',') AS \"values\" FROM e GROUP BY node")
def exposition_bare(spark, d):
    lines = events(spark, d).select("node", F.format_string('tts_e2e_ms_total{voice="%s"} %d', "voice", "cents").alias("value"))
    out = exposition.bare_values(exposition.parse(lines), "node")
    return out.withColumn("values", F.array_join(F.transform("values", lambda x: x.cast("bigint").cast("string")), ","))


@query("SELECT event_id, node, voice, CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE k::DOUBLE END AS value FROM e WHERE k % 3 < 2")
def exposition_browser(spark, d):
    """Capital exponents end a number; NaN and lines that begin with a space don't count."""
    value = F.when(F.col("k") % 3 == 0, "1E3").when(F.col("k") % 3 == 1, F.col("k").cast("string")).otherwise("NaN")
    rows = events(spark, d).select("event_id", "node", F.concat(F.lit('m{voice="'), "voice", F.lit('"} '), value).alias("value"))
    spaced = rows.withColumn("value", F.concat(F.lit(" "), "value"))
    return exposition.parse_loose(rows.unionByName(spaced)).select("event_id", "node", F.col("labels")["voice"].alias("voice"), "value")


@query("SELECT node, cluster, ts_ms, count(*) AS n, sum(cents)::DOUBLE AS total FROM e GROUP BY ALL")
def nested_snapshots(spark, d):
    s = events(spark, d).select("node", "cluster", "ts_ms", F.lit(su.E2E).alias("metric"), F.create_map(F.lit("voice"), F.col("voice")).alias("labels"), F.col("cents").cast("double").alias("value"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x["value"])
    return exposition.snapshots(s).select("node", "cluster", "ts_ms", F.size("samples").cast("bigint").alias("n"), total.alias("total"))


@query("SELECT event_id, node, cluster, voice, cents::DOUBLE AS value FROM e")
def exposition_render(spark, d):
    s = events(spark, d).select("event_id", "node", "cluster", F.lit(su.E2E).alias("metric"), F.create_map(F.lit("voice"), F.col("voice")).alias("labels"), F.col("cents").cast("double").alias("value"))
    return exposition.parse(exposition.render(s)).select("event_id", "node", "cluster", F.col("labels")["voice"].alias("voice"), "value")


@query("SELECT '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE ':8764' END AS node, '192.0.2.' || c_custkey AS host, CASE WHEN c_custkey % 2 = 0 THEN 8080 ELSE 8764 END AS port, CASE WHEN c_nationkey % 3 = 0 THEN 'main' WHEN c_nationkey % 3 = 1 THEN 'ext2' ELSE 'multilingual' END AS cluster FROM customer", common=False)
def node_list(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_nationkey") % 3).alias("s"))
    rows = c.select(F.concat(F.lit("f"), F.col("c_custkey") % 16).alias("file"), F.col("s") * 10_000_000_000 + F.col("c_custkey") * 2 + 1, F.concat(F.lit("192.0.2."), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, ":8080").otherwise("")))
    files = c.select(F.concat(F.lit("f"), F.col("c_custkey") % 16).alias("file")).distinct()
    markers = [files.select("file", F.lit(k * 10_000_000_000), F.lit(f"# cluster:{name}")) for k, name in ((1, "ext2"), (2, "multilingual"))]
    lines = rows.union(markers[0]).union(markers[1]).toDF("file", "line", "value")
    return lists.node_list(lines).drop("line")


def node_file(spark, d):
    """Customers as one node list: every third with a comment behind, every second with a port, the last half in a section."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    node = F.concat(F.lit("192.0.2."), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, ":8080").otherwise(""), F.when(F.col("c_custkey") % 3 == 0, " # spare").otherwise(""))
    rows = c.select(F.lit("f").alias("file"), (F.col("c_custkey") * 2).alias("line"), node.alias("value"))
    marks = spark.createDataFrame([("f", 101, "# cluster:ext2"), ("f", 1, "# a comment"), ("f", 103, "  ")], "file string, line bigint, value string")
    return rows.unionByName(marks)


@query("""SELECT 'merged' AS flavour, '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE '' END AS node, 'main' AS cluster FROM customer
  UNION ALL SELECT 'always', '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE '' END || ':8764', CASE WHEN c_custkey * 2 < 101 THEN 'main' ELSE 'ext2' END FROM customer
  UNION ALL SELECT 'first', '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE ':8764' END, 'main' FROM customer WHERE c_custkey * 2 < 101
  UNION ALL SELECT 'plain', '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '#spare' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ':8764' END, CASE WHEN c_custkey * 2 < 101 THEN 'main' ELSE 'ext2' END FROM customer""", common=False)
def node_list_flavours(spark, d):
    lines = node_file(spark, d)
    kinds = {"merged": {"sections": "ignore", "inline_comments": True, "port": "never"}, "always": {"inline_comments": True, "port": "always"}, "first": {"sections": "first", "inline_comments": True}, "plain": {}}
    return su.either(*(lists.node_list(lines, **k).select(F.lit(name).alias("flavour"), "node", "cluster") for name, k in kinds.items()))


@query("""SELECT 'global:' || chr(10) || '  scrape_interval: 15s' || chr(10) || '  scrape_timeout: 10s' || chr(10) || 'scrape_configs:' || chr(10) || '  - job_name: ' || chr(39) || 'gpu_nodes' || chr(39) || chr(10) || '    static_configs:' || chr(10) || '      - targets:' || chr(10) ||
  string_agg('          - ' || chr(39) || '192.0.2.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ':8080' ELSE ':8764' END || chr(39), chr(10) ORDER BY c_custkey) || chr(10) AS value FROM customer""", common=False)
def scrape_config(spark, d):
    return lists.scrape_config(lists.node_list(node_file(spark, d), inline_comments=True))


@query("SELECT s_suppkey, s_suppkey % 50 AS active_calls, CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 0 END AS max_calls, 0::BIGINT AS vacant_slots, s_nationkey AS x, s_suppkey AS y FROM supplier", common=False)
def capacity_documents(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    most = F.when(F.col("s_suppkey") % 2 == 0, F.lit(', "max_calls": 60')).otherwise("")
    docs = s.select("s_suppkey", F.concat(F.format_string('{"active_calls": %d', (F.col("s_suppkey") % 50).cast("int")), most, F.format_string(', "VI": {"total_active": 4, "config_freq": {"x": %d, "y": %d}}}', F.col("s_nationkey").cast("int"), F.col("s_suppkey").cast("int"))).alias("value"))
    freq = lambda k: F.col("sections")["VI"]["config_freq"][k].alias(k)
    return lists.capacity(docs, keep=("s_suppkey",)).select("s_suppkey", "active_calls", "max_calls", "vacant_slots", freq("x"), freq("y"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 997 >= 1e6 THEN (p_partkey * 997 + 5000) // 1000000 || '.' || lpad(CAST((p_partkey * 997 + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || 'M' WHEN p_partkey * 997 >= 1000 THEN (p_partkey * 997 + 50) // 1000 || '.' || (p_partkey * 997 + 50) // 100 % 10 || 'K' ELSE CAST(p_partkey * 997 AS VARCHAR) END AS count, format('{:,}', p_partkey * 997) AS thousands, p_partkey // 7 AS sevenths FROM part", common=False)
def display_counts(spark, d):
    n = F.col("p_partkey") * 997
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", sc.show_count(n.cast("double")).alias("count"), sc.thousands(n).alias("thousands"), sc.floor_div(F.col("p_partkey"), F.lit(7)).alias("sevenths"))


@query("""SELECT s_nationkey, 'const NODES = [' || chr(10) || (SELECT string_agg('  "192.0.2.' || s_suppkey || ':8764",' || chr(10), '' ORDER BY s_suppkey) FROM supplier) || '];' || chr(10) || 'const ZONE = ' || s_nationkey || ';' AS value FROM (SELECT DISTINCT s_nationkey FROM supplier)""", common=False)
def page_nodes(spark, d):
    """A page per nation, with an array of two nodes that gives way to all suppliers'."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    old = F.lit('const NODES = [\n  "a",\n  "b",\n];\nconst ZONE = ')
    pages = s.select("s_nationkey").distinct().withColumn("value", F.concat(old, F.col("s_nationkey").cast("string"), F.lit(";")))
    return lists.with_node_array(pages, s.select(F.col("s_suppkey").alias("line"), F.concat(F.lit("192.0.2."), F.col("s_suppkey").cast("string"), F.lit(":8764")).alias("node")))


@query("SELECT '198.51.100.' || s_suppkey AS external_ip FROM supplier WHERE s_acctbal > 0", common=False)
def inventory_running(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lines = s.select(F.concat_ws("  ", F.lit("vm"), F.lit("zone-a"), F.lit("gpu-1"), F.lit("192.0.2.1"), F.concat(F.lit("198.51.100."), "s_suppkey"), F.when(F.col("s_acctbal") > 0, "RUNNING").otherwise("TERMINATED")).alias("value"))
    return lists.inventory(lines, "RUNNING").select("external_ip")


@query("SELECT '198.51.100.' || s_suppkey AS external_ip FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 5 <> 0", common=False)
def live_backends(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    b = F.struct((F.col("s_acctbal") > 0).alias("up"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("198.51.100."), "s_suppkey")).alias("external_ip"))
    docs = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(b).alias("backends"))).alias("value"))
    return lists.live_backends(docs)


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN printf('%.2f', p_retailprice / 1000) || 's' WHEN p_retailprice > 0 THEN printf('%.0f', p_retailprice) || 'ms' ELSE 'N/A' END AS shown, CASE WHEN p_size >= 70 THEN 'good' WHEN p_size >= 30 THEN 'moderate' ELSE 'low' END AS band, 'b.' || p_size AS short, CAST(trunc(p_retailprice) AS BIGINT) AS whole FROM part", common=False)
def display_values(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    node = F.concat(F.lit("10.a.b."), F.col("p_size"), F.lit(":8764"))
    return p.select("p_partkey", sc.show_ms(F.col("p_retailprice")).alias("shown"), sc.hit_band(F.col("p_size"), F.lit(1)).alias("band"), sc.short_node(node).alias("short"), sc.whole(F.col("p_retailprice")).alias("whole"))


@query("""SELECT r_name AS cluster, count(DISTINCT l_suppkey) AS nodes, sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END)::DOUBLE AS named_reqs, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", common=False)
def region_rollup(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    li = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") != "N", 1).otherwise(0)).alias("r"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    own = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = li.join(own, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.groupBy(F.col("r_name").alias("cluster")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("r").cast("double").alias("named_reqs"), F.sum("q").cast("double").alias("quantity"))
