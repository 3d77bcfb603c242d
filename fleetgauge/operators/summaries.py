"""Latest snapshots, node and cluster summaries, and what is derived from them. All take long sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import named_voice, percent, ratio, ratio_or_null, selector

REQS, E2E, DECODE = "tts_requests_total", "tts_e2e_ms_total", "tts_decode_ms_total"
HITS, MISSES = "tts_cache_hits_total", "tts_cache_misses_total"
WS, RUNNING = "tts_active_websockets", "vllm:num_requests_running"


def metric_sum(name: str, where: Column | None = None) -> Column:
    """Aggregate: sum of a metric's samples, of those that meet a condition; 0 if there are none."""
    cond = F.col("metric") == name
    return F.coalesce(F.sum(F.when(cond if where is None else cond & where, F.col("value"))), F.lit(0.0))


def has_metric(*names: str) -> Column:
    """Aggregate: whether a metric was reported at all."""
    return F.bool_or(F.col("metric").isin(*names))


def latest(samples: DataFrame, max_age_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """The samples of each node's last snapshot, in one pass. A node stays up without limit unless max_age_ms is given."""
    last = samples.withColumn("_last", F.max("ts_ms").over(W.partitionBy("node"))).filter(F.col("ts_ms") == F.col("_last")).drop("_last")
    return last if max_age_ms is None else last.filter(F.col("ts_ms") >= F.lit(now_ms) - max_age_ms)


def latest_nested(snapshots: DataFrame, max_age_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """latest() of nested snapshots (node, cluster, ts_ms, samples): only each task's last snapshot of a node is shuffled, and
    only the last of all is unfolded."""
    last = snapshots.groupBy("node").agg(F.max("ts_ms").alias("ts_ms"), F.max_by(F.struct("cluster", "samples"), "ts_ms").alias("_s"))
    if max_age_ms is not None:
        last = last.filter(F.col("ts_ms") >= F.lit(now_ms) - max_age_ms)
    return last.select("node", F.col("_s")["cluster"].alias("cluster"), "ts_ms", F.inline(F.col("_s")["samples"]))


def node_rows(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row per listed node: up, ws, reqs, hits, misses, hit_rate and avg_ms (named voices). Nodes without a snapshot
    are down and have nulls. snapshot: latest()."""
    named = named_voice(F.col("labels"))
    sums = snapshot.groupBy("node").agg(metric_sum(WS).alias("ws"), metric_sum(REQS).alias("reqs"), metric_sum(HITS).alias("hits"), metric_sum(MISSES).alias("misses"), metric_sum(E2E, named).alias("_e2e"), metric_sum(REQS, named).alias("_named"), F.lit(True).alias("_up"))
    joined = nodes.join(sums, "node", "left")
    return joined.select("node", "cluster", F.coalesce("_up", F.lit(False)).alias("up"), "ws", "reqs", "hits", "misses", F.when(F.col("_up"), percent(F.col("hits"), F.col("hits") + F.col("misses"))).alias("hit_rate"), F.when(F.col("_up"), ratio(F.col("_e2e"), F.col("_named"))).alias("avg_ms"))


def cluster_rows(rows: DataFrame, digits: int | None = 1) -> DataFrame:
    """Rollup of node_rows() per cluster; the mean latency is the plain mean of the nodes' means above 0, each rounded to
    digits before (ties up; None: as they are), so that a node whose mean rounds to 0 doesn't count."""
    active = F.count_if(F.col("up") & (F.col("ws") > 0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    scale = 1.0 if digits is None else 10.0**digits
    scaled = F.col("avg_ms") if digits is None else F.floor(F.col("avg_ms") * scale + 0.5)  # whole numbers have exact sums
    positive = F.when(scaled > 0, scaled)
    return rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if("up").alias("up_nodes"), active.alias("active_nodes"), total("ws").alias("total_ws"), ratio(total("ws"), active).alias("avg_ws_per_active"), total("reqs").alias("total_reqs"), total("hits").alias("hits"), total("misses").alias("misses"),
        percent(total("hits"), total("hits") + total("misses")).alias("hit_rate"), F.coalesce(F.sum(positive) / F.count(positive) / scale, F.lit(0.0)).alias("avg_ms"), F.coalesce(F.max(positive) / scale, F.lit(0.0)).alias("max_ms"),
    )


def single_summary(snapshot: DataFrame, n_nodes: int = 7) -> DataFrame:
    """One endpoint that stands for n_nodes: latency is all voices' time over named requests."""
    named = metric_sum(REQS, named_voice(F.col("labels")))
    hits, misses, ws, e2e = (metric_sum(m) for m in (HITS, MISSES, WS, E2E))
    return snapshot.agg(F.lit(n_nodes).alias("total_nodes"), ws.alias("total_ws"), (ws / n_nodes).alias("avg_ws_per_node"), metric_sum(REQS).alias("total_reqs"), hits.alias("hits"), misses.alias("misses"), percent(hits, hits + misses).alias("hit_rate"), ratio(e2e, named).alias("avg_ms"))


def fleet_stats(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row for an alert: a node without named requests counts with all its voices. Empty rates are null."""
    named = named_voice(F.col("labels"))
    per = snapshot.groupBy("node").agg(metric_sum(WS).alias("ws"), metric_sum(REQS, named).alias("nr"), metric_sum(E2E, named).alias("ne"), metric_sum(REQS).alias("ar"), metric_sum(E2E).alias("ae"), metric_sum(HITS).alias("h"), metric_sum(MISSES).alias("m"))
    pick = lambda a, b: F.when(F.col("nr") == 0, F.col(b)).otherwise(F.col(a))
    per = nodes.select("node").join(per, "node", "left").select("node", (F.col("ws").isNotNull()).alias("up"), "ws", pick("nr", "ar").alias("r"), pick("ne", "ae").alias("e"), "h", "m")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("up").alias("up_nodes"), s("ws").alias("total_ws"), s("r").alias("total_reqs"), ratio_or_null(s("e"), s("r")).alias("avg_ms"), (ratio_or_null(s("h"), s("h") + s("m")) * 100).alias("hit_rate"))


def down_nodes(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    return nodes.join(snapshot.select("node").distinct(), "node", "left_anti")


def running_mean(samples: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Mean over nodes of the running requests; a snapshot without the metric counts as 0."""
    per = samples.groupBy(*keys, "node").agg(metric_sum(RUNNING).alias("running"))
    return per.groupBy(*keys).agg(F.avg("running").alias("mean_running"), F.count(F.lit(1)).alias("nodes"))


def concurrency(samples: DataFrame, every_ms: int) -> DataFrame:
    """Series of running_mean() per cluster: each node's last snapshot within each step."""
    step = F.floor(F.col("ts_ms") / every_ms) * every_ms
    last = samples.withColumn("step_ms", step).groupBy("cluster", "step_ms", "node", "ts_ms").agg(metric_sum(RUNNING).alias("running")).groupBy("cluster", "step_ms", "node").agg(F.max_by("running", "ts_ms").alias("running"))
    return last.groupBy("cluster", "step_ms").agg(F.avg("running").alias("mean_running"))


def voice_rows(snapshot: DataFrame, keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """Per voice that reports requests: requests, mean latencies, short audio and tokens."""
    by = snapshot.withColumn("voice", F.col("labels")["voice"]).groupBy(*keys, "voice").agg(has_metric(REQS).alias("_has"), metric_sum(REQS).alias("reqs"), metric_sum(E2E).alias("_e"), metric_sum(DECODE).alias("_d"), metric_sum("tts_short_audio_total").alias("short_audio"), metric_sum("tts_tokens_total").alias("tokens"))
    return by.filter("_has AND voice IS NOT NULL").select(*keys, "voice", "reqs", ratio(F.col("_e"), F.col("reqs")).alias("avg_ms"), ratio(F.col("_d"), F.col("reqs")).alias("avg_decode_ms"), "short_audio", "tokens")


def cache_rows(snapshot: DataFrame) -> DataFrame:
    """Per node, named voices only: hits, misses, rate as a fraction, whether it reports a cache, voices with hits."""
    named = named_voice(F.col("labels"))
    by = snapshot.withColumn("voice", F.col("labels")["voice"]).groupBy("node", "voice").agg(metric_sum(HITS, named).alias("h"), metric_sum(MISSES, named).alias("m"), has_metric(HITS, MISSES).alias("c"))
    out = by.groupBy("node").agg(F.sum("h").alias("hits"), F.sum("m").alias("misses"), F.bool_or("c").alias("has_cache"), F.array_sort(F.collect_list(F.when(F.col("h") > 0, F.col("voice")))).alias("voices"))
    return out.withColumn("rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def cache_voices(snapshot: DataFrame) -> DataFrame:
    """Per named voice over all nodes; voices of either metric."""
    own = snapshot.filter(F.col("metric").isin(HITS, MISSES) & named_voice(F.col("labels"))).withColumn("voice", F.col("labels")["voice"])
    out = own.groupBy("voice").agg(metric_sum(HITS).alias("hits"), metric_sum(MISSES).alias("misses"))
    return out.withColumn("rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def best_and_worst(rows: DataFrame, order: str) -> DataFrame:
    """Over cache_rows() with a cache and traffic or not: best and worst rate, the first in order on ties; overall rate; count."""
    first = F.struct(F.col("rate"), F.col(order))
    best = F.max_by("node", F.struct(F.col("rate"), -F.col(order)))
    h, m = F.coalesce(F.sum("hits"), F.lit(0.0)), F.coalesce(F.sum("misses"), F.lit(0.0))
    return rows.filter("has_cache").agg(F.count(F.lit(1)).alias("nodes_with_cache"), best.alias("best"), F.max("rate").alias("best_rate"), F.min_by("node", first).alias("worst"), F.min("rate").alias("worst_rate"), ratio(h, h + m).alias("overall"))


def distinct_voices(samples: DataFrame, *metrics: str) -> DataFrame:
    """Named voices of any of the metrics."""
    return samples.filter(F.col("metric").isin(*metrics) & named_voice(F.col("labels"))).select(F.col("labels")["voice"].alias("voice")).distinct()


def error_rate(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("node").agg(percent(metric_sum("tts_errors_total"), metric_sum(REQS)).alias("error_rate"))


def info_labels(snapshot: DataFrame, order: str, metric: str = "tts_engine_info") -> DataFrame:
    """Labels of each node's first info sample by the column order (the line of the text, for instance)."""
    return snapshot.filter(F.col("metric") == metric).groupBy("node").agg(F.min_by("labels", order).alias("labels"))


def summary_json(rows: DataFrame) -> DataFrame:
    """(node, body): node_rows() as JSON objects; whole counts, rate and latency to one decimal; a down node has no more
    than its name and state."""
    whole = lambda c, n: F.col(c).cast("bigint").alias(n)
    up = F.to_json(F.struct("node", "up", whole("ws", "ws"), whole("reqs", "reqs"), whole("hits", "cache_hits"), whole("misses", "cache_misses"), (F.floor(F.col("hit_rate") * 10 + 0.5) / 10).alias("cache_rate"), (F.floor(F.col("avg_ms") * 10 + 0.5) / 10).alias("avg_e2e_ms")))
    return rows.select("node", F.when(F.col("up"), up).otherwise(F.to_json(F.struct("node", "up"))).alias("body"))


def gauge_mean(samples: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Mean of a gauge's samples per key; keys without the metric have no row."""
    return samples.filter(F.col("metric") == metric).groupBy(*keys).agg(F.avg("value").alias("value"))


GAUGES = ("tts_llm_ttft_avg_ms", "tts_dec_ttft_avg_ms", "tts_total_avg_ms")


def node_latency(snapshot: DataFrame, need_all: bool = True) -> DataFrame:
    """Per node: mean gauges if reported (all three, or at least the first), else time over requests of labelled samples
    without an empty voice; source says which, error is set where there are no requests. Counters tell how long a model
    took in all, not when its first token came, so llm_ms is null there."""
    from fleetgauge.functions.scalars import labelled_not_blank

    ok = labelled_not_blank(F.col("labels"))
    gauges = [F.avg(F.when(F.col("metric") == g, F.col("value"))) for g in GAUGES]
    seen = [has_metric(g) for g in (GAUGES if need_all else GAUGES[:1])]
    all_seen = seen[0]
    for s in seen[1:]:
        all_seen = all_seen & s
    r = metric_sum(REQS, ok)
    counters = [F.lit(None).cast("double"), *(ratio_or_null(metric_sum(m, ok), r) for m in (DECODE, E2E))]
    out = [F.when(all_seen, g).otherwise(c).alias(n) for g, c, n in zip(gauges, counters, ("llm_ms", "decode_ms", "total_ms"), strict=True)]
    return snapshot.groupBy("node").agg(*out, F.when(all_seen, "gauge").otherwise("counter").alias("source"), F.when(~all_seen & (r == 0), "no named requests").alias("error"))


def mean_latency(samples: DataFrame, variant: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean latency of one snapshot per key by formula. named: named over named (L1, L7 without its fallback, L9);
    mixed: all voices' time over named requests (L2); all: all over all (L10); nodes: plain mean of node means above 0 (L3)."""
    named = named_voice(F.col("labels"))
    if variant == "nodes":
        per = samples.groupBy(*keys, "node").agg(ratio(metric_sum(E2E, named), metric_sum(REQS, named)).alias("x"))
        return per.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("x") > 0, F.col("x"))), F.lit(0.0)).alias("avg_ms"))
    top, bottom = {"named": (named, named), "mixed": (None, named), "all": (None, None)}[variant]
    return samples.groupBy(*keys).agg(ratio(metric_sum(E2E, top), metric_sum(REQS, bottom)).alias("avg_ms"))


def selected(samples: DataFrame, metric: str | None = None, **labels: str) -> DataFrame:
    """Instant selector: a metric (or none) and label equalities."""
    out = samples.filter(selector(F.col("labels"), **labels))
    return out if metric is None else out.filter(F.col("metric") == metric)


def vector_op(a: DataFrame, b: DataFrame, fn, keys: tuple[str, ...]) -> DataFrame:
    """One-to-one vector arithmetic on equal keys; series without a partner drop out."""
    left, right = a.select(*keys, F.col("value").alias("_a")), b.select(*keys, F.col("value").alias("_b"))
    return left.join(right, list(keys)).select(*keys, fn(F.col("_a"), F.col("_b")).alias("value"))


def ratio_of(samples: DataFrame, first: str, second: str, fn, keys: tuple[str, ...]) -> DataFrame:
    """vector_op() of two metrics of one table, in one pass: each key holds one sample of either metric at most, keys with
    only one of them drop out."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    both = samples.filter(F.col("metric").isin(first, second)).groupBy(*keys).agg(pick(first).alias("_a"), pick(second).alias("_b"))
    return both.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, fn(F.col("_a"), F.col("_b")).alias("value"))


def legend(series: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean, maximum and last value that isn't null, per series."""
    ok = series.filter(F.col("value").isNotNull())
    return ok.groupBy(*keys).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.max_by("value", "ts_ms").alias("last"))


def label_values(samples: DataFrame, metric: str, label: str) -> DataFrame:
    return samples.filter(F.col("metric") == metric).select(F.col("labels")[label].alias(label)).filter(F.col(label).isNotNull()).distinct().orderBy(label)


def either(*series: DataFrame) -> DataFrame:
    """Bag union of two exporters' series."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out


def shares(counts: DataFrame, section: str, freq: str) -> DataFrame:
    """(section, name, n, share) of a map column of counts, as percent of the section's sum."""
    total = F.aggregate(F.map_values(freq), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return counts.select(section, total.alias("_total"), F.explode(freq).alias("name", "n")).select(section, "name", "n", percent(F.col("n"), F.col("_total")).alias("share"))


def utilisation(active: Column, most: Column) -> Column:
    """Percent, 0 without capacity, at most 100."""
    return F.least(percent(active, most), F.lit(100.0))
