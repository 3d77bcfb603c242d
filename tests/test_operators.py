from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.functions import scalars as sc
from fleetgauge.operators import series as se
from fleetgauge.operators import summaries as su
from fleetgauge.sources import exposition

T0 = 1704067200000


def samples(spark, rows):
    return spark.createDataFrame([(n, "main", t, m, {} if v is None else {"voice": v}, float(x)) for n, t, m, v, x in rows], schemas.SAMPLES)


@pytest.fixture(scope="module")
def g2(spark):
    n1 = [(su.REQS, "a", 10), (su.REQS, "b", 30), (su.REQS, "", 5), (su.E2E, "a", 5000), (su.E2E, "b", 27000), (su.E2E, "", 90000), (su.HITS, "a", 6), (su.HITS, "b", 20), (su.MISSES, "a", 4), (su.MISSES, "b", 10), (su.WS, None, 4), (su.RUNNING, None, 3)]
    n2 = [(su.REQS, "a", 20), (su.E2E, "a", 8000), (su.WS, None, 0)]
    return samples(spark, [("n1", T0, *x) for x in n1] + [("n2", T0, *x) for x in n2])


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(f"n{i}", "main") for i in (1, 2, 3)], "node string, cluster string")


def test_summaries(g2, listed):
    rows = {r.node: r for r in su.node_rows(listed, su.latest(g2)).collect()}
    assert (rows["n1"].ws, rows["n1"].reqs, rows["n1"].hits, rows["n1"].hit_rate, rows["n1"].avg_ms) == (4, 45, 26, 65.0, 800.0)
    assert (rows["n2"].up, rows["n2"].hit_rate, rows["n2"].avg_ms) == (True, 0.0, 400.0)
    assert (rows["n3"].up, rows["n3"].ws, rows["n3"].avg_ms) == (False, None, None)
    c = su.cluster_rows(su.node_rows(listed, su.latest(g2))).first()
    assert (c.total_nodes, c.up_nodes, c.total_ws, c.avg_ws_per_active, c.total_reqs, c.hit_rate, c.avg_ms, c.max_ms) == (3, 2, 4, 4.0, 65, 65.0, 600.0, 800.0)
    assert su.running_mean(g2).first().mean_running == 1.5
    assert [r.node for r in su.down_nodes(listed, g2).collect()] == ["n3"]


def test_latency_variants(g2, listed):
    one = su.selected(g2).filter("node = 'n1'")
    assert round(su.mean_latency(one, "mixed").first().avg_ms, 2) == 3050.0
    assert round(su.mean_latency(one, "all").first().avg_ms, 2) == 2711.11
    f = su.fleet_stats(listed, g2).withColumn("shown", sc.show_ms(F.col("avg_ms"))).first()
    assert (round(f.avg_ms, 2), f.shown) == (666.67, "667ms")
    assert su.single_summary(one).first().avg_ms == 3050.0


def test_fleet_fallback_and_gauges(spark, listed):
    s = samples(spark, [("n1", T0, su.REQS, "", 10), ("n1", T0, su.E2E, "", 2000), ("n2", T0, su.GAUGES[0], "a", 20), ("n2", T0, su.GAUGES[1], "a", 500), ("n2", T0, su.GAUGES[2], "a", 1000)])
    assert su.fleet_stats(listed, s).first().avg_ms == 200.0
    r = {x.node: x for x in su.node_latency(s).collect()}
    assert (r["n2"].source, r["n2"].total_ms) == ("gauge", 1000.0)
    assert (r["n1"].source, r["n1"].total_ms, r["n1"].error) == ("counter", None, "no named requests")


def steps(spark, reqs, e2e=None, node="n1"):
    rows = []
    for i, r in enumerate(reqs):
        rows.append((node, T0 + 15000 * i, su.REQS, "a", r))
        if e2e:
            rows.append((node, T0 + 15000 * i, su.E2E, "a", e2e[i]))
    return se.points(samples(spark, rows))


def test_windows(spark, listed):
    p = steps(spark, [100, 100, 104, 104, 104], [50000, 50000, 52400, 52400, 52400])
    now = T0 + 60_000
    w = se.window_latency(p, now).first()
    assert (w.avg_ms, w.total_reqs, w.window_min) == (600.0, 4, 60)
    one = listed.filter("node = 'n1'")
    got = lambda ms: tuple(se.activity(one, p, now, ms).first())[1:]
    assert got(300_000) == (True, 0.0, None)
    assert got(20_000) == (False, 0.0, T0 + 45_000)
    assert got(10_000) == (None, 0.0, None)
    reset = steps(spark, [100, 106, 3])
    assert se.window_latency(reset, T0 + 30_000).first().total_reqs == 0
    assert tuple(se.activity(one, reset, T0 + 30_000).first())[1:] == (False, 0.0, T0 + 15_000)
    with pytest.raises(ValueError):
        se.tail(p, -1)
    assert se.tail(p, 2).count() == 2 and se.tail(p, 0).count() == 5 and se.since(p, T0 + 30_000).count() == 3
    i = se.buffer_info(p).first()
    assert (i.snapshots, i.oldest_ts, i.max_snapshots) == (5, T0, 1440)


def test_local_day(spark):
    before, after = T0 + 66_590_000, T0 + 66_605_000  # 18:29:50 and 18:30:05
    p = se.points(samples(spark, [("n1", T0, su.REQS, "a", 1), ("n1", before, su.REQS, "a", 5), ("n1", after, su.REQS, "a", 9)]))
    assert {str(r.day): r.named_reqs for r in se.daily(p).collect()} == {"2024-01-01": 4.0, "2024-01-02": 0.0}


def test_buckets(spark, tmp_path):
    h = 3_600_000
    rec = spark.createDataFrame([("n/1:2", T0, 500.0, 200.0, 10.0, 10.0), ("n/1:2", T0 + h, 700.0, 300.0, 21.0, 30.0), ("n/1:2", T0 + 2 * h, 0.0, 0.0, 21.0, 0.0), ("n/1:2", T0 + 4 * h, 800.0, 350.0, 30.0, 40.0)], schemas.HISTORY)
    se.write_history(rec, str(tmp_path / "h"))
    back = se.read_history(spark, str(tmp_path / "h"))
    got = [(r.label, r.e2e_ms, r.decode_ms, r.cache_hits) for r in se.bucketed(back).orderBy("bucket").collect()]
    assert got == [("01 Jan 05:30", 650.0, 275.0, 17), ("01 Jan 09:30", 800.0, 350.0, 30)]


def test_unchanged(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("AAAABB")], "t int, key string")
    rows = se.unchanged_runs(df.withColumn("s", F.lit(1)), "key", "t", ("s",)).orderBy("t").collect()
    assert [r.unchanged for r in rows] == [0, 1, 2, 3, 0, 1] and [r.paused for r in rows] == [False, False, False, True, False, False]


def test_cache(spark):
    s = samples(spark, [("n1", T0, su.HITS, "a", 7), ("n1", T0, su.MISSES, "a", 3), ("n2", T0, su.HITS, "b", 7), ("n2", T0, su.MISSES, "b", 3), ("n3", T0, su.HITS, "a", 0), ("n4", T0, su.WS, None, 1)])
    rows = su.cache_rows(s).withColumn("pos", F.substring("node", 2, 1).cast("int"))
    b = su.best_and_worst(rows, "pos").first()
    assert (b.nodes_with_cache, b.best, b.best_rate, b.worst, b.worst_rate, b.overall) == (3, "n1", 0.7, "n3", 0.0, 0.7)
    assert [r.node for r in rows.filter("has_cache").orderBy(F.col("rate").desc(), "pos").collect()] == ["n1", "n2", "n3"]


def test_capacity_and_formats(spark):
    c = spark.createDataFrame([("VI", {"x": 3, "y": 1}), ("E", {})], "section string, f map<string,bigint>")
    assert {(r.name, r.share) for r in su.shares(c, "section", "f").collect()} == {("x", 75.0), ("y", 25.0)}
    r = spark.range(1).select(su.utilisation(F.lit(45), F.lit(60)), su.utilisation(F.lit(5), F.lit(0)), sc.show_ms(F.lit(1500.0)), sc.show_ms(F.lit(999.0)), sc.show_ms(F.lit(0.0)), sc.show_count(F.lit(1234.0)), sc.show_count(F.lit(2.5e6)), sc.show_count(F.lit(None).cast("double")), sc.hit_band(F.lit(70.0), F.lit(1)), sc.hit_band(F.lit(30.0), F.lit(1)), sc.hit_band(F.lit(29.9), F.lit(1)), sc.hit_band(F.lit(0.0), F.lit(0)), sc.rounded(F.lit(0.25)), sc.whole(F.lit(-2.7))).first()
    assert tuple(r) == (75.0, 0.0, "1.50s", "999ms", "N/A", "1.2K", "2.50M", "-", "good", "moderate", "low", "no data", 0.2, -2)


def test_order_and_split_invariance(g2, listed):
    a = su.node_rows(listed, su.latest(g2)).orderBy("node").collect()
    assert sorted(map(str, su.latest(g2).collect())) == sorted(map(str, su.latest_nested(exposition.snapshots(g2)).collect()))
    assert su.latest(g2, 5, T0 + 6).isEmpty() and su.latest_nested(exposition.snapshots(g2), 5, T0 + 6).isEmpty()
    low = su.node_rows(listed, g2).withColumn("avg_ms", F.when(F.col("node") == "n2", 0.04).otherwise(F.col("avg_ms")))
    assert su.cluster_rows(low).first().avg_ms == 800.0 and su.cluster_rows(low, None).first().avg_ms == 400.02
    halves = g2.withColumn("value", F.col("value") / 2)
    assert su.node_rows(listed, su.latest(halves.unionByName(halves).repartition(7))).orderBy("node").collect() == a
