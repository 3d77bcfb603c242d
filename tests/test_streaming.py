from __future__ import annotations

import json

from fleetgauge.streaming import flows


def test_batch_equals_stream_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS)
    out = str(tmp_path / "sent")

    def send(rows):
        with open(out, "a") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)

    (tmp_path / "in").mkdir()
    for part, keys in enumerate(("AA", "AAB", "B")):
        rows = [{"series": "s", "ts_ms": part * 10 + i, "key": k} for i, k in enumerate(keys)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, rows)))
        reports = spark.readStream.schema("series string, ts_ms bigint, key string").json(str(tmp_path / "in"))
        q = flows.alerts(flows.unchanged_stream(reports), send, str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    sent = [json.loads(x) for x in open(out)]
    assert [r["unchanged"] for r in sent] == [0, 1, 2, 3, 0, 1]
    assert [r["paused"] for r in sent] == [False, False, False, True, False, False]


def test_landed_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"node": "n", "cluster": "c", "ts_ms": t, "value": f"m {v}"} for t, v in ((1000, 1), (2000, 9), (3000, 4), (61000, 61), (62000, 2))]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    counts = flows.bucket_deltas(flows.landed_samples(spark, str(tmp_path / "in")), 60_000)
    q = counts.writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.bucket_ms, r.n, r.first, r.last, r.delta) for r in spark.table("buckets").collect()) == [(0, 3, 1.0, 4.0, 3.0), (60_000, 2, 61.0, 2.0, 0.0)]


def test_daily_deltas(spark):
    day = 1704067200000
    times = [(day, 1.0), (day + 66_590_000, 5.0), (day + 66_605_000, 9.0), (day + 66_615_000, 12.0)]  # 18:29:50, 18:30:05 and 18:30:15
    df = spark.createDataFrame([("n", "m", t, v) for t, v in times], "node string, metric string, ts_ms bigint, value double")
    got = {r.bucket_ms: r.delta for r in flows.daily_deltas(df.selectExpr("*", "timestamp_millis(ts_ms) AS ts")).collect()}
    assert got == {day - 19_800_000: 4.0, day - 19_800_000 + 86_400_000: 3.0}


def test_throttle_counts_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS)
    (tmp_path / "in").mkdir()
    for part, n in enumerate((4, 3)):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"node": "a", "ts_ms": part * 10 + i}) for i in range(n)))
        rows = spark.readStream.schema("node string, ts_ms bigint").json(str(tmp_path / "in"))
        q = flows.throttled(rows, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.ts_ms for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 11]
