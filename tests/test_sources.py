from __future__ import annotations

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from fleetgauge.sources import exposition, lists
from fleetgauge.sources.live import ExpositionSource


def parsed(spark, line):
    rows = exposition.parse(spark.createDataFrame([(line,)], "value string")).collect()
    return [(r.metric, r.labels, r.value) for r in rows]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('m{voice="a"} 10', ("m", {"voice": "a"}, 10.0)),
        ('m{voice=""} 3', ("m", {"voice": ""}, 3.0)),
        ("m 5", ("m", {}, 5.0)),
        ("m{} 5", ("m", {}, 5.0)),
        ("m +Inf", ("m", {}, float("inf"))),
        ("m 1.5E3", ("m", {}, 1500.0)),
        ('m{v="b"} 7 1700000000000', ("m", {"v": "b"}, 7.0)),
        ("m 7 1700000000000", ("m", {}, 7.0)),
        ('m{voice="a,b",q="z"} 1', ("m", {"voice": "a,b", "q": "z"}, 1.0)),
        ('m{voice="}"} 9', ("m", {"voice": "}"}, 9.0)),
        ("  m 5", ("m", {}, 5.0)),
        ('m{v="a",v="b"} 1', ("m", {"v": "b"}, 1.0)),
        (r'm{v="a\"b"} 1', ("m", {"v": 'a"b'}, 1.0)),
        (r'm{v="a\\n"} 1', ("m", {"v": "a\\n"}, 1.0)),
        (r'm{v="a\n\\\"\\"} 1', ("m", {"v": 'a\n\\"\\'}, 1.0)),
        ('m{v="\x01|"} 1', ("m", {"v": "\x01|"}, 1.0)),
    ],
)
def test_lines(spark, line, want):
    assert parsed(spark, line) == [want]


@pytest.mark.parametrize("line", ["m foo", "", "   ", "# HELP m x", "m 1_000", "m", "m 1\x01", "m\x011\x01", "\x02m\x011\x01"])
def test_dropped(spark, line):
    assert parsed(spark, line) == []


def test_nan_and_finite_only(spark):
    df = spark.createDataFrame([("m NaN",), ("m 1",)], "value string")
    assert exposition.parse(df).filter(F.isnan("value")).count() == 1
    assert [r.value for r in exposition.parse(df, finite_only=True).collect()] == [1.0]


def test_render_is_the_inverse_of_parse(spark):
    rows = [("m", {"a": 'x\\n"y\n\\', "b": ""}, 1.5), ("m", {}, float("inf")), ("n", {"c": "}, {"}, -2e-9)]
    lines = exposition.render(spark.createDataFrame(rows, "metric string, labels map<string,string>, value double"))
    assert not lines.filter(F.col("value").contains("\n")).count()
    assert sorted((r.metric, sorted(r.labels.items()), r.value) for r in exposition.parse(lines).collect()) == sorted((m, sorted(x.items()), v) for m, x, v in rows)


@pytest.mark.parametrize(("line", "want"), [('m{v="a\\"} 1.5e3 17', [("m", {"v": "a\\"}, 1500.0)]), ("m 1E3", [("m", {}, 1.0)]), (" m 1", []), ("m NaN", []), ("m +Inf", []), ('m{v="}"} 9', []), ("# m 1", []), ("m -.5.", [("m", {}, -0.5)])])
def test_browser_flavour(spark, line, want):
    assert [(r.metric, r.labels, r.value) for r in exposition.parse_loose(spark.createDataFrame([(line,)], "value string")).collect()] == want


def test_node_lists(spark, tmp_path):
    f = tmp_path / "ips.txt"
    f.write_text("# comment\n192.0.2.1:8080\n192.0.2.2 # spare\n# cluster:ext2\n192.0.2.11:8080\n# cluster:multilingual\n192.0.2.21:8080\n\n")
    lines = lists.read_lines(spark, str(f))
    got = lambda **k: [(r.node, r.cluster) for r in lists.node_list(lines, **k).orderBy("line").collect()]
    assert got(inline_comments=True) == [("192.0.2.1:8080", "main"), ("192.0.2.2:8764", "main"), ("192.0.2.11:8080", "ext2"), ("192.0.2.21:8080", "multilingual")]
    assert [x for x, _ in got(sections="ignore", inline_comments=True, port="never")] == ["192.0.2.1:8080", "192.0.2.2", "192.0.2.11:8080", "192.0.2.21:8080"]
    assert [x for x, _ in got(sections="first", inline_comments=True)] == ["192.0.2.1:8080", "192.0.2.2:8764"]
    assert got(port="always", inline_comments=True)[0][0] == "192.0.2.1:8080:8764"
    text = lists.scrape_config(lists.node_list(lines, inline_comments=True)).first().value
    assert "          - '192.0.2.2:8764'\n" in text and text.startswith("global:")
    page = spark.createDataFrame([("a\nconst NODES = [\n  \"x\",\n];\nconst ZONES = [1];",), ("no array",), (None,)], "value string")
    first = lists.node_list(lines, sections="first", inline_comments=True)
    want = 'a\nconst NODES = [\n  "192.0.2.1:8080",\n  "192.0.2.2:8764",\n];\nconst ZONES = [1];'
    assert [r.value for r in lists.with_node_array(page, first).collect()] == [want, "no array", None]
    odd = first.withColumn("node", F.lit("$1\\"))
    assert lists.with_node_array(page, odd).first().value.count('"$1\\",') == 2 and "[\n];" in lists.with_node_array(page, first.limit(0)).first().value


def test_documents(spark):
    b = spark.createDataFrame([('{"backends":[{"up":true,"external_ip":"A"},{"up":false,"external_ip":"B"},{"up":true,"external_ip":null}]}',)], "value string")
    assert [r[0] for r in lists.live_backends(b).collect()] == ["A"]
    c = spark.createDataFrame([('{"active_calls":45,"max_calls":60,"VI":{"total_active":4,"config_freq":{"x":3,"y":1}}}',)], "value string")
    r = lists.capacity(c).first()
    assert (r.active_calls, r.vacant_slots, r.sections["VI"].config_freq) == (45, 0, {"x": 3, "y": 1})
    inv = spark.createDataFrame([("a z t 10.0.0.1 192.0.2.9 RUNNING",), ("b z t 10.0.0.2 192.0.2.8 TERMINATED",)], "value string")
    assert [x.external_ip for x in lists.inventory(inv, "RUNNING").collect()] == ["192.0.2.9"] and lists.inventory(inv).count() == 2


def test_live_pull(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'tts_requests_total{voice="a"} 3\nup 1\n')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    node = f"127.0.0.1:{server.server_port}"
    spark.dataSource.register(ExpositionSource)
    rows = spark.read.format("exposition").option("nodes", f"{node},127.0.0.1:1").option("timeout", "2").load()
    got = exposition.parse(rows).collect()
    stream = spark.readStream.format("exposition").option("nodes", node).load()
    q = exposition.parse(stream).writeStream.format("memory").queryName("pulled").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path)).start()
    began = time.monotonic()
    while time.monotonic() - began < 60 and spark.table("pulled").select("ts_ms").distinct().count() < 2:
        time.sleep(0.5)
    q.stop()
    server.shutdown()
    pulled = spark.table("pulled")
    assert pulled.select("ts_ms").distinct().count() >= 2 and {r.metric for r in pulled.collect()} == {"tts_requests_total", "up"}
    assert {(r.node, r.metric, r.value) for r in got} == {(node, "tts_requests_total", 3.0), (node, "up", 1.0)}


def test_pull_through_proxy(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(502 if "down" in self.path else 200)
            self.end_headers()
            self.wfile.write(f'up{{path="{self.path}"}} 1\n'.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(ExpositionSource)
    names = ["192.0.2.1", "192.0.2.2:8080", "down.example", "https://x.example/m?a=b"]
    rows = spark.read.format("exposition").option("nodes", ",".join(names)).option("proxy", f"http://127.0.0.1:{server.server_port}/proxy").option("per_task", 3).load()
    assert rows.rdd.getNumPartitions() == 2
    got = {r.node: r.labels["path"] for r in exposition.parse(rows).collect()}
    direct = spark.read.format("exposition").option("nodes", f"127.0.0.1:{server.server_port}").option("path", "/down").load()
    assert [r.value for r in direct.collect()] == ['up{path="/down"} 1']  # a node's own status doesn't matter
    server.shutdown()
    assert got == {"192.0.2.1": "/proxy?host=192.0.2.1", "192.0.2.2:8080": "/proxy?host=192.0.2.2:8080", "https://x.example/m?a=b": "/proxy?host=https://x.example/m%3Fa%3Db"}
