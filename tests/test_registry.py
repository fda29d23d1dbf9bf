"""Reports by name, and the pull connector."""

import ast
import json
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest

from junctura.plans import reports
from junctura.sources import connectors
from junctura.sources.derived import Tables

FOLDER = "/root/testdata/sf0.001"


def test_listing_and_schema():
    assert len(reports.listing()) == 31
    assert reports.schema("arrival-on-red")["properties"] == {"minutes": {"type": "integer", "default": 15}, "yellow_as_red": {"type": "boolean", "default": True}, "include_permissive": {"type": "boolean", "default": False}}
    with pytest.raises(KeyError):
        reports.schema("none")


def test_run_checks_parameters(spark, tmp_path):
    tables = Tables(spark, FOLDER)
    one = reports.run(tables, "bike-volume", {"channels": [1], "minutes": 60}, signals=("SIG-001",))
    assert {(r.signal_id, r.channel) for r in one.collect()} == {("SIG-001", 1)}
    for bad in ({"minutes": "15"}, {"minutes": True}, {"color": 1}):
        with pytest.raises(ValueError):
            reports.run(tables, "bike-volume", bad)
    reports.run_and_export(tables, "preemption", str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == reports.run(tables, "preemption").count()


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_every_report_runs_with_defaults(spark, name):
    assert reports.run(Tables(spark, FOLDER), name).count() >= 0


def test_pull_source(spark, tmp_path):
    seen = []

    class Device(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            body = json.dumps([{"t": 17_000_000_000, "code": 82, "param": 5}, {"t": 17_000_000_010, "code": 81, "param": 5}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Device)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    connectors.register(spark)
    try:
        stream = spark.readStream.format("controller_pull").option("url", f"http://127.0.0.1:{server.server_port}/").option("device", "SIG-9").load()
        query = stream.writeStream.format("memory").queryName("pulled").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        rows = spark.table("pulled").orderBy("event_time").collect()
    finally:
        server.shutdown()
    assert [(r.signal_id, r.event_code, r.event_param) for r in rows] == [("SIG-9", 82, 5), ("SIG-9", 81, 5)]
    assert rows[0].event_time == datetime(2023, 11, 14, 22, 13, 20) and "since=0" in seen[0]


class Fleet:
    """Devices behind one server, by path; what each has, and which asks came."""

    def __init__(self):
        self.events, self.asked, fleet = {}, [], self

        class Device(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                name, _, query = self.path.lstrip("/").partition("?")
                fleet.asked.append((name, query))
                body = json.dumps([{"t": t, "code": c, "param": p} for t, c, p in fleet.events.get(name, [])]).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Device)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def url(self, name):
        return f"http://127.0.0.1:{self.server.server_port}/{name}"


def test_many_devices_in_one_stream(spark, tmp_path):
    fleet, now = Fleet(), int(datetime.now().timestamp() * 10)
    fleet.events = {f"d{k}": [(now - 100 - k, 82, k), (now - 50, 81, k), (now - 50, 81, k)] for k in range(5)}
    fleet.events["d0"].append((now + 864_000, 1, 2))  # a clock a day ahead
    connectors.register(spark)
    devices = {d: fleet.url(d) for d in fleet.events} | {"gone": "http://127.0.0.1:1/"}
    stream = spark.readStream.format("controller_pull").option("devices", json.dumps(devices)).option("timeout_seconds", "5").option("poll_seconds", "1").load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    schema = "signal_id string, event_time timestamp_ntz, event_code int, event_param int"
    have = lambda n: (tmp_path / "out" / "_spark_metadata" / "0").exists() and spark.read.schema(schema).parquet(str(tmp_path / "out")).count() >= n

    def until(n):
        deadline = time.time() + 40
        while not have(n) and time.time() < deadline:
            time.sleep(0.5)

    try:
        until(10)
        fleet.events["d1"].append((int(datetime.now().timestamp() * 10), 90, 1))
        until(11)
        offsets = ast.literal_eval(str(query.lastProgress.sources[0].endOffset))
    finally:
        query.stop()
        fleet.server.shutdown()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.signal_id, r.event_code, r.event_param) for r in rows) == sorted([(f"d{k}", c, k) for k in range(5) for c in (81, 82)] + [("d1", 90, 1)])
    assert offsets["gone"] == 0 and offsets["d0"] >= now and offsets["d0"] < now + 864_000


def test_reading_a_span_again_gives_the_same(spark):
    fleet = Fleet()
    fleet.events = {"a": [(10, 1, 1), (20, 1, 2), (30, 1, 3)], "b": [(15, 2, 1)]}
    try:
        reader = connectors._PullReader({"devices": json.dumps({d: fleet.url(d) for d in "ab"})})
        start, end = {"a": 10, "b": 0}, {"a": 20, "b": 20}
        first = [[*reader.read(p)] for p in reader.partitions(start, end)]
        fleet.events["a"].append((40, 1, 4))
        again = connectors._PullReader({"devices": json.dumps({d: fleet.url(d) for d in "ab"})})
        assert [[*again.read(p)] for p in again.partitions(start, end)] == first
        assert [(r[0], r[3]) for part in first for r in part] == [("a", 2), ("b", 1)]
        assert again.latestOffset()["a"] >= 20  # never behind what was read
    finally:
        fleet.server.shutdown()


def test_backfill_partitions():
    got = connectors.hour_predicates("ts", datetime(2024, 1, 1), datetime(2024, 1, 1, 2, 30))
    assert len(got) == 3 and got[-1] == "ts >= '2024-01-01 02:00:00' AND ts < '2024-01-01 02:30:00'"
