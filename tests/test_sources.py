"""Decoders, the event lake and configuration history."""

import gzip
import random
import struct
import zlib
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from junctura.operators import config, quality
from junctura.operators.aggregates import refresh, signal_plans
from junctura.sources import decoders, lake

BASE = 1_705_305_600  # 2024-01-15 08:00:00
ASC = b"01/15/2024 08:00:00 " + b"line\n" * 7 + struct.pack(">BBH", 82, 5, 15) + struct.pack(">BBH", 1, 2, 600)
RECORD = struct.pack("<IBBH", 1500, 82, 5, 0)


def flat(events):
    return [tuple(map(int, r)) for r in zip(*events, strict=True)]


@pytest.mark.parametrize("data", [ASC, gzip.compress(ASC), zlib.compress(ASC)])
def test_asc3(data):
    assert flat(decoders.decoded(data)) == [(BASE * 10**6 + 1_500_000, 82, 5), (BASE * 10**6 + 60_000_000, 1, 2)]


@pytest.mark.parametrize(("magic", "header", "seconds"), [(b"PEEK", 16, 1.5), (b"MCCN", 32, 0.0015), (b"ATC\0", 16, 150.0), (b"MXTM", 20, 1.5)])
def test_offset_logs(magic, header, seconds):
    data = (magic + struct.pack("<I", BASE)).ljust(header, b"\0") + RECORD + b"cut"
    assert flat(decoders.decoded(data)) == [(BASE * 10**6 + round(seconds * 1e6), 82, 5)]


def test_text_logs():
    xml = b'<?xml version="1.0"?><Log><Event TimeStamp="2024-01-15 08:00:01" EC="82" Param="5"/><Event TimeStamp="bad" EC="1" Param="2"/></Log>'
    assert flat(decoders.decoded(xml)) == [((BASE + 1) * 10**6, 82, 5)]
    csv = b"timestamp;code\n2024-01-15T08:00:02.5;82\nnonsense\n"
    assert flat(decoders.decoded(csv)) == [(BASE * 10**6 + 2_500_000, 82, 0)]
    sepac = b"SEPAC log\nDate: 01/15/2024\n\nTime\tCode\tParam\n08:00:03\t1\t2\n"
    assert flat(decoders.decoded(sepac)) == [((BASE + 3) * 10**6, 1, 2)]


def test_text_logs_of_several_days_and_broken_lines():
    sepac = b"Siemens\nfree; text\nDate: 01/15/2024\ncode;extra;time\n1;x;08:00:03\nDate: nonsense\n8;x;08:00:04\nDate: 2024-01-16\n9;x;08:00:00\n9;x\nzz;x;08:00:01\n"
    assert flat(decoders.siemens(sepac)) == [((BASE + 3) * 10**6, 1, 0), ((BASE + 4) * 10**6, 8, 0), ((BASE + 86400) * 10**6, 9, 0)]
    assert flat(decoders.delimited(b"no heading\n2024-01-15 08:00:00,1,2\n")) == [] and flat(decoders.delimited(b"")) == []
    assert flat(decoders.delimited(b"EP|EC|TS\n5|82|2024-01-15 08:00:00\n|82|2024-01-15 08:00:00\n")) == [(BASE * 10**6, 82, 5)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def test_openphase():
    compact = field(1, b"X") + field(2, BASE * 10**9) + field(4, field(1, 250) + field(2, 82) + field(3, 5))
    assert flat(decoders.decoded(compact, "openphase")) == [(BASE * 10**6 + 250_000, 82, 5)]
    one = field(1, b"X") + field(2, field(1, BASE) + field(2, 500_000_000)) + field(4, field(1, 1) + field(2, 2))
    assert flat(decoders.decoded(one, "openphase")) == [(BASE * 10**6 + 500_000, 1, 2)]
    assert flat(decoders.decoded(field(1, b"X") + field(2, one), "openphase")) == [(BASE * 10**6 + 500_000, 1, 2)]


def test_read_logs(spark, tmp_path):
    (tmp_path / "SIG-1_a.dat").write_bytes(ASC)
    (tmp_path / "SIG-2_b.bin").write_bytes(b"not a log")
    rows = {r.signal_id: r for r in decoders.read_logs(spark, str(tmp_path)).where("event_code = 82 or error is not null").collect()}
    assert rows["SIG-1"].event_time == datetime(2024, 1, 15, 8, 0, 1, 500_000) and rows["SIG-2"].error


def test_speed_packets(spark):
    packet = lambda mph, kph, tag: bytes(8) + bytes([mph, kph]) + tag + b"\x7e\x0d\x0d"
    rows = spark.createDataFrame([(packet(55, 89, b"RADAR1"), datetime(2024, 1, 1)), (packet(55, 80, b"RADAR1"), None), (packet(55, 89, b"RAD-R1"), None), (b"short", None)], "packet binary, received_at timestamp_ntz")
    assert [(r.vendor_tag, r.mph, r.kph) for r in decoders.speed_packets(rows).collect()] == [("RADAR1", 55, 89)]


def events(spark, rows):
    return spark.createDataFrame([(s, datetime(2024, 1, d, h), c, p, 1) for s, d, h, c, p in rows], lake.EVENT_SCHEMA)


def test_append_is_idempotent_and_scans_prune(spark, tmp_path):
    path, rows = str(tmp_path / "log"), events(spark, [("S", 1, 1, 82, 5), ("S", 2, 1, 82, 5), ("U", 2, 2, 1, 2)])
    lake.write_events(rows, path)
    lake.write_events(rows.unionByName(events(spark, [("S", 3, 1, 1, 2)])), path)
    assert lake.existing(spark, path).count() == 4
    found = lake.scan(spark, path, datetime(2024, 1, 2), datetime(2024, 1, 2, 23), codes=(82,))
    assert [(r.signal_id, r.event_code) for r in found.collect()] == [("S", 82)]
    assert "PartitionFilters: [isnotnull(event_date" in found._jdf.queryExecution().toString()
    assert lake.drop_before(spark, path, "2024-01-02") == ["2024-01-01"]
    assert lake.existing(spark, path).count() == 3


def test_cold_export(spark, tmp_path):
    lake.export_cold(events(spark, [("S", 1, 1, 82, 5), ("S", 2, 1, 82, 5)]), str(tmp_path / "cold"))
    assert sorted(p.name for p in (tmp_path / "cold" / "signal_id=S").iterdir()) == ["event_date=2024-01-01", "event_date=2024-01-02"]


def test_corrected(spark):
    rows = events(spark, [("S", 1, 1, 82, 5), ("S", 1, 3, 82, 5), ("U", 1, 1, 82, 5)])
    moved = lake.corrected(rows, "S", datetime(2024, 1, 1), datetime(2024, 1, 1, 2), 60.0)
    assert sorted((r.signal_id, r.event_time.hour, r.event_time.minute) for r in moved.collect()) == [("S", 1, 1), ("S", 3, 0), ("U", 1, 0)]
    assert lake.anchor_offset(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)) == 60.0


def test_cursor_is_capped(spark):
    rows = events(spark, [("S", 1, 1, 82, 5), ("S", 9, 1, 82, 5)])
    assert lake.cursor(rows, datetime(2024, 1, 2)).first().last_event_time == datetime(2024, 1, 2, 0, 5)
    assert [r.is_future for r in lake.future_dated(rows, datetime(2024, 1, 2)).orderBy("event_time").collect()] == [False, True]


def test_export(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b string")
    lake.export(empty.coalesce(1), str(tmp_path / "csv"), "csv")
    assert [p.read_text() for p in (tmp_path / "csv").glob("*.csv")] == ["a,b\n"]
    with pytest.raises(ValueError, match="nested"):
        lake.export(empty.withColumn("c", F.array("a")), str(tmp_path / "no"), "csv")
    with pytest.raises(ValueError, match="before"):
        lake.events_query(None, start=2, end=1)


def test_refresh_rebuilds_whole_hours(spark, tmp_path):
    path = str(tmp_path / "agg")
    bins = lambda n: spark.createDataFrame([("S", datetime(2024, 1, 1, h, 15 * q), n) for h in range(4) for q in range(4)], "signal_id string, bin_start timestamp_ntz, n int")
    hour = 3_600_000_000
    start = 1_704_067_200_000_000
    refresh(bins(1), path, start + 4 * hour, lookback_hours=24)
    refresh(bins(2), path, start + 4 * hour + 60_000_000, lookback_hours=2)
    found = spark.read.parquet(path).groupBy("bin_hour").agg(F.sum("n").alias("n"), F.count("*").alias("k")).orderBy("bin_hour").collect()
    assert [(r.bin_hour, r.n, r.k) for r in found] == [(0, 4, 4), (1, 4, 4), (2, 8, 4), (3, 8, 4)]


def test_signal_plans(spark):
    text = [(0, 132, 99), (1, 131, 7), (2, 132, 90), (3, 133, 10), (4, 135, 35), (5, 135, 40), (6, 131, 8)]
    rows = signal_plans(spark.createDataFrame([("S", t, c, p) for t, c, p in text], "signal_id string, t long, code int, param int")).orderBy("plan_number").collect()
    assert [(r.plan_number, r.cycle_length, r.offset_seconds, r.splits) for r in rows] == [(7, 90, 10, {"2": 40}), (8, None, None, None)]
    assert rows[0].effective_to == rows[1].effective_from and rows[1].effective_to is None


def test_as_of_delete_and_fallback(spark):
    audit = spark.createDataFrame([("A", datetime(2024, 1, 1), 1, "INSERT", '{"mph": 30}'), ("A", datetime(2024, 1, 3), 2, "DELETE", None), ("B", datetime(2024, 1, 5), 3, "INSERT", '{"mph": 50}')], "approach_id string, changed_at timestamp_ntz, audit_id long, operation string, new_values string")
    live = spark.createDataFrame([("B", 40), ("C", 25)], "approach_id string, mph int")
    at = lambda d: sorted((r.approach_id, r.mph) for r in config.as_of(audit, live, "approach_id", "mph int", F.lit(datetime(2024, 1, d))).collect())
    assert at(2) == [("A", 30), ("B", 40), ("C", 25)]
    assert at(4) == [("B", 40), ("C", 25)]
    assert at(6) == [("B", 50), ("C", 25)]


def test_validator(spark):
    rows = spark.createDataFrame([(1, 2), (1, -1), (999, 1), (1, 41), (82, None)], "code int, param int")
    found = {(r.code, r.param): (r.status, r.rules_failed) for r in quality.validate(rows).collect()}
    assert found[1, 2] == ("clean", []) and found[82, None] == ("clean", [])
    assert found[1, -1][1] == ["negative_param", "param_out_of_range"] and found[999, 1][1] == ["unknown_event_code"] and found[1, 41][1] == ["param_out_of_range"]
    merged = spark.range(1).select(quality.worst(F.lit("clean"), F.lit("suspect"), F.lit(None).cast("string"))).first()[0]
    assert merged == "suspect"


def test_dates(spark):
    assert date(2024, 1, 1).weekday() == 0


def test_clock_correction_keeps_other_signals(spark):
    from types import SimpleNamespace

    from junctura.sources.derived import START

    t = START + 3_600_000_000
    rows = [(s, at, 82, 1) for s in ("SIG-001", "SIG-002") for at in (t, t + 90_000_000, t + 840_000_000)]
    log = spark.createDataFrame(rows, "signal_id string, t long, code int, param int")
    got = lake.clock_correction(SimpleNamespace(between=lambda: log)).collect()
    first = datetime(1970, 1, 1) + timedelta(microseconds=t // 900_000_000 * 900_000_000)
    assert {(r.signal_id, r.bin_start, r.n) for r in got} == {("SIG-001", first, 3), ("SIG-002", first, 2), ("SIG-002", first + timedelta(minutes=15), 1)}


def test_layout_of_text_logs():
    text = b"site 12\nmade today\nwhen;what;which;more\n15.01.2024 08-00-01;82;5;x\n15.01.2024 08-00-02;bad;5\n15.01.2024 08-00-03;81\n\n15.01.2024 08-00-04;1;2\n"
    layout = decoders.Layout(time=0, code=1, param=2, time_format="%d.%m.%Y %H-%M-%S", skip_rows=2)
    assert flat(decoders.delimited(text, layout)) == [((BASE + 1) * 10**6, 82, 5), ((BASE + 4) * 10**6, 1, 2)]
    named = b"date_time,note,ec\n2024-01-15 08:00:00,7,82\n"
    assert flat(decoders.decoded(named)) == [(BASE * 10**6, 82, 0)]
    assert flat(decoders.delimited(named, decoders.Layout(param=1))) == [(BASE * 10**6, 82, 7)]
    assert flat(decoders.delimited(named, decoders.Layout(code=1))) == [(BASE * 10**6, 7, 0)]
    assert flat(decoders.delimited(named, decoders.Layout(delimiter=";"))) == [] == flat(decoders.delimited(b"", decoders.Layout(skip_rows=3)))
    assert flat(decoders.delimited(b"ts::ec\n2024-01-15 08:00:00::4\n", decoders.Layout(delimiter="::"))) == [(BASE * 10**6, 4, 0)]


def test_formats_by_extension(spark, tmp_path):
    assert decoders.formats_of(".DAT") == ["asc3", "peek"] and decoders.formats_of(".pb") == ["openphase"] and decoders.formats_of(".none") == []
    text = "ts,ec,ep\n2024-01-15 08:00:00,82,5\n"
    for name in ("A_1.csv", "B_1.dat", "C_1", "D_1.tsv", "E_1.TXT"):
        (tmp_path / name).write_text(text)
    rows = {r.signal_id: r for r in decoders.read_logs(spark, str(tmp_path), "extension").collect()}
    assert {s for s, r in rows.items() if r.event_code == 82 and r.error is None} == {"A", "D", "E"}
    assert {s for s, r in rows.items() if "no decoder" in (r.error or "")} == {"B", "C"}


def test_lines_equal_whole_files(spark, tmp_path):
    rng = random.Random(5)
    stamps = ["2024-01-15 08:00:0{}", "1/5/2024 8:00:0{}", "2024-01-15T08:00:0{}", "2024-01-15 08:00:0{}.25", "01/15/2024 08:00:0{}.123456", "15.01.2024 08:00:0{}", ""]
    for name in "ABC":
        rows = [f"{rng.choice(stamps).format(rng.randrange(10))}|{rng.choice([82, ' 81 ', 'x', ''])}|{rng.choice([5, 6, 'y'])}|z" for _ in range(300)]
        (tmp_path / f"{name}_1.log").write_text("\n".join(["a free line", "when|what|which", *rows]) + "\n")
    layout = decoders.Layout("|", 0, 1, 2)
    key = lambda r: (r.path, r.signal_id, r.event_time, r.event_code, r.event_param)
    lines = sorted(map(key, decoders.read_lines(spark, str(tmp_path), layout).collect()))
    whole = sorted(map(key, decoders.read_logs(spark, str(tmp_path), layout=layout).collect()))
    assert lines == whole and len(lines) > 200
    with pytest.raises(ValueError, match="places"):
        decoders.read_lines(spark, str(tmp_path), decoders.Layout("|"))
