"""Streams against batch results."""

import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from junctura.sources import lake
from junctura.streaming import jobs


def test_counts_equal_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("S", base + timedelta(minutes=7 * k), 82 if k % 2 else 1, 2, 1) for k in range(30)]
    events = spark.createDataFrame(rows + rows[:5], lake.EVENT_SCHEMA)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = jobs.run_once(jobs.quarter_hour_counts(jobs.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), "counts")
    want = events.dropDuplicates(lake.EVENT_KEY).groupBy(F.window(F.col("event_time").cast("timestamp"), "15 minutes").start.alias("bin_start")).count()
    assert {r.bin_start: r.event_count for r in found.collect()} == {r.bin_start: r["count"] for r in want.collect()}


def test_landed_logs_and_lake(spark, tmp_path):
    folder = tmp_path / "land"
    folder.mkdir()
    data = b"01/15/2024 08:00:00 " + b"line\n" * 7 + struct.pack(">BBH", 82, 5, 15)
    (folder / "SIG-1_x.dat").write_bytes(data)
    path = str(tmp_path / "lake")
    sink = jobs.append_to_lake(path)
    for _ in range(2):
        query = jobs.landed_logs(spark, str(folder), "asc3").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"cp{_}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert lake.existing(spark, path).count() == 1


def test_closed_plans(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("S", base + timedelta(minutes=m), c, p, 1) for m, c, p in ((0, 131, 7), (1, 132, 90), (2, 135, 35), (3, 131, 8))]
    rows.append(("Z", base + timedelta(minutes=30), 131, 1, 1))  # moves the watermark past the others
    spark.createDataFrame(rows, lake.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = jobs.run_once(jobs.closed_plans(jobs.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), "plans", "append").collect()
    assert [(r.plan_number, r.cycle_length, r.offset_seconds, r.splits) for r in found] == [(7, 90, None, {"2": 35})]
    assert found[0].effective_to == base + timedelta(minutes=3)


def test_message_events(spark):
    one = '{"signal_id": "S", "event_time": "2024-01-01T08:00:00.5", "event_code": 82, "event_param": %d%s}'
    texts = [one % (5, ""), "[" + one % (6, ', "device_id": 3') + ", " + one % (7, ', "more": 1') + "]", "not json", "", None, "[]", '{"signal_id": "S", "event_code": 1}', "[1, 2]"]
    messages = spark.createDataFrame([(None if t is None else t.encode(),) for t in texts], "value binary")
    found = jobs.message_events(messages)
    assert found.schema.simpleString() == spark.createDataFrame([], lake.EVENT_SCHEMA).schema.simpleString()
    at = datetime(2024, 1, 1, 8, 0, 0, 500_000)
    assert sorted(map(tuple, found.collect())) == [("S", at, 82, 5, 1), ("S", at, 82, 6, 3), ("S", at, 82, 7, 1)]


def test_messages_as_a_stream(spark, tmp_path):
    line = '{"signal_id": "S", "event_time": "2024-01-01T08:00:00", "event_code": 1, "event_param": 2}'
    spark.createDataFrame([(line,), (line,)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    path = str(tmp_path / "lake")
    stream = jobs.message_events(spark.readStream.text(str(tmp_path / "in")))
    stream.writeStream.foreachBatch(jobs.append_to_lake(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(path).count() == 1
