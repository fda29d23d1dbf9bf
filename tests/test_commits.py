"""Commits: two writers, killed writes, repeated batches, upserts."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from junctura.operators import aggregates
from junctura.sources import commits, lake

SCHEMA = lake.EVENT_SCHEMA


def events(spark, *rows):
    """(signal, day, second, parameter)"""
    return spark.createDataFrame([(s, datetime(2024, 1, d, 8, 0, t), 82, p, 1) for s, d, t, p in rows], SCHEMA)


def keys(frame):
    return sorted((r.signal_id, r.event_time.day, r.event_time.second, r.event_param) for r in frame.collect())


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "lake")
    assert lake.write_events(events(spark, ("S", 1, 0, 5), ("S", 2, 0, 5)), path, "b1")
    assert not lake.write_events(events(spark, ("S", 1, 0, 5), ("S", 3, 9, 9)), path, "b1")
    assert lake.write_events(events(spark, ("S", 1, 0, 5), ("S", 1, 1, 5), ("S", 1, 1, 5)), path, "b2")
    assert keys(lake.existing(spark, path)) == [("S", 1, 0, 5), ("S", 1, 1, 5), ("S", 2, 0, 5)]
    assert lake.write_events(events(spark).limit(0), path, "b3") and not lake.write_events(events(spark, ("S", 9, 0, 1)), path, "b3")
    found = lake.scan(spark, path, datetime(2024, 1, 2), datetime(2024, 1, 2, 23))
    assert keys(found) == [("S", 2, 0, 5)] and all("event_date=2024-01-02" in f for f in found.inputFiles())


def test_a_killed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    lake.write_events(events(spark, ("S", 1, 0, 5)), path, "b1")

    def die(*_):
        raise SystemExit

    monkeypatch.setattr(commits, "publish", die)
    with pytest.raises(SystemExit):
        lake.write_events(events(spark, ("S", 1, 1, 5), ("S", 2, 1, 5)), path, "b2")
    monkeypatch.undo()
    assert keys(lake.existing(spark, path)) == [("S", 1, 0, 5)]
    assert lake.write_events(events(spark, ("S", 1, 1, 5), ("S", 2, 1, 5)), path, "b2")
    assert keys(lake.existing(spark, path)) == [("S", 1, 0, 5), ("S", 1, 1, 5), ("S", 2, 1, 5)]
    assert commits.vacuum(spark, path) == []  # too fresh to be surely lost
    assert len(commits.vacuum(spark, path, hours=-1)) == 2
    assert keys(lake.existing(spark, path)) == [("S", 1, 0, 5), ("S", 1, 1, 5), ("S", 2, 1, 5)]


def test_the_second_of_two_writers_goes_on_from_the_first(spark, tmp_path, monkeypatch):
    """While one writer is about to publish, another commits rows with some of the same keys."""
    path, publish, once = str(tmp_path / "lake"), commits.publish, []
    lake.write_events(events(spark, ("S", 1, 0, 5)), path)

    def late(store, seen, batch, added, removed):
        if not once:
            once.append(1)
            assert lake.write_events(events(spark, ("S", 2, 0, 7), ("S", 2, 1, 7)), path, "other")
        return publish(store, seen, batch, added, removed)

    monkeypatch.setattr(commits, "publish", late)
    assert lake.write_events(events(spark, ("S", 2, 1, 7), ("S", 2, 2, 7), ("S", 3, 0, 1)), path, "mine")
    assert keys(lake.existing(spark, path)) == [("S", 1, 0, 5), ("S", 2, 0, 7), ("S", 2, 1, 7), ("S", 2, 2, 7), ("S", 3, 0, 1)]


def test_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "lake"), []

    def write(k):
        try:
            for n in range(3):
                lake.write_events(events(spark, ("S", 1 + n, k, 1), ("S", 1, 30, 1)), path, f"{k}-{n}")
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert keys(lake.existing(spark, path)) == sorted([("S", 1 + n, k, 1) for k in range(3) for n in range(3)] + [("S", 1, 30, 1)])


def test_upserts_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "table")
    row = lambda day, hour, n: ("S", 2, datetime(2024, 1, day, hour), n)
    frame = lambda *rows: spark.createDataFrame(rows, "signal_id string, phase int, bin_start timestamp_ntz, n int")
    key = ["signal_id", "phase", "bin_start"]
    for k in range(25):  # over the whole list at version 20
        assert aggregates.upsert(frame(row(1, 8, k), row(2 + k % 3, 9, k)), path, key, batch=str(k))
    assert not aggregates.upsert(frame(row(1, 8, 99)), path, key, batch="7")
    found = commits.committed(spark, path, "signal_id string, phase int, bin_start timestamp_ntz, n int, bin_date date")
    assert sorted((r.bin_start.day, r.bin_start.hour, r.n) for r in found.collect()) == [(1, 8, 24), (2, 9, 24), (3, 9, 22), (4, 9, 23)]
    assert commits.snapshot(commits.Store(spark, path)).version == 25
    assert found.where(F.col("bin_date") == "2024-01-01").count() == 1
    assert commits.remove(spark, path, lambda part: part < "bin_date=2024-01-03") == ["bin_date=2024-01-01", "bin_date=2024-01-02"]
    assert commits.committed(spark, path, "n int, bin_date date").count() == 2
