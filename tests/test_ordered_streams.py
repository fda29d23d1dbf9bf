"""State machines over streams: any order and split within the lateness equals the batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from junctura.operators import preemption
from junctura.sources import lake
from junctura.streaming import jobs
from test_machines import plain_preempts

T0 = datetime(2024, 1, 1, 8)


def feed(spark, folder, batches):
    """One file a batch, to be read in this order."""
    for k, rows in enumerate(batches):
        path = str(folder / f"b{k:03d}")
        spark.createDataFrame(rows, lake.EVENT_SCHEMA).coalesce(1).write.parquet(path)
    return spark.readStream.schema(lake.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/b*")


def finished(frame, tmp_path, name):
    """All that the stream gives until nothing more comes."""
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    progress = query.lastProgress
    query.stop()
    return frame.sparkSession.table(name), progress


def jumbled(rows, seed, window=timedelta(minutes=8), size=40):
    """Batches of rows moved by less than the lateness, with repeats."""
    rng = random.Random(seed)
    moved = sorted(rows + rng.sample(rows, len(rows) // 5), key=lambda r: r[1] + window * rng.random())
    return [moved[a : a + size] for a in range(0, len(moved), size)]


def test_preempts_equal_batch_in_any_order(spark, tmp_path):
    rng, rows = random.Random(4), set()
    for channel in (1, 2):
        t = T0
        for _ in range(70):
            t += timedelta(seconds=rng.choice([1, 5, 60, 700, 1200, 1201, 3000]))
            rows.add(("S", t, rng.choice([102, 105, 105, 103, 104, 106, 107, 110, 111]), channel, 1))
    rows = sorted(rows)
    log = spark.createDataFrame(rows, lake.EVENT_SCHEMA)
    # A stray event long after the last closes what is open, in the batch as in the stream; another moves the watermark on.
    late = [("S", max(r[1] for r in rows) + timedelta(hours=2), 104, c, 1) for c in (1, 2)]
    end = [[*late], [("Z", late[0][1] + timedelta(hours=3), 104, 9, 1)], [("Z", late[0][1] + timedelta(hours=4), 104, 9, 1)]]
    (tmp_path / "in").mkdir()
    found, progress = finished(jobs.preempts(feed(spark, tmp_path / "in", jumbled(rows, 1) + end)), tmp_path, "preempted")
    events = log.unionByName(spark.createDataFrame(late, lake.EVENT_SCHEMA)).select("signal_id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"), F.col("event_code").alias("code"), F.col("event_param").alias("param"))
    want = preemption.detail_of(events)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    assert found.count() > 20 and found.where("terminated_by_timeout").count() > 5
    # State of channels at rest is gone.
    assert sum(s.numRowsTotal for s in progress.stateOperators) < 12


def test_idle_preempt_closes_without_a_further_event(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("S", T0, 102, 1, 1), ("S", T0 + timedelta(seconds=5), 105, 1, 1)], [("Z", T0 + timedelta(minutes=40), 104, 9, 1)], [("Z", T0 + timedelta(minutes=41), 104, 9, 1)]]
    found, _ = finished(jobs.preempts(feed(spark, tmp_path / "in", batches)), tmp_path, "idle")
    (row,) = found.collect()
    assert row.terminated_by_timeout and row.cycle_end == T0 + timedelta(seconds=5) and row.delay_seconds == 5.0


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_in_any_order(spark, tmp_path, seed):
    rng, rows, t = random.Random(seed), [], T0
    for _ in range(80):
        t += timedelta(seconds=rng.choice([5, 40, 100]))
        rows.append(("S", t, rng.choice([131, 132, 133, 134, 136, 149]), rng.randint(1, 99), 1))
    (tmp_path / "in").mkdir()
    end = [[("Z", t + timedelta(hours=k), 131, 1, 1)] for k in (1, 2)]
    found, _ = finished(jobs.closed_plans(feed(spark, tmp_path / "in", jumbled(rows, seed, size=15) + end)), tmp_path, f"plans{seed}")
    want, now = [], None
    for _, at, code, p, _ in rows:
        if code == 131:
            if now:
                want.append((now[0], at, *now[1:]))
            now = [at, p, None, None, {}]
        elif now and code == 132:
            now[2] = p
        elif now and code == 133:
            now[3] = p
        elif now:
            now[4][str(code - 133)] = p
    got = found.where("signal_id = 'S'").collect()
    assert sorted((r.effective_from, r.effective_to, r.plan_number, r.cycle_length, r.offset_seconds, r.splits) for r in got) == sorted(map(tuple, want))


POLLS = "device_id string, polled_at timestamp, events long, last_event timestamp"


def test_three_silent_polls_mend_a_poisoned_cursor(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    ahead = at(1) + timedelta(days=1)  # the device's clock was a day ahead once
    polls = [("d", at(0), 5, at(0)), ("d", at(1), 2, ahead), *(("d", at(m), 0, None) for m in (2, 3, 4)), ("d", at(5), 4, at(5)), ("q", at(0), 1, at(0)), *(("q", at(m), 0, None) for m in (1, 2, 3, 4)), ("n", at(0), 0, None)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((polls[:4], polls[3:8], polls[8:])):  # the fourth is told twice
        spark.createDataFrame(part, POLLS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    found, _ = finished(jobs.device_watch(stream), tmp_path, "watched")
    rows = sorted((r.device_id, r.polled_at, r.kind, r.cursor, r.silent_polls, r.drift_seconds) for r in found.collect() if r.kind != "read")
    assert rows == [("d", at(4), "poisoned", at(4), 3, 86_220.0), ("q", at(3), "silent", at(0), 3, None), ("q", at(4), "silent", at(0), 4, None)]
    assert found.where("device_id = 'd' and kind = 'read'").agg(F.max_by("cursor", "polled_at")).first()[0] == at(5)


def test_the_stream_machine_equals_the_plain_walk():
    from junctura.streaming.ordered import Preempts

    rng, machine = random.Random(9), Preempts()
    for _ in range(200):
        t, events = 0, []
        for _ in range(rng.randint(1, 30)):
            t += rng.choice([1, 60, 1200, 1201]) * 1_000_000
            events.append((t, rng.choice([102, 105, 104, 106, 107, 111])))
        now, out = None, []
        for e in events:
            if machine._over(now, e[0]):
                out, now = out + machine.expired(("S", 1), now), None
            now, rows = machine.step(("S", 1), now, (*e, 1))
            out += rows
            if now:
                now["last"] = e[0]
        want = [w for w in plain_preempts(events)]
        assert [r[2:5] + (r[5],) for r in out] == [w[:4] for w in want][: len(out)] and len(want) - len(out) == (now is not None)


