"""Jobs over lakes: landed files, the validation loop, hot and cold tiers."""

import os
import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from junctura.operators.validation import VERDICTS, reached, validate_new
from junctura.sources import commits, landing, lake, tiers


def events(spark, *rows):
    """(signal, day, second, code, parameter)"""
    return spark.createDataFrame([(s, datetime(2024, 1, d, 8, 0, t), c, p, 1) for s, d, t, c, p in rows], lake.EVENT_SCHEMA)


def keys(frame):
    return sorted((r.signal_id, r.event_time.day, r.event_time.second, r.event_code, r.event_param) for r in frame.collect())


def asc3(*records):
    return b"01/15/2024 08:00:00 " + b"line\n" * 7 + b"".join(struct.pack(">BBH", c, p, t) for c, p, t in records)


def test_landed_files_change(spark, tmp_path, monkeypatch):
    folder, state, path = tmp_path / "land", str(tmp_path / "state"), str(tmp_path / "lake")
    folder.mkdir()
    run = lambda: landing.ingest(spark, str(folder), state, path)
    (folder / "A_1.dat").write_bytes(asc3((82, 5, 10), (81, 5, 20)))
    (folder / "B_1.dat").write_bytes(asc3((82, 6, 10)))
    (folder / "C_1.dat").write_bytes(b"\xff\x00 no log at all")
    assert run() == {"new": 2, "failed": 1} and run() == {}
    assert len(keys(lake.existing(spark, path))) == 3
    (row,) = landing.failed(spark, state).collect()
    assert row.path.endswith("C_1.dat") and "no decoder" in row.error

    (folder / "A_1.dat").write_bytes(asc3((82, 5, 10), (81, 5, 20), (82, 5, 30)))
    os.rename(folder / "B_1.dat", folder / "B_2.dat")
    assert run() == {"grown": 1, "renamed": 1}
    os.utime(folder / "B_2.dat", (1, 1))
    (folder / "C_1.dat").write_bytes(asc3((1, 2, 5)))
    assert run() == {"touched": 1, "rewritten": 1} and run() == {}
    assert len(keys(lake.existing(spark, path))) == 5 and landing.failed(spark, state).count() == 0

    # A run dies after its events are in: the next one completes it and adds nothing twice.
    (folder / "D_1.dat").write_bytes(asc3((82, 7, 10)))
    real = landing.commit

    def die(*_, **__):
        raise SystemExit

    monkeypatch.setattr(landing, "commit", die)
    with pytest.raises(SystemExit):
        run()
    monkeypatch.setattr(landing, "commit", real)
    before = commits.snapshot(commits.Store(spark, path)).version
    assert run() == {"new": 1} and commits.snapshot(commits.Store(spark, path)).version == before
    assert len(keys(lake.existing(spark, path))) == 6


def test_changed_files_are_told_without_their_contents(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "A_1.dat").write_bytes(b"x")
    plan = landing.changed(spark, str(tmp_path / "land"), str(tmp_path / "state"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_each_row_is_validated_once(spark, tmp_path):
    path, verdicts = str(tmp_path / "lake"), str(tmp_path / "verdicts")
    assert validate_new(spark, path, verdicts) == 0
    lake.write_events(events(spark, ("S", 1, 0, 82, 5), ("S", 1, 1, 82, 500), ("S", 2, 0, 999, 1)), path)
    assert validate_new(spark, path, verdicts) == 1
    lake.write_events(events(spark, ("S", 2, 5, 1, 2), ("S", 1, 0, 82, 5)), path)
    seen = []

    def judge(rows):
        seen.append(keys(rows.withColumnsRenamed({"code": "event_code", "param": "event_param"})))
        from junctura.operators.quality import validate

        return validate(rows)

    assert validate_new(spark, path, verdicts, judge=judge) == 2 and seen == [[("S", 2, 5, 1, 2)]]
    assert validate_new(spark, path, verdicts, judge=judge) == 2 and len(seen) == 1
    found = {(r.event_time.day, r.event_time.second): (r.status, r.rules_failed) for r in commits.committed(spark, verdicts, VERDICTS).collect()}
    assert found == {(1, 0): ("clean", []), (1, 1): ("invalid", ["param_out_of_range"]), (2, 0): ("invalid", ["unknown_event_code"]), (2, 5): ("clean", [])}

    # A second validator goes over all rows; the worst verdict and the rules of both stay.
    suspect = lambda rows: rows.withColumn("rules_failed", F.when(F.col("param") >= 5, F.array(F.lit("large"))).otherwise(F.array().cast("array<string>"))).withColumn("status", F.when(F.col("param") >= 5, "suspect").otherwise("clean"))
    assert validate_new(spark, path, verdicts, "sizes", suspect) == 2 and reached(spark, verdicts, "sizes") == 2
    found = {(r.event_time.day, r.event_time.second): (r.status, r.rules_failed) for r in commits.committed(spark, verdicts, VERDICTS).collect()}
    assert found == {(1, 0): ("suspect", ["large"]), (1, 1): ("invalid", ["large", "param_out_of_range"]), (2, 0): ("invalid", ["unknown_event_code"]), (2, 5): ("clean", [])}


def test_hot_and_cold_are_one_view(spark, tmp_path, monkeypatch):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    all_rows = [(s, d, t, 82, 5) for s in "AB" for d in (1, 2, 3, 4) for t in (0, 1)]
    lake.write_events(events(spark, *all_rows), hot)
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 4, 23)
    view = lambda *more, **some: tiers.events_view(spark, hot, cold, *(more or (first, last)), **some)
    assert keys(view()) == sorted(all_rows)
    # Broken off after the rows are in both tables, and after the boundary has moved.
    for step in ("drop_before", None):
        if step:
            monkeypatch.setattr(tiers, step, lambda *_: (_ for _ in ()).throw(SystemExit()))
            with pytest.raises(SystemExit):
                tiers.move(spark, hot, cold, date(2024, 1, 3))
            monkeypatch.undo()
        else:
            tiers.move(spark, hot, cold, date(2024, 1, 3))
        assert keys(view()) == sorted(all_rows)
    assert tiers.boundary(spark, cold) == date(2024, 1, 3)
    assert all("/hot/event_date=2024-01-0" in f and f.split("event_date=")[1][:10] >= "2024-01-03" for f in lake.existing(spark, hot).inputFiles())
    # Both sides open only what dates and signals ask for.
    part = view(datetime(2024, 1, 2), datetime(2024, 1, 3, 9), signals=("A",))
    assert keys(part) == [("A", d, t, 82, 5) for d in (2, 3) for t in (0, 1)]
    assert sorted({tuple(x for x in f.split("/") if "=" in x) for f in part.inputFiles()}) == [("event_date=2024-01-03",), ("signal_id=A", "event_date=2024-01-02")]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(") == 2
    # A row that comes late for a cold date is seen at once, and once after the next move too.
    lake.write_events(events(spark, ("A", 1, 9, 82, 5), ("A", 1, 0, 82, 5)), hot)
    assert keys(view()) == sorted([*all_rows, ("A", 1, 9, 82, 5)])
    tiers.move(spark, hot, cold, date(2024, 1, 4))
    assert keys(view()) == sorted([*all_rows, ("A", 1, 9, 82, 5)]) and tiers.boundary(spark, cold) == date(2024, 1, 4)
