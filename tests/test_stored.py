"""Reports over windows that stored tables cover in part."""

import pytest
from pyspark.sql import functions as F

from junctura.operators import aggregates, scans, stored
from junctura.sources import lake
from junctura.sources.derived import START, Tables
from junctura.sources.lake_tables import LakeTables
from oracle import rows

FOLDER = "/root/testdata/sf0.001"
HOUR = 3_600_000_000
DAY = 24 * HOUR


@pytest.fixture(scope="module")
def lakes(spark, tmp_path_factory):
    """A lake of two days: the derived log and the same a day later; and a store that covers parts of it."""
    folder, store = str(tmp_path_factory.mktemp("lake")), str(tmp_path_factory.mktemp("store"))
    tables = Tables(spark, FOLDER)
    log = tables.log.unionByName(tables.log.withColumn("t", F.col("t") + DAY))
    events = log.select("signal_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("event_time"), F.col("code").alias("event_code"), F.col("param").alias("event_param"), F.lit(1).cast("smallint").alias("device_id"))
    lake.write_events(events, f"{folder}/events")
    tables.approaches.select("approach_id", "signal_id", "phase", "direction", "mph", "ped_phase").write.parquet(f"{folder}/approaches.parquet")
    tables.detectors.withColumn("detector_id", F.concat("signal_id", F.lit("-"), F.col("channel").cast("string"))).write.parquet(f"{folder}/detectors.parquet")
    whole = LakeTables(spark, folder, START, START + DAY + 12 * HOUR, lake=f"{folder}/events")
    for name in stored.TABLES:
        stored.build(whole, store, name, START + HOUR, START + 2 * HOUR)
        stored.build(whole, store, name, START + 2 * HOUR, START + 3 * HOUR)
        stored.build(whole, store, name, START + 5 * HOUR, START + DAY)
    return whole, store


@pytest.mark.parametrize("name", sorted(stored.TABLES))
def test_a_window_covered_in_part_equals_the_log(lakes, name):
    whole, store = lakes
    assert stored.covered(whole.spark, store, name, whole.start, whole.end) == [(START + HOUR, START + 3 * HOUR), (START + 5 * HOUR, START + DAY)]
    time = stored.TABLES[name][1]
    want = scans._within(stored.TABLES[name][0](whole.over(whole.start - DAY, whole.end + DAY)), time, whole.start, whole.end + 1)
    found = stored.rows(whole, store, name)
    assert rows(found.toPandas()) == rows(want.select(*found.columns).toPandas())
    assert found.count() > 0 or name == "cycle_detector_arrival"  # the smallest data have none


def test_covered_dates_open_no_log(lakes):
    whole, store = lakes
    inside = whole.over(START + 5 * HOUR, START + DAY - 1)
    files = stored.purdue_diagram(inside, store).inputFiles()
    assert files and all("/cycle_boundary/bin_date=2024-01-01/" in f for f in files)
    both = stored.purdue_diagram(whole.over(START + 6 * HOUR, START + DAY + 6 * HOUR), store).inputFiles()
    # Of the log only the second day, and the first as far as a cycle reaches over midnight.
    assert any("/events/event_date=2024-01-02/" in f for f in both) and any("/cycle_boundary/" in f for f in both)


def test_reports_from_both(lakes):
    whole, store = lakes
    window = whole.over(START + 2 * HOUR + 60_000_000, START + 7 * HOUR)
    cycles = aggregates.cycle_boundary(window.over(window.start, window.end + aggregates.REACH))
    assert rows(stored.purdue_diagram(window, store).toPandas()) == rows(scans.purdue_from_cycles(cycles, window.start, window.end + 1).toPandas())
    assert rows(stored.phase_termination(window, store).toPandas()) == rows(scans.terminations_from_cycles(cycles, window.start, window.end + 1).toPandas())


def test_a_span_is_built_anew(lakes, spark, tmp_path):
    """A late yellow changes a cycle, a late green splits one; both show once the span is built again."""
    whole, _ = lakes
    store = str(tmp_path / "store")
    stored.build(whole, store, "cycle_boundary", START, START + HOUR)
    before = stored.rows(whole.over(START, START + HOUR - 1), store, "cycle_boundary").count()
    some = whole.over(START, START + HOUR, signals=("SIG-001",))
    stored.build(some, store, "cycle_boundary", START, START + HOUR)
    after = stored.rows(whole.over(START, START + HOUR - 1), store, "cycle_boundary")
    assert {r.signal_id for r in after.select("signal_id").distinct().collect()} == {"SIG-001"} and after.count() < before
    with pytest.raises(ValueError):
        stored.build(whole, store, "cycle_boundary", START + 1, START + HOUR)


def test_reports_by_name_take_the_store_first(lakes):
    from dataclasses import replace

    from junctura.plans import reports

    whole, store = lakes
    kept = replace(whole, store=store)
    window = {"signals": ("SIG-001",), "start": START + 5 * HOUR, "end": START + 9 * HOUR}
    found = reports.run(kept, "purdue-diagram", **window)
    assert all("/cycle_boundary/" in f for f in found.inputFiles()) and found.columns == reports.run(whole, "purdue-diagram", **window).columns
    assert rows(found.toPandas()) == rows(stored.purdue_diagram(whole.over(window["start"], window["end"], ("SIG-001",)), store).toPandas())
    assert reports.run(kept, "arrivals-on-green", **window).columns == reports.run(whole, "arrivals-on-green", **window).columns
