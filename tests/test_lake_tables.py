"""Reports over an event lake equal those over the tables it was written from; windows and signals reach the scan."""

import pytest

from junctura.plans import reports
from junctura.sources import lake
from junctura.sources.derived import START, Tables
from junctura.sources.lake_tables import LakeTables, plans_between
from oracle import rows
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WINDOW = (START + HOUR, START + 5 * HOUR, ("SIG-001", "SIG-002"))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake"))
    made = Tables(spark, "/root/testdata/sf0.001")
    events = made.log.select("signal_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("event_time"), F.col("code").alias("event_code"), F.col("param").alias("event_param"), F.lit(1).cast("smallint").alias("device_id"))
    lake.write_events(events, f"{folder}/events")
    for name, table in (("approaches", made.approaches), ("detectors", made.detectors.withColumn("detector_id", F.concat_ws("-", "signal_id", "channel"))), ("plans", made.plans), ("route", made.route), ("speeds", made.speeds)):
        table.write.parquet(f"{folder}/{name}.parquet")
    return made, LakeTables(spark, folder, lake=f"{folder}/events")


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_reports_over_the_lake(both, name):
    start, end, signals = WINDOW
    ours, theirs = (reports.run(t, name, None, signals, start, end).toPandas() for t in reversed(both))
    assert rows(ours) == rows(theirs)
    key = next(c for c in ("signal_id", "from_signal") if c in ours.columns)
    assert set(ours[key]) <= set(signals)


def test_window_and_signals_reach_the_scan(spark, both):
    start, end, signals = WINDOW
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = reports.run(both[1], "approach-volume", None, signals, start, end)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "event_time" in line and "PartitionFilters" in line)
    for part in ("PartitionFilters: [isnotnull(event_date", "In(signal_id", "GreaterThanOrEqual(event_time", "EqualTo(event_code,82)"):
        assert part in scan, part


def test_plans_overlap(spark):
    plans = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 20, None), (4, 41, None)], "plan_number int, begin long, finish long")
    assert [r.plan_number for r in plans_between(plans, 10, 40).orderBy("plan_number").collect()] == [1, 2, 3]
