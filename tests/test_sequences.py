"""Operators on short event sequences with results known by hand (seconds from 08:00 on 2025-06-15)."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from junctura.functions import temporal
from junctura.operators import aggregates, analytics, arrivals, cycles, leftturn, preemption, volumes
from junctura.sources.derived import Tables

ZERO = datetime(2025, 6, 15, 8)
T0 = 1_749_974_400_000_000


class Sequence(Tables):
    """One signal, one northbound approach on phase 2 with channels 5 and 6, pedestrian phase 4 on channel 10."""

    def __init__(self, spark, text, channels=((5, 2), (6, 2)), distance=None, min_speed=None, ped=None):
        super().__init__(spark, "")
        events = [(float(at), *map(int, what.split("/"))) for what, at in (p.strip().split("@") for p in text.split(","))]
        self.__dict__["log"] = spark.createDataFrame([("S", T0 + round(at * 1e6), c, p) for at, c, p in events], "signal_id string, t long, code int, param int")
        phases = sorted({p for _, p in channels})
        self.__dict__["approaches"] = spark.createDataFrame([("S", f"APP-{p}", p, "NB", 45, ped or p) for p in phases], "signal_id string, approach_id string, phase int, direction string, mph int, ped_phase int")
        self.__dict__["detectors"] = spark.createDataFrame([("S", c, p, f"APP-{p}", "NB", "T", distance, min_speed, ped or p) for c, p in channels], "signal_id string, channel int, phase int, approach_id string, direction string, movement string, distance int, min_speed int, ped_phase int")

    def between(self, *codes, start=None, end=None):
        return self.log.where(F.col("code").isin(*codes)) if codes else self.log


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(("text", "want"), [
    ("1/2@0, 82/5@12", [(12.0, 1)]),
    ("1/2@0, 82/5@10, 82/5@20", [(15.0, 2)]),
    ("82/5@-5, 1/2@0", []),
])
def test_approach_delay(spark, text, want):
    assert got(arrivals.approach_delay(Sequence(spark, text)), "avg_delay_seconds", "volume") == want


def test_approach_speed(spark):
    rows = volumes.approach_speed(Sequence(spark, "82/5@0, 81/5@6", distance=400, min_speed=5)).collect()
    assert len(rows) == 1 and 45 <= rows[0].avg_speed <= 46 and rows[0].direction == "NB"
    assert not volumes.approach_speed(Sequence(spark, "82/5@0, 81/5@60", distance=400, min_speed=30)).collect()


def test_yellow_red_activations_lie_strictly_inside(spark):
    """A hit at the microsecond in which an interval starts or ends is in neither, as in the SQL."""
    text = "8/2@30, 82/5@30, 82/5@31, 9/2@35, 82/5@35, 82/6@36, 82/5@37, 1/2@40, 82/5@40"
    found = got(aggregates.yellow_red_activation_15min(Sequence(spark, text)), "yellow_activations", "red_activations", "red_duration_sum")
    assert found == [(1, 2, 5.0)]


def test_yellow_red_actuations(spark):
    text = "1/2@0, 82/5@5, 82/5@15, 8/2@30, 82/5@32, 9/2@35, 82/5@36, 10/2@37, 82/5@38, 1/2@60"
    found = got(arrivals.yellow_red_actuations(Sequence(spark, text)).orderBy("cycle_start"), "green_actuations", "yellow_actuations", "red_actuations", "total_actuations")
    assert found == [(2, 1, 2, 5), (0, 0, 0, 0)]
    assert got(arrivals.yellow_red_actuations(Sequence(spark, "1/2@0, 82/5@10, 8/2@30, 82/5@31")), "green_actuations", "yellow_actuations") == [(1, 1)]


@pytest.mark.parametrize(("text", "failure"), [
    ("1/2@0, 82/5@0, 8/2@30, 9/2@34, 81/5@40, 10/2@36, 1/2@60", True),
    ("1/2@0, 82/5@0, 81/5@1, 8/2@30, 9/2@34, 10/2@36, 1/2@60", False),
])
def test_split_failure(spark, text, failure):
    assert got(arrivals.split_failure(Sequence(spark, text)), "is_split_failure", "green_duration") == [(failure, 30.0)]


@pytest.mark.parametrize(("text", "want"), [
    ("1/2@0, 82/5@5, 82/5@10, 8/2@30, 82/5@35", (3, 2, 66.7)),
    ("82/5@5, 1/2@10, 8/2@40", (1, 0, 0.0)),
])
def test_arrivals_on_green(spark, text, want):
    (n, g, pct), = got(arrivals.arrivals_on_green(Sequence(spark, text)), "total_arrivals", "arrivals_on_green", "aog_percentage")
    assert (n, g, round(pct, 1)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("1/2@0, 10/2@35, 82/5@40, 82/5@50, 1/2@60", [(2, 15.0, 20.0, 10.0)]),
    ("1/2@0, 10/2@35, 1/2@60", [(0, 0.0, 0.0, 0.0)]),
])
def test_wait_time(spark, text, want):
    assert got(arrivals.wait_time(Sequence(spark, text)), "arrivals_during_red", "avg_wait_time", "max_wait_time", "min_wait_time") == want


@pytest.mark.parametrize(("text", "want"), [
    ("82/10@0, 21/4@20, 82/10@60, 21/4@75", [(2, 17.5, 20.0)]),
    ("82/10@0, 82/10@10, 21/4@30", [(2, 25.0, 30.0)]),
])
def test_ped_delay(spark, text, want):
    assert got(cycles.ped_delay(Sequence(spark, text, channels=((10, 4),))), "ped_actuations", "avg_delay_seconds", "max_delay_seconds") == want


def test_link_pivot(spark):
    tables = Sequence(spark, "1/2@0, 1/2@90")
    two = tables.log.unionByName(tables.log.withColumn("signal_id", F.lit("U")).withColumn("t", F.col("t") + 15_000_000))
    tables.__dict__["log"] = two
    tables.__dict__["route"] = spark.createDataFrame([("S", 0, 2), ("U", 1, 2)], "signal_id string, place int, phase int")
    assert got(cycles.link_pivot(tables), "avg_offset", "sample_count") == [(15.0, 2)]


def test_transit_signal_priority(spark):
    rows = cycles.transit_signal_priority(Sequence(spark, "112/1@0, 1/2@5, 8/2@40, 114/1@45, 1/2@90, 8/2@115")).collect()
    assert [(r.avg_green_with_tsp, r.avg_green_without_tsp) for r in rows] == [(35.0, 25.0)]


def test_ramp_metering(spark):
    text = "1/1@0, 82/10@1, 82/11@1.5, 8/1@2, 1/1@5, 82/10@6, 82/11@6.5, 8/1@7"
    rows = volumes.ramp_metering(Sequence(spark, text), demand=10, passage=11, queue=12, meter_phase=1).collect()
    assert [(r.demand_volume, r.passage_volume, r.avg_green_seconds, r.metering_rate, r.queue_occupancy_pct) for r in rows] == [(2, 2, 2.0, 8.0, None)]


@pytest.mark.parametrize(("text", "want"), [
    ("102/1@0, 105/1@5, 106/1@10, 107/1@18, 111/1@60", [(5.0, 13.0, 42.0, 8.0, None, False)]),
    ("105/1@0, 106/1@3, 107/1@9, 111/1@50", [(0.0, 9.0, 41.0, 6.0, None, False)]),
    ("102/1@0, 105/1@5, 106/1@10, 107/1@18, 110/1@120, 111/1@180", [(5.0, 13.0, 162.0, 8.0, 120.0, False)]),
    ("102/1@0, 105/1@5, 106/1@10, 111/1@60", [(5.0, 5.0, None, None, None, False)]),
    ("102/1@0, 105/1@5, 107/1@10, 106/1@18, 111/1@60", [(5.0, 13.0, 50.0, -8.0, None, False)]),
    ("102/1@0, 104/1@3, 111/1@60", [(None, None, None, None, None, False)]),
])
def test_preempt_detail(spark, text, want):
    assert got(preemption.preempt_detail(Sequence(spark, text)), "delay_seconds", "time_to_service_seconds", "dwell_time_seconds", "track_clear_seconds", "call_max_out_seconds", "terminated_by_timeout") == want


def test_preempt_detail_times_out(spark):
    rows = preemption.preempt_detail(Sequence(spark, "102/1@0, 105/1@5, 106/1@10, 107/1@18, 102/1@1500, 105/1@1503, 111/1@1560")).orderBy("cycle_start").collect()
    assert [r.terminated_by_timeout for r in rows] == [True, False]


def test_skips(spark):
    rows = got(cycles.phase_skips(Sequence(spark, "1/2@0, 1/4@10, 1/2@20, 1/2@30, 1/4@40")), "phase_number", "skip_count")
    assert rows == [(4, 1)]


def test_left_turn_gaps_clamp_at_zero(spark):
    # OFF without ON leaves the count at 0, so the next ON closes a gap.
    rows = got(leftturn.gaps(Sequence(spark, "1/2@0, 81/5@1, 82/5@4, 82/6@5, 81/5@6, 81/6@8, 82/5@13, 8/2@30, 82/6@31")).orderBy("gap"), "gap")
    assert rows == [(3.0,), (5.0,)]


def test_stuck_and_gaps(spark):
    tables = Sequence(spark, "82/5@0, 82/5@10, 81/5@15, 82/5@30")
    assert got(analytics.detectors_gaps(tables), "event_count", "avg_gap_seconds", "min_gap_seconds", "max_gap_seconds") == [(3, 15.0, 10.0, 20.0)]


def test_empty_log(spark):
    tables = Sequence(spark, "1/2@0")
    tables.__dict__["log"] = tables.log.limit(0)
    for operator in (arrivals.approach_delay, arrivals.split_failure, cycles.purdue_diagram, cycles.phase_skips, preemption.preempt_detail, leftturn.gaps):
        assert operator(tables).count() == 0


def test_bins(spark):
    minutes = [0, 14, 15, 44, 45, 59]
    rows = spark.createDataFrame([(T0 + m * 60_000_000,) for m in minutes], "t long")
    out = [r[0] for r in rows.select(((temporal.bin_of_hour(F.col("t"), 25) - T0) / 60_000_000).cast("int")).collect()]
    assert out == [0, 0, 0, 25, 25, 50]


def test_split_over_bins(spark):
    rows = spark.createDataFrame([(T0 + 14 * 60_000_000, T0 + 16 * 60_000_000)], "a long, b long")
    out = temporal.split_over_bins(rows, "a", "b", F.lit(T0), 900_000_000).orderBy("bin").collect()
    assert [r.inside for r in out] == [60_000_000, 60_000_000]


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("S", 5), ("S", 10), ("S", 15), ("U", 7)], "signal_id string, t long")
    right = spark.createDataFrame([("S", 10, 1), ("S", 12, 2)], "signal_id string, t long, plan int")
    found = temporal.asof_backward(left, right, ["signal_id"], ["plan"]).orderBy("signal_id", "t").collect()
    assert [r.plan for r in found] == [None, 1, 2, None]


def test_times_keep_microseconds(spark):
    moment = ZERO + timedelta(microseconds=123_456)
    rows = spark.createDataFrame([(moment,)], "ts timestamp_ntz").select(temporal.micros(F.col("ts")).alias("t"))
    assert rows.first().t == T0 + 123_456
    assert rows.select(temporal.timestamp(F.col("t"))).first()[0] == moment


def test_latest_status_counts_all_rows(spark):
    """The faulty event is older than 60 good ones; it shows all the same."""
    from types import SimpleNamespace

    from junctura.operators.quality import latest_status

    rows = [("a", 0, 999, 1), ("a", 1, 1, 7), *(("a", t, 1, 2) for t in range(2, 62)), ("b", 0, 1, 2)]
    log = spark.createDataFrame(rows, "signal_id string, t long, code int, param int")
    got = latest_status(SimpleNamespace(between=lambda: log)).collect()
    assert {(r.signal_id, r.merged, r.n) for r in got} == {("a", "invalid", 1), ("a", "suspect", 1), ("a", "clean", 60), ("b", "clean", 1)}


def test_left_turn_volume_report_covers_the_whole_day(spark):
    """One left turn an hour from the half hour on; a window of hours holds only its own."""
    from types import SimpleNamespace

    day = T0 - 8 * 3_600_000_000
    hits = spark.createDataFrame([("S", 2, "L", day + h * 3_600_000_000 + 1_800_000_000) for h in range(24)], "signal_id string, phase int, movement string, t long")
    approaches = spark.createDataFrame([("S", f"A{p}", p, d) for p, d in ((2, "NB"), (6, "SB"))], "signal_id string, approach_id string, phase int, direction string")
    detectors = spark.createDataFrame([("S", 2, "L"), ("S", 6, "T")], "signal_id string, phase int, movement string")
    tables = SimpleNamespace(arrivals=lambda: hits, approaches=approaches, detectors=detectors)
    whole = leftturn.left_turn_volume_report(tables).collect()
    assert len(whole) == 24 and {r.left_turn_volume for r in whole} == {24}
    part = leftturn.left_turn_volume(tables, opposing={2: 6, 6: 2}, first=1.0, final=11.0).collect()
    assert sorted(r.bin_start.hour for r in part) == list(range(1, 11)) and {r.left_turn_volume for r in part} == {10}


@pytest.mark.parametrize(("text", "want"), [
    ("1/2@0, 82/5@0, 82/5@1.9, 82/6@2, 8/2@10, 82/5@10, 82/5@10.5", [(0, 2), (1, 1), (5, 1)]),
    ("1/2@0, 82/5@3, 1/2@5, 82/5@6, 8/2@10, 8/2@12, 82/5@12", [(0, 1)]),
    ("82/5@1, 8/2@2, 1/2@5, 82/5@6", []),
    ("1/2@0, 8/2@0, 82/5@0, 1/2@20, 82/7@21, 8/2@30", [(0, 1)]),
])
def test_green_detections(spark, text, want):
    assert sorted(got(cycles.green_detections(Sequence(spark, text)), "y_bin", "detections")) == want


def test_permissive_phases(spark):
    tables = Sequence(spark, "1/2@0, 82/5@1, 1/7@0, 9/7@2, 82/6@3")
    mine = tables.detectors.withColumn("permissive_phase", F.lit(7)).withColumn("phase", F.when(F.col("channel") == 5, 2))
    tables.detectors = mine
    columns = "phase_number", "total_detections", "arrivals_on_red"
    assert got(arrivals.arrival_on_red(tables), *columns) == [(2, 1, 0)]
    assert sorted(got(arrivals.arrival_on_red(tables, include_permissive=True), *columns)) == [(2, 1, 0), (7, 1, 1)]


def test_nearest_rank(spark):
    tables = Sequence(spark, "1/2@0")
    tables.speeds = spark.createDataFrame([("S", "A", T0, v) for v in (10, 20, 30, 40)] + [("S", "B", T0, 7)], "signal_id string, approach_id string, t long, mph int")
    rows = aggregates.approach_speed_15min_nearest(tables)
    assert sorted(got(rows, "approach_id", "p15", "p50", "p85", "sample_count")) == [("A", 10.0, 20.0, 40.0, 4), ("B", 7.0, 7.0, 7.0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_arrivals_of_random_logs_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    events = sorted({(rng.randrange(0, 4000, 5), rng.choice((1, 8, 9, 10, 82, 82, 82))) for _ in range(500)})
    tables = Sequence(spark, ", ".join(f"{c}/{5 if c == 82 else 2}@{t}" for t, c in events))
    greens = [t for t, c in events if c == 1]
    cycles = []
    for a, b in zip(greens, [*greens[1:], 10**9]):
        first = lambda code, a=a, b=b: next((t for t, c in events if c == code and a <= t < b and t - a <= 300), None)
        cycles.append((a, first(8), first(9), first(10)))
    want, counted = [], {a: [0, 0, 0] for a, *_ in cycles}
    for t, _ in (e for e in events if e[1] == 82):
        mine = [k for k in cycles if k[0] <= t and k[1] is not None and k[2] is not None]
        if mine and t < (mine[-1][3] if mine[-1][3] is not None else mine[-1][0] + 300):
            a, y, r, _ = mine[-1]
            state = 2 if t >= r else 1 if t >= y else 0
            want.append((a, t, ("green", "yellow", "red")[state]))
            counted[a][state] += 1
    rows = aggregates.cycle_detector_arrival(tables).collect()
    assert sorted(((r.green_start - ZERO).total_seconds(), (r.arrival_time - ZERO).total_seconds(), r.phase_state) for r in rows) == want and want
    out = aggregates.cycle_summary_15min(tables).collect()
    sums = [sum(r[c] for r in out) for c in ("total_cycles", "arrivals_on_green", "arrivals_on_yellow", "arrivals_on_red")]
    assert sums == [len(cycles), *(sum(v[k] for v in counted.values()) for k in range(3))]


@pytest.mark.parametrize("seed", range(3))
def test_gaps_of_random_logs_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    events = sorted({(t, c, 2 if c in (1, 8, 45) else rng.choice((5, 6))) for t, c in ((rng.randrange(0, 900), rng.choice((1, 8, 8, 45, 81, 81, 82, 82, 82))) for _ in range(400))})
    tables = Sequence(spark, ", ".join(f"{c}/{p}@{t}" for t, c, p in events))
    greens = [k for k, e in enumerate(events) if e[1] == 1]
    want = []
    for a, b in zip(greens, [*greens[1:], len(events)]):
        end = max((t for t, c, _ in events[a:b] if c == 8), default=-1)
        on, opened = 0, None
        for t, c, _ in (e for e in events[a:b] if e[1] in (81, 82) and e[0] <= end):
            if c == 82:
                if opened is not None and t > opened:
                    want.append(float(t - opened))
                on, opened = on + 1, None
            else:
                on = max(0, on - 1)
                opened = t if on == 0 else None
    assert sorted(r.gap for r in leftturn.gaps(tables).collect()) == sorted(want) and want
