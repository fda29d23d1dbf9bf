"""The usual cycle over several days: hand-known days, refusals, and random logs against a plain walk."""

import random
from datetime import datetime, timedelta

import pytest

from junctura.operators import corridor
from junctura.sources.derived import DAY, START, Tables

MONDAY = datetime(2024, 1, 1)
SECOND = 1_000_000


class Days(Tables):
    """Signals along a route at phase 2; events (signal, day, seconds from 07:00, code), plans (signal, day, number, cycle, offset, split)."""

    def __init__(self, spark, events, plans, route=(("A", 0, 2),)):
        super().__init__(spark, "", START, START + 7 * DAY - 1)
        at = lambda day, s: START + day * DAY + 7 * 3600 * SECOND + round(s * SECOND)
        self.log = spark.createDataFrame([(g, at(d, s), c, 2) for g, d, s, c in events], "signal_id string, t long, code int, param int")
        ends = [next((at(q[1], -3600) for q in sorted(plans) if q[0] == p[0] and q[1] > p[1]), None) for p in plans]
        rows = [(g, n, at(d, -3600), f, c, o, {2: s} if s else None) for (g, d, n, c, o, s), f in zip(plans, ends, strict=True)]
        self.plans = spark.createDataFrame(rows, "signal_id string, plan_number int, begin long, finish long, cycle_length int, offset_seconds int, splits map<int, int>")
        self.route = spark.createDataFrame(list(route), "signal_id string, place int, phase int")

    def over(self, *_, **__):
        return self


def cycle(signal, day, at, green, yellow, red):
    return [(signal, day, at, 1), (signal, day, at + green, 8), (signal, day, at + green + yellow, 9), (signal, day, at + green + yellow + red, 1)]


def test_the_middle_cycle_of_three_days(spark):
    events = cycle("A", 0, 0, 20, 4, 30) + cycle("A", 1, 10, 40, 5, 41) + cycle("A", 2, 5, 30, 3, 50)
    tables = Days(spark, events, [("A", 0, 1, 90, 10, 35)])
    rows = corridor.time_space_average_days(tables, end_time="07:05").orderBy("event_time").collect()
    # ref = 10 - (30 + 3 - 35) = 12 s, back by one cycle of 90 s; greens up to 07:07.
    greens = [(r.cycle_index, (r.event_time - MONDAY - timedelta(hours=7)).total_seconds()) for r in rows if r.event == "green"]
    assert greens == [(k, 12 + 90 * (k - 1)) for k in range(6)]
    assert [(r.event, (r.event_time - rows[0].event_time).total_seconds()) for r in rows[:4]] == [("green", 0), ("yellow", 30), ("red", 33), ("green", 90)]
    assert {(r.cycle_length_seconds, r.median_green_seconds, r.median_yellow_seconds, r.median_red_seconds, r.programmed_split_seconds, r.days_included) for r in rows} == {(90.0, 30.0, 3.0, 50.0, 35.0, 3)}


@pytest.mark.parametrize("change", [(80, 10, 35), (90, 11, 35), (90, 10, 36), (90, 10, None)])
def test_other_plans_are_refused_with_their_days(spark, change):
    events = cycle("A", 0, 0, 20, 4, 30) + cycle("A", 1, 0, 21, 4, 30) + cycle("A", 2, 0, 40, 4, 30)
    tables = Days(spark, events, [("A", 0, 1, 90, 10, 35), ("A", 2, 2, *change), ("A", 4, 3, 90, 10, 35)])
    with pytest.raises(Exception, match="the plan of A differs from the first day's on 2024-01-03, 2024-01-04"):
        corridor.time_space_average_days(tables).collect()
    assert {r.median_green_seconds for r in corridor.time_space_average_days(tables, days_of_week=(0, 1)).collect()} == {21.0}
    assert {(r.median_green_seconds, r.days_included) for r in corridor.time_space_average_days(tables, unequal="drop").collect()} == {(21.0, 2)}


def test_same_values_under_another_number_are_one_plan(spark):
    tables = Days(spark, cycle("A", 0, 0, 20, 4, 30), [("A", 0, 1, 90, 10, 35), ("A", 3, 7, 90, 10, 35)])
    assert corridor.time_space_average_days(tables).count() > 0


def test_whose_plan_counts(spark):
    events = cycle("A", 0, 0, 20, 4, 30) + cycle("B", 0, 0, 20, 4, 30) + cycle("B", 1, 0, 25, 4, 30)
    tables = Days(spark, events, [("A", 0, 1, 90, 10, 35), ("B", 0, 1, 70, 0, 30), ("B", 1, 2, 75, 0, 30)], (("A", 0, 2), ("B", 1, 2)))
    first = {r.signal_id: (r.cycle_length_seconds, r.days_included, r.distance_ft) for r in corridor.time_space_average_days(tables).collect()}
    assert first == {"A": (90.0, 1, 0.0), "B": (90.0, 2, 1000.0)}
    own = {r.signal_id: (r.cycle_length_seconds, r.days_included) for r in corridor.time_space_average_days(tables, unequal="drop", own_plans=True).collect()}
    assert own == {"A": (90.0, 1), "B": (70.0, 1)}
    with pytest.raises(Exception, match="the plan of B differs"):
        corridor.time_space_average_days(tables, own_plans=True).collect()


def test_nothing_to_lay_out(spark):
    plain = Days(spark, cycle("A", 0, 0, 20, 4, 30), [])
    rows = corridor.time_space_average_days(plain).collect()  # no plan: no offset, no split, every day counts
    assert {(r.cycle_length_seconds, r.programmed_split_seconds) for r in rows} == {(54.0, 0.0)}
    assert not corridor.time_space_average_days(plain, start_date="2024-01-02", end_date="2024-01-03", days_of_week=(5, 6)).collect()
    assert not corridor.time_space_average_days(plain, start_time="09:00", end_time="07:00").collect()
    assert not corridor.time_space_average_days(Days(spark, [], []).over()).collect()
    with pytest.raises(ValueError, match="unequal"):
        corridor.time_space_average_days(plain, unequal="keep")


def walked(events, signal, days):
    """Cycles (green, day, start, yellow, red) by a plain walk over pairs of greens."""
    out = []
    for day in days:
        mine = sorted((s, c) for g, d, s, c in events if g == signal and d == day and 0 <= s <= 7200)
        greens = [s for s, c in mine if c == 1]
        for a, b in zip(greens, greens[1:]):
            y, r = (next((s for s, c in mine if c == code and a < s < b), None) for code in (8, 9))
            if y is not None and r is not None and r > y:
                out.append((y - a, day, a, r - y, b - r))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_random_days_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice("AB"), rng.randrange(7), rng.randrange(-100, 7300, 10), rng.choice((1, 1, 8, 9))) for _ in range(900)]
    events = sorted(set(events))
    tables = Days(spark, events, [("A", 0, 1, 60, 15, 20)], (("A", 0, 2), ("B", 1, 2)))
    got = {r.signal_id: (r.median_green_seconds, r.median_yellow_seconds, r.median_red_seconds, r.days_included) for r in corridor.time_space_average_days(tables, days_of_week=(0, 2, 4, 5)).collect()}
    want = {}
    for signal in "AB":
        found = walked(events, signal, (0, 2, 4, 5))
        green, _, _, yellow, red = found[len(found) // 2]
        want[signal] = (green, yellow, red, len({d for _, d, *_ in found}))
    assert got == want
