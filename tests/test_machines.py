"""State machines over long histories against plain walks of random logs."""

import random

import pytest

from junctura.operators import cycles, preemption
from test_sequences import T0, Sequence

MINUTE = 60_000_000


def plain_skips(greens):
    """(phase, time) of every skip of one signal's greens."""
    seen, known, out = set(), set(), []
    for t, p in sorted(greens):
        known.add(p)
        if p in seen:
            out += [(q, t) for q in known - seen]
            seen = set()
        seen.add(p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_skips_equal_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    phases, rows = [2, 4, 6, 8, 1, 63][: 3 + seed], []
    for signal in "AB":
        t = T0
        for _ in range(250):
            t += rng.choice([0, 5, 20, 400]) * 1_000_000
            rows.append((signal, t, 1, rng.choice(phases)))
    tables = Sequence(spark, "1/2@0")
    tables.__dict__["log"] = spark.createDataFrame(rows, "signal_id string, t long, code int, param int")
    want = {}
    for signal in "AB":
        for p, t in plain_skips([(t, p) for s, t, _, p in rows if s == signal]):
            key = (signal, p, t // (15 * MINUTE))
            want[key] = want.get(key, 0) + 1
    for chunk in (5, 60):
        found = cycles.phase_skips(tables, chunk_minutes=chunk).collect()
        assert {(r.signal_id, r.phase_number, int(r.bin_start.replace(tzinfo=__import__("datetime").UTC).timestamp() * 1e6) // (15 * MINUTE)): r.skip_count for r in found} == want


def plain_preempts(events, idle=20 * MINUTE):
    """(start, finish, has_delay, timeout, calls, entry, first of each inner code) of one channel."""
    out, now, last = [], None, None
    close = lambda at, timeout: out.append((now["start"], at, now["delay"], timeout, now["calls"], now["entry"], tuple(now["in"].get(c) for c in (103, 104, 106, 107, 110))))
    for t, code in sorted(events):
        if now and t - last > idle:
            close(last, True)
            now = None
        if code == 105 and now and not (now["delay"] and now["entry"] is None):
            close(t, False)
            now = None
        if now is None and code in (102, 105):
            now = {"start": t, "delay": code == 102, "calls": 0, "entry": None, "in": {}}
        if now:
            if code == 102:
                now["calls"] += 1
            elif code == 105:
                now["entry"] = t
            elif code == 111:
                close(t, False)
                now = None
            else:
                now["in"].setdefault(code, t)
        last = t
    if now:
        close(last, False)
    return out


def random_log(seed, n=160):
    rng, rows = random.Random(seed), set()
    for channel in (1, 2):
        t = T0
        for _ in range(n):
            t += rng.choice([0, 1, 5, 60, 700, 1200, 1201, 3000]) * 1_000_000
            rows.add((t, rng.choice([102, 102, 105, 105, 103, 104, 106, 107, 108, 109, 110, 111]), channel))
    return sorted(rows)


@pytest.mark.parametrize("seed", range(4))
def test_preempts_equal_a_plain_walk(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame([("S", t, c, p) for t, c, p in rows], "signal_id string, t long, code int, param int")
    want = sorted((p, *r) for p in (1, 2) for r in plain_preempts([(t, c) for t, c, q in rows if q == p]))
    for chunk in (10.0, 60.0, 100_000.0):
        found = preemption.walked(log, chunk_minutes=chunk).collect()
        assert sorted((r.param, r.start, r.finish, r.has_delay, r.terminated_by_timeout, r.calls, r.entry, (r.gate_down, r.input_off, r.begin_track_clearance, r.begin_dwell_service, r.max_presence_exceeded)) for r in found) == want
