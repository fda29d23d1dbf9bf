"""State machines over streams that arrive out of order: preempts, plans, silent devices.

`Ordered` keeps the rows of a key until the watermark has passed them and then takes them in the order of
event time, so any split into batches and any order within the lateness give what the batch gives. A machine
may close by itself: an event-time timer fires once the watermark shows that nothing can follow its last event within its idle time.
A key without waiting rows and without an open machine keeps no state.

Rows as late as the watermark are dropped by Spark before they come here; rows that are repeated before it are taken once.
All these need the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from junctura.functions.temporal import MINUTE
from junctura.functions.vocabulary import CYCLE_LENGTH, FIRST_SPLIT, LAST_SPLIT, OFFSET, PATTERN, PREEMPT_CALL, PREEMPT_ENTRY
from junctura.operators.preemption import EXIT, INSIDE, described

Event = tuple[int, int, int]


class Ordered(StatefulProcessor):
    """A machine for each key. Subclasses say what an event does, and what closing after ``idle`` microseconds gives."""

    idle: int | None = None
    columns: list[str] = []

    def step(self, key: tuple, now: dict | None, event: Event) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def expired(self, key: tuple, now: dict) -> list[tuple]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "t long, code int, param int")
        self._open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = set(map(tuple, self._waiting.get())) if self._waiting.exists() else set()
        for part in rows:
            held |= set(zip(part.t.astype(int).tolist(), part.code.astype(int).tolist(), part.param.astype(int).tolist(), strict=True))
        self._waiting.put(sorted(held))
        self._handle.registerTimer(_millis(min(held)[0]))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._frame(self._drained(key, timerValues.getCurrentWatermarkInMs() * 1000))

    def _drained(self, key: tuple, upto: int) -> list[tuple]:
        held = sorted(set(map(tuple, self._waiting.get()))) if self._waiting.exists() else []
        now, out = json.loads(self._open.get()[0]) if self._open.exists() else None, []
        for event in (e for e in held if e[0] <= upto):
            if self._over(now, event[0]):
                out += self.expired(key, now)
                now = None
            now, rows = self.step(key, now, event)
            out += rows
            if now is not None:
                now["last"] = event[0]
        if self._over(now, upto):
            out += self.expired(key, now)
            now = None
        left = [e for e in held if e[0] > upto]
        if left:
            self._waiting.put(left)
            self._handle.registerTimer(_millis(left[0][0]))
        elif held:
            self._waiting.clear()
        if now is None:
            self._open.clear()
        else:
            self._open.update((json.dumps(now),))
            if self.idle is not None:
                self._handle.registerTimer(_millis(now["last"] + self.idle) + 1)
        return out

    def _over(self, now: dict | None, t: int) -> bool:
        return now is not None and self.idle is not None and t - now["last"] > self.idle

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(self.columns)})

    def close(self) -> None:
        pass


def _millis(t: int) -> int:
    return -(-t // 1000)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("map<string,int>", "map").split(", ")]


def _run(events: DataFrame, keys: list[str], machine: Ordered, schema: str, late: str) -> DataFrame:
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    rows = timed.select(*keys, F.unix_micros("event_time").alias("t"), F.col("event_code").alias("code"), F.col("event_param").alias("param"), "event_time")
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


PREEMPTS = "signal_id string, channel int, start long, finish long, has_delay boolean, terminated_by_timeout boolean, calls long, input_on long, entry long, " + ", ".join(f"{n} long" for n in INSIDE.values())


class Preempts(Ordered):
    """One preempt of a channel after another; comes out when it ends."""

    columns = _names(PREEMPTS)

    def __init__(self, idle_minutes: float = 20.0) -> None:
        self.idle = int(idle_minutes * MINUTE)

    def step(self, key: tuple, now: dict | None, event: Event) -> tuple[dict | None, list[tuple]]:
        (t, code, _), out = event, []
        if code == PREEMPT_ENTRY and now and now["entry"] is not None:
            out.append(self._row(key, now, t, False))
            now = None
        if now is None:
            if code not in (PREEMPT_CALL, PREEMPT_ENTRY):
                return None, out
            now = {"start": t, "delay": code == PREEMPT_CALL, "calls": 0, "input_on": None, "entry": None, "inside": {}}
        if code == PREEMPT_CALL:
            now["calls"] += 1
            now["input_on"] = t if now["input_on"] is None else now["input_on"]
        elif code == PREEMPT_ENTRY:
            now["entry"] = t
        elif code == EXIT:
            return None, [*out, self._row(key, now, t, False)]
        elif code in INSIDE:
            now["inside"].setdefault(INSIDE[code], t)
        return now, out

    def expired(self, key: tuple, now: dict) -> list[tuple]:
        return [self._row(key, now, now["last"], True)]

    def _row(self, key: tuple, now: dict, finish: int, timeout: bool) -> tuple:
        return (*key, now["start"], finish, now["delay"], timeout, now["calls"], now["input_on"], now["entry"], *(now["inside"].get(n) for n in INSIDE.values()))


def preempts(events: DataFrame, late: str = "10 minutes", idle_minutes: float = 20.0) -> DataFrame:
    """The preempt detail of a stream of events: a preempt comes out when the watermark passes its end, or 20 idle minutes after its last event."""
    rows = events.where(F.col("event_code").between(102, EXIT)).withColumn("channel", F.col("event_param"))
    found = _run(rows, ["signal_id", "channel"], Preempts(idle_minutes), PREEMPTS, late)
    return described(found.withColumnRenamed("channel", "param"))


PLAN_SCHEMA = "signal_id string, effective_from timestamp, effective_to timestamp, plan_number int, cycle_length int, offset_seconds int, splits map<string,int>"
_PLANS = "signal_id string, effective_from long, effective_to long, plan_number int, cycle_length int, offset_seconds int, splits map<string,int>"


class Plans(Ordered):
    """A signal's open plan: 132 to 149 change it, the next 131 closes it and opens another. Closed plans come out."""

    columns = _names(_PLANS)

    def step(self, key: tuple, now: dict | None, event: Event) -> tuple[dict | None, list[tuple]]:
        t, code, param = event
        if code == PATTERN:
            closed = [(*key, now["begin"], t, now["plan"], now.get("length"), now.get("offset"), now["splits"])] if now else []
            return {"begin": t, "plan": param, "splits": {}}, closed
        if now is not None:
            if code == CYCLE_LENGTH:
                now["length"] = param
            elif code == OFFSET:
                now["offset"] = param
            elif FIRST_SPLIT <= code <= LAST_SPLIT:
                now["splits"][str(code - FIRST_SPLIT + 1)] = param
        return now, []


def closed_plans(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Plans as the watermark passes their end."""
    found = _run(events.where(F.col("event_code").between(PATTERN, LAST_SPLIT)), ["signal_id"], Plans(), _PLANS, late)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("effective_from", "effective_to")})


DEVICES = "device_id string, polled_at timestamp, kind string, cursor timestamp, silent_polls int, drift_seconds double"


class Devices(StatefulProcessor):
    """A device's cursor and how often in a row it had nothing; see `device_watch`."""

    def __init__(self, threshold: int, tolerance_seconds: float) -> None:
        self.threshold, self.tolerance = threshold, int(tolerance_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("device", "polled long, cursor long, silent int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        polled, cursor, silent = self._state.get() if self._state.exists() else (None, None, 0)
        polls, out = pd.concat(list(rows)).sort_values("polled"), []
        for t, n, last in zip(polls.polled, polls.events, polls["last"], strict=True):
            t = int(t)
            if polled is not None and t <= polled:
                continue  # a poll that is told again
            polled = t
            if n > 0:
                cursor, silent = max(cursor or 0, int(last)), 0
                out.append((key[0], t, "read", cursor, 0, None))
                continue
            silent += 1
            if silent < self.threshold:
                continue
            if cursor is not None and cursor > t + self.tolerance:
                out.append((key[0], t, "poisoned", t, silent, (cursor - t) / 1e6))
                cursor, silent = t, 0
            else:
                out.append((key[0], t, "silent", cursor, silent, None))
        self._state.update((polled, cursor, silent))
        names = ["device_id", "polled_at", "kind", "cursor", "silent_polls", "drift_seconds"]
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(names)})

    def close(self) -> None:
        pass


def device_watch(polls: DataFrame, threshold: int = 3, tolerance_seconds: float = 300.0) -> DataFrame:
    """Cursors and alerts from a stream of poll results.

    ``polls``: device_id, polled_at, events (how many), last_event (their latest time, null without any).
    A poll with events moves the cursor ("read"). From the ``threshold``-th poll in a row without any on, each gives an alert:
    "poisoned" if the cursor lies in the future by more than the tolerance, as after events of a clock that ran ahead, which
    hide all later ones; it is then rolled back to the time of the poll and the count begins anew; else "silent". Polls no later
    than the last one taken are left out, so repeated ones count once.
    """
    of = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = polls.select("device_id", of("polled_at").alias("polled"), F.col("events").cast("long").alias("events"), F.coalesce(of("last_event"), F.lit(0)).alias("last"))
    schema = DEVICES.replace("polled_at timestamp", "polled_at long").replace("cursor timestamp", "cursor long")
    found = rows.groupBy("device_id").transformWithStateInPandas(statefulProcessor=Devices(threshold, tolerance_seconds), outputStructType=schema, outputMode="Append", timeMode="None")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("polled_at", "cursor")})
