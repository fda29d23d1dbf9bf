"""Preemption: services, requests, their plans, and the state of each preempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, along, asof_backward, seconds, timestamp
from junctura.functions.vocabulary import PREEMPT_CALL, PREEMPT_ENTRY, PREEMPT_OFF
from junctura.sources.derived import Tables


def _with_plan(tables: Tables, code: int, count: str) -> DataFrame:
    """Events of a code with the plan in force, "unknown" and the window's bounds where there is none.

    Plans of one signal do not overlap, so the first and the last that match are the same: the latest
    to begin at or before the event, as long as it has not finished.
    """
    events = tables.between(code).select("signal_id", "t", "param")
    met = asof_backward(events, tables.plans.select("signal_id", F.col("begin").alias("t"), "plan_number", F.col("begin").alias("plan_begin"), "finish"), ["signal_id"], ["plan_number", "plan_begin", "finish"])
    there = F.col("plan_number").isNotNull() & (F.col("finish").isNull() | (F.col("finish") > F.col("t")))
    plan = F.when(there, F.col("plan_number").cast("string")).otherwise("unknown")
    rows = met.withColumn("plan", plan).withColumn("b", F.when(there, F.col("plan_begin")).otherwise(tables.start)).withColumn("e", F.when(there, F.coalesce("finish", F.lit(tables.end))).otherwise(tables.end))
    counted = rows.withColumn(count, F.count("*").over(Window.partitionBy("signal_id", "plan")))
    return counted.select("signal_id", timestamp(F.col("t")).alias("event_time"), F.col("param").alias("event_param"), F.col("plan").alias("plan_number"), timestamp(F.col("b")).alias("plan_start"), timestamp(F.col("e")).alias("plan_end"), count)


def preempt_service(tables: Tables) -> DataFrame:
    return _with_plan(tables, PREEMPT_ENTRY, "plan_preempt_count")


def preempt_service_request(tables: Tables) -> DataFrame:
    return _with_plan(tables, PREEMPT_CALL, "plan_request_count")


def preemption(tables: Tables) -> DataFrame:
    """The latest call of a channel paired with the next input off."""
    w = along(["signal_id", "param"], ("t", "code"))
    rows = tables.between(PREEMPT_CALL, PREEMPT_OFF).withColumn("before", F.lag("code").over(w)).withColumn("begin", F.lag("t").over(w))
    paired = rows.where((F.col("code") == PREEMPT_OFF) & (F.col("before") == PREEMPT_CALL))
    return paired.select("signal_id", F.col("param").alias("channel"), timestamp(F.col("begin")).alias("start"), timestamp(F.col("t")).alias("end"), seconds(F.col("t") - F.col("begin")).alias("duration_seconds"))


#: Events inside a service, of which the first counts, and the column that each gives.
INSIDE = {103: "gate_down", 104: "input_off", 106: "begin_track_clearance", 107: "begin_dwell_service", 110: "max_presence_exceeded"}
EXIT = 111
KEY = ["signal_id", "param"]


def described(rows: DataFrame) -> DataFrame:
    """The report's columns from preempts as they were walked.

    ``rows``: signal_id, param, start, finish, has_delay, terminated_by_timeout, calls and, in microseconds or null, the
    first input_on, entry and `INSIDE` events. Service begins at the later of track clearance and dwell.
    """
    begin = F.when(F.col("has_delay"), F.coalesce("entry", "start")).otherwise(F.col("start"))
    delay = F.when(~F.col("has_delay"), 0.0).otherwise(seconds(F.col("entry") - F.col("start")))
    at = lambda c, name: timestamp(F.col(c)).alias(name)
    return rows.select(
        "signal_id", F.col("param").alias("preempt_number"), at("start", "cycle_start"), at("finish", "cycle_end"), timestamp(F.coalesce("input_on", "entry", "start")).alias("input_on"), at("input_off", "input_off"),
        at("gate_down", "gate_down"), at("entry", "entry_started"), *(at(c, c) for c in ("begin_track_clearance", "begin_dwell_service", "max_presence_exceeded")), "has_delay", delay.alias("delay_seconds"),
        seconds(F.greatest("begin_track_clearance", "begin_dwell_service") - begin).alias("time_to_service_seconds"), seconds(F.col("finish") - F.col("begin_dwell_service")).alias("dwell_time_seconds"),
        seconds(F.col("begin_dwell_service") - F.col("begin_track_clearance")).alias("track_clear_seconds"), seconds(F.col("max_presence_exceeded") - F.col("start")).alias("call_max_out_seconds"), "terminated_by_timeout", "calls",
    )


def walked(events: DataFrame, idle_minutes: float = 20.0, chunk_minutes: float = 60.0) -> DataFrame:
    """Preempts of each (signal, channel) from rows signal_id, t, code (102 to 111), param.

    A call opens a preempt (or joins the open one); an entry fills it, opens one without delay, or, where the open one has an
    entry, closes it and opens the next; 111 closes; so does, at its last event, a gap of more than ``idle_minutes``.

    What is open after an event depends only on the calls and entries since the channel was last reset, by a 111 or a gap:
    an entry means served (2), a call alone waiting (1). So the machine needs no walk: each chunk of a
    channel's time is one window, a row for each chunk tells what it leaves open, and a running maximum over these rows since the last reset
    tells each chunk what it finds open. A channel with a long history is thus spread over as many tasks as it has chunks.
    """
    idle, chunk = int(idle_minutes * MINUTE), int(chunk_minutes * MINUTE)
    piece = [*KEY, "chunk"]
    w = along(piece, ("t", "code"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*piece, "run").orderBy("t", "code").rowsBetween(Window.unboundedPreceding, -1)
    code, t = F.col("code"), F.col("t")
    rows = events.select(*KEY, "t", "code", F.floor(t / chunk).alias("chunk"))
    reset = (F.lag("code").over(w) == EXIT) | (t - F.lag("t").over(w) > idle)
    opens = F.when(code == PREEMPT_ENTRY, 2).when(code == PREEMPT_CALL, 1).otherwise(0)
    rows = rows.withColumn("reset", F.coalesce(reset, F.lit(False)).cast("int")).withColumn("run", F.sum("reset").over(upto)).withColumn("opens", opens)

    # What each chunk leaves open; the last run of its resets decides.
    ends = rows.groupBy(*piece).agg(F.min("t").alias("first_t"), F.max(F.struct("t", "code")).alias("last"), F.max("run").alias("resets"), F.max(F.struct("run", "opens"))["opens"].alias("left"))
    along_chunks = Window.partitionBy(*KEY).orderBy("chunk")
    seam = F.coalesce((F.lag("last").over(along_chunks)["code"] == EXIT) | (F.col("first_t") - F.lag("last").over(along_chunks)["t"] > idle), F.lit(True))
    ends = ends.withColumn("seam", seam).withColumn("part", F.sum((F.col("seam") | (F.col("resets") > 0)).cast("int")).over(along_chunks))
    ends = ends.withColumn("open", F.max("left").over(Window.partitionBy(*KEY, "part").orderBy("chunk")))
    found = F.when(F.col("seam"), 0).otherwise(F.lag("open").over(along_chunks))
    ends = ends.select(*piece, found.alias("found"), F.max("last").over(Window.partitionBy(*KEY)).alias("channel_last"))

    met = rows.join(ends, piece)
    was = F.greatest(F.coalesce(F.max("opens").over(before), F.lit(0)), F.when(F.col("run") == 0, F.col("found")).otherwise(0))
    met = met.withColumn("was", was).withColumn("opened", F.when((code == PREEMPT_CALL) & (F.col("was") == 0) | (code == PREEMPT_ENTRY) & (F.col("was") != 1), t))
    met = met.where(F.greatest("was", "opens") > 0).withColumn("start", F.last("opened", True).over(upto))
    first = lambda c: F.min(F.when(code == c, t))
    facts = {"input_on": first(PREEMPT_CALL), "entry": first(PREEMPT_ENTRY)} | {name: first(c) for c, name in INSIDE.items()}
    pieces = met.groupBy(*piece, "start").agg(*(v.alias(k) for k, v in facts.items()), F.count(F.when(code == PREEMPT_CALL, 1)).alias("calls"), F.max(F.struct("t", "code")).alias("last"), F.max("channel_last").alias("channel_last"))

    # The part of a preempt that a chunk found open belongs to the latest one opened before.
    pieces = pieces.withColumn("start", F.last("start", True).over(Window.partitionBy(*KEY).orderBy("chunk", F.col("start").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy(*KEY, "start").agg(*(F.min(k).alias(k) for k in facts), F.sum("calls").alias("calls"), F.max("last").alias("last"), F.max("channel_last").alias("channel_last"))
    following = F.lead("start").over(Window.partitionBy(*KEY).orderBy("start"))
    left = F.col("last")["code"] == EXIT
    whole = whole.withColumn("next", F.when(~left & (following - F.col("last")["t"] <= idle), following))
    timeout = ~left & F.col("next").isNull() & (F.col("channel_last") > F.col("last"))
    finish = F.coalesce("next", F.col("last")["t"])
    whole = whole.withColumn("has_delay", F.coalesce(F.col("input_on") == F.col("start"), F.lit(False))).withColumn("finish", finish)
    return whole.withColumn("terminated_by_timeout", timeout).drop("last", "next", "channel_last")


def detail_of(events: DataFrame, idle_minutes: float = 20.0) -> DataFrame:
    return described(walked(events, idle_minutes))


def preempt_detail(tables: Tables) -> DataFrame:
    return detail_of(tables.between(*range(102, 112)))
