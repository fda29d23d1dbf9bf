"""A corridor's usual cycle, from the same hours of several days."""

from __future__ import annotations

from datetime import date, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, SECOND, along, asof_backward, last, timestamp
from junctura.functions.vocabulary import GREEN, RED, YELLOW
from junctura.sources.derived import DAY, DayTables, Tables

_EPOCH = date(1970, 1, 1)
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
_STATES = (("green", "0L"), ("yellow", "green"), ("red", "green + yellow"))


def _day(text: str) -> int:
    return (date.fromisoformat(text) - _EPOCH).days


def _clock(text: str) -> int:
    at = time.fromisoformat(text)
    return (at.hour * 60 + at.minute) * MINUTE


def _on(days_of_week: tuple[int, ...]) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return ((F.col("day") + 3) % 7).isin(*days_of_week)


def plans_by_day(tables: Tables, holders: DataFrame, first: int, final: int, days_of_week: tuple[int, ...], clock: int, unequal: str) -> DataFrame:
    """holder, day, cycle_length, offset_seconds, splits: the days whose plan equals that of the first, with the first day's values.

    A day's plan is the one in force at ``clock``; cycle length, offset and all splits make its print. Where the first day has none,
    every day is kept. A day with another plan, or none, fails the job with all such days in the message, or is left out (``unequal`` "drop").
    """
    asks = holders.select("signal_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(final).cast("long"))).alias("day")).where(_on(days_of_week))
    asks = asks.withColumn("t", F.col("day") * DAY + clock)
    found = asof_backward(asks, tables.plans.withColumnRenamed("begin", "t"), ["signal_id"], ["finish", "cycle_length", "offset_seconds", "splits"])
    entries = F.coalesce(F.array_sort(F.map_entries("splits")), F.expr("array()"))
    in_force = F.col("cycle_length").isNotNull() & (F.col("finish").isNull() | (F.col("finish") > F.col("t")))
    found = found.withColumn("print", F.when(in_force, F.to_json(F.struct("cycle_length", "offset_seconds", entries.alias("splits")))))
    whole = Window.partitionBy("signal_id").orderBy("day").rowsBetween(*_WHOLE)
    found = found.withColumn("of", F.first(F.struct("print", "cycle_length", "offset_seconds", "splits")).over(whole))
    same = F.col("of.print").isNull() | F.coalesce(F.col("print") == F.col("of.print"), F.lit(False))
    if unequal == "refuse":
        named = F.array_join(F.collect_list(F.when(~same, F.date_format(F.date_add(F.lit(_EPOCH), F.col("day").cast("int")), "yyyy-MM-dd"))).over(whole), ", ")
        found = found.withColumn("named", named)
        message = F.concat(F.lit("the plan of "), F.col("signal_id"), F.lit(" differs from the first day's on "), F.col("named"))
        found = found.where(F.when(F.col("named") == "", True).otherwise(F.raise_error(message).cast("boolean")))
    else:
        found = found.where(same)
    kept = F.col("of.print").isNotNull()
    value = lambda name: F.when(kept, F.col("of")[name]).alias(name)
    return found.select(F.col("signal_id").alias("holder"), "day", value("cycle_length"), value("offset_seconds"), value("splits"))


def cycles_of_days(rows: DataFrame) -> DataFrame:
    """signal_id, phase, day, start, green, yellow, red of rows (signal_id, phase, day, t, code, param).

    A cycle lasts from a green to the next of its day; its first yellow and first red lie strictly inside, and all three parts are above 0.
    """
    keys = ["signal_id", "phase", "day"]
    rows = rows.withColumn("start", last(F.when(F.col("code") == GREEN, F.col("t")), along(keys))).where("start is not null")
    first = lambda code: F.min(F.when((F.col("code") == code) & (F.col("t") > F.col("start")), F.col("t")))
    met = rows.groupBy(*keys, "start").agg(first(YELLOW).alias("y"), first(RED).alias("r"))
    met = met.withColumn("next", F.lead("start").over(along(keys, ("start",))))
    return met.select(*keys, "start", (F.col("y") - F.col("start")).alias("green"), (F.col("r") - F.col("y")).alias("yellow"), (F.col("next") - F.col("r")).alias("red")).where("green > 0 and yellow > 0 and red > 0")


def time_space_average_days(
    tables: Tables, start_date: str = "", end_date: str = "", days_of_week: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6), start_time: str = "07:00", end_time: str = "09:00",
    unequal: str = "refuse", own_plans: bool = False, speed: float = 30.0, spacing_feet: float = 1000.0,
) -> DataFrame:
    """The cycle of median green over the same hours of several days, laid out from the plan's offset over the first day's hours.

    Days run from ``start_date`` to ``end_date`` (those of the window, if not given), weekdays with Monday 0. All must run the plan
    of the first (``plans_by_day``): that of the route's first signal, or each signal its own with ``own_plans``. Cycles do not cross days; the
    median is the middle element by green, then time. The reference point offset - (green + yellow - split) is stepped back by whole
    cycles to the hours' start; cycles, at least as long as the plan's, are repeated to two minutes past their end. Hours
    that end before they start, and days without cycles, give no rows. One row for each start of a green, yellow and red.
    """
    if unequal not in ("refuse", "drop"):
        raise ValueError("unequal must be refuse or drop")
    first = _day(start_date) if start_date else tables.start // DAY
    final = _day(end_date) if end_date else tables.end // DAY
    begin, finish = _clock(start_time), _clock(end_time)
    at = next((d for d in range(first, final + 1) if (d + 3) % 7 in days_of_week), None)
    if at is None:
        at, final = first, first
    seen = tables.over(first * DAY, (final + 1) * DAY - 1)
    anchor, end = at * DAY + begin, at * DAY + finish + 2 * MINUTE

    holder = F.col("signal_id") if own_plans else F.first("signal_id").over(Window.orderBy("place", "signal_id").rowsBetween(*_WHOLE))  # a route is a short list
    route = seen.route.select("signal_id", "place", "phase", holder.alias("holder"))
    plans = plans_by_day(seen, route.select(F.col("holder").alias("signal_id")).distinct(), first, final, days_of_week, begin, unequal)

    log = seen.phase_events(GREEN, YELLOW, RED, start=first * DAY + begin, end=final * DAY + finish)
    log = log.withColumn("day", F.expr(f"t div {DAY}")).where((F.col("t") - F.col("day") * DAY).between(begin, finish) & _on(days_of_week))
    met = log.join(route.select("signal_id", "phase", "holder"), ["signal_id", "phase"]).join(plans.select("holder", "day"), ["holder", "day"])
    cycles = cycles_of_days(met.select("signal_id", "phase", "day", "t", "code", F.lit(0).alias("param")))

    opens = F.lag("start").over(along(["signal_id", "phase", "day"], ("start",))).isNull().cast("int")
    order = along(["signal_id", "phase"], ("green", "start"))
    placed = cycles.withColumn("opens", opens).withColumn("k", F.row_number().over(order) - 1)
    placed = placed.withColumn("n", F.count("*").over(order.rowsBetween(*_WHOLE))).withColumn("days_included", F.sum("opens").over(order.rowsBetween(*_WHOLE)))
    middle = placed.where("k = n div 2").select("signal_id", "phase", "green", "yellow", "red", "days_included")

    plan = plans.groupBy("holder").agg(F.first(F.struct("cycle_length", "offset_seconds", "splits")).alias("p"))
    laid = middle.join(route, ["signal_id", "phase"]).join(plan, "holder")
    laid = laid.withColumn("split", F.coalesce(F.try_element_at("p.splits", F.col("phase")), F.lit(0)).cast("double"))
    laid = laid.withColumn("length", F.greatest(F.coalesce(F.col("p.cycle_length"), F.lit(0)).cast("long") * SECOND, F.col("green") + F.col("yellow") + F.col("red")))
    laid = laid.withColumn("ref", F.coalesce(F.col("p.offset_seconds"), F.lit(0)).cast("long") * SECOND - (F.col("green") + F.col("yellow") - (F.col("split") * SECOND).cast("long")))
    laid = laid.withColumn("ref", F.expr(f"{anchor}L + ref - if(ref > 0, (ref + length - 1) div length, 0L) * length"))
    laid = laid.withColumn("cycle_index", F.explode(F.expr(f"sequence(0L, ({end}L - ref) div length)")))
    states = ", ".join(f"named_struct('event', '{name}', 'after', {after})" for name, after in _STATES)
    laid = laid.withColumn("state", F.explode(F.expr(f"array({states})")))
    thousandths = lambda t: F.expr(f"({t} + 500) div 1000") / F.lit(1000.0)
    return laid.select(
        "signal_id", F.col("phase").alias("phase_number"), "cycle_index", "state.event", timestamp(F.expr("ref + cycle_index * length + state.after")).alias("event_time"),
        (F.col("place") * spacing_feet).alias("distance_ft"), thousandths("length").alias("cycle_length_seconds"), thousandths("green").alias("median_green_seconds"),
        thousandths("yellow").alias("median_yellow_seconds"), thousandths("red").alias("median_red_seconds"), F.col("split").alias("programmed_split_seconds"),
        "days_included", F.lit(speed).alias("speed_limit_applied"),
    )


def time_space_average_week(tables: Tables) -> DataFrame:
    """The log dealt out over a week; its working days with the plan of the Monday."""
    week = DayTables(tables.spark, tables.folder).over(signals=tables.chosen)
    return time_space_average_days(week, days_of_week=(0, 1, 2, 3, 4), start_time="02:00", end_time="11:30", unequal="drop")
