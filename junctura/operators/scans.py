"""Reads of the stored cycle tables, and reports from them instead of the log.

Windows are half open: a row at their end belongs to the next one, so that windows can be put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, share, timestamp
from junctura.operators import aggregates
from junctura.sources.derived import Tables

HOUR = 60 * MINUTE


def _within(rows: DataFrame, column: str, start: int, end: int) -> DataFrame:
    return rows.where((F.col(column) >= timestamp(F.lit(start))) & (F.col(column) < timestamp(F.lit(end))))


def boundaries_between(cycle_boundary: DataFrame, start: int, end: int) -> DataFrame:
    """Cycles whose green starts in [start, end)."""
    return _within(cycle_boundary, "green_start", start, end)


def arrivals_between(cycle_detector_arrival: DataFrame, start: int, end: int, channels: tuple[int, ...] = ()) -> DataFrame:
    """Arrivals in [start, end), of some channels if given."""
    rows = _within(cycle_detector_arrival, "arrival_time", start, end)
    return rows.where(F.col("channel").isin(*channels)) if channels else rows


def summaries_between(cycle_summary: DataFrame, start: int, end: int) -> DataFrame:
    """Quarter hours that begin in [start, end)."""
    return _within(cycle_summary, "bin_start", start, end)


def purdue_from_cycles(cycle_boundary: DataFrame, start: int, end: int) -> DataFrame:
    """The Purdue diagram's rows, each of a stored cycle."""
    rows = boundaries_between(cycle_boundary, start, end)
    return rows.select(
        "signal_id", F.col("phase").alias("phase_number"), "green_start", "yellow_start", "red_start", "cycle_end", F.col("green_duration_seconds").alias("green_duration"),
        F.col("yellow_duration_seconds").alias("yellow_duration"), F.col("red_duration_seconds").alias("red_duration"), F.col("cycle_duration_seconds").alias("cycle_duration"), "termination_type",
    )


def arrivals_on_green_from_summaries(cycle_summary: DataFrame, start: int, end: int) -> DataFrame:
    """Arrivals on green by phase: sums of stored sums."""
    rows = summaries_between(cycle_summary, start, end).groupBy("signal_id", F.col("phase").alias("phase_number"))
    out = rows.agg(F.sum("total_arrivals").alias("total_arrivals"), F.sum("arrivals_on_green").alias("arrivals_on_green"))
    return out.withColumn("aog_percentage", share(F.col("arrivals_on_green"), F.col("total_arrivals")))


def terminations_from_cycles(cycle_boundary: DataFrame, start: int, end: int, minutes: int = 15) -> DataFrame:
    """Counts of terminations of stored cycles by bin of their green; stored cycles know no skips."""
    rows = boundaries_between(cycle_boundary, start, end)
    width = minutes * MINUTE
    bin_start = timestamp(F.floor(F.unix_micros(F.col("green_start").cast("timestamp")) / width) * width)
    of = lambda kind: F.count(F.when(F.col("termination_type") == kind, 1))
    out = rows.groupBy("signal_id", F.col("phase").alias("phase_number"), bin_start.alias("bin_start"))
    return out.agg(of("gap_out").alias("gap_out_count"), of("max_out").alias("max_out_count"), of("force_off").alias("force_off_count"), F.count("*").alias("total_cycles"))


def cycle_boundary(tables: Tables) -> DataFrame:
    """The cycles of the second to fifth hour."""
    return boundaries_between(aggregates.cycle_boundary(tables), tables.start + HOUR, tables.start + 5 * HOUR)


def cycle_arrival(tables: Tables) -> DataFrame:
    """Arrivals of the second to fifth hour at channels 1 and 5."""
    return arrivals_between(aggregates.cycle_detector_arrival(tables), tables.start + HOUR, tables.start + 5 * HOUR, (1, 5))


def cycle_summary(tables: Tables) -> DataFrame:
    """The quarter hours of the second to fifth hour."""
    return summaries_between(aggregates.cycle_summary_15min(tables), tables.start + HOUR, tables.start + 5 * HOUR)


def purdue_diagram(tables: Tables) -> DataFrame:
    return purdue_from_cycles(aggregates.cycle_boundary(tables), tables.start, tables.end)


def arrivals_on_green(tables: Tables) -> DataFrame:
    return arrivals_on_green_from_summaries(aggregates.cycle_summary_15min(tables), tables.start, tables.end)


def phase_termination(tables: Tables) -> DataFrame:
    return terminations_from_cycles(aggregates.cycle_boundary(tables), tables.start, tables.end)


ALL = (cycle_boundary, cycle_arrival, cycle_summary, purdue_diagram, arrivals_on_green, phase_termination)
