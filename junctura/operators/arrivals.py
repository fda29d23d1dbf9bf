"""Arrivals measured against the state of the phase they serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, SECOND, along, bin_of, bin_of_hour, cycle, following, last, overlap, previous, seconds, share, timestamp
from junctura.functions.vocabulary import GREEN, OFF, ON, PHASE_END, RED, YELLOW
from junctura.sources.derived import Tables

PHASE = ["signal_id", "phase"]


def approach_delay(tables: Tables, minutes: int = 15) -> DataFrame:
    """Time from the last green of the approach's phase to each arrival, by approach and bin."""
    rows = tables.stream((GREEN,)).withColumn("green", last(F.when(F.col("code") == GREEN, F.col("t")), along(PHASE)))
    hits = rows.where((F.col("code") == ON) & F.col("green").isNotNull()).withColumn("bin", bin_of(F.col("t"), minutes * MINUTE))
    return hits.groupBy("signal_id", "approach_id", "bin").agg((seconds(F.sum(F.col("t") - F.col("green"))) / F.count("*")).alias("avg_delay_seconds"), F.count("*").alias("volume")).select("signal_id", "approach_id", timestamp(F.col("bin")).alias("period"), "avg_delay_seconds", "volume")


def arrival_on_red(tables: Tables, minutes: int = 15, yellow_as_red: bool = True, include_permissive: bool = False) -> DataFrame:
    """Arrivals while the phase is not green; ``include_permissive`` takes detectors whose approach has a permissive phase only."""
    tables = tables.with_permissive() if include_permissive else tables
    ends = (YELLOW, RED) if yellow_as_red else (RED,)
    state = last(F.when(F.col("code") == GREEN, 0).when(F.col("code").isin(*ends), 1), along(PHASE))
    hits = tables.stream((GREEN, YELLOW, RED)).withColumn("red", F.coalesce(state, F.lit(1))).where(F.col("code") == ON)
    binned = hits.groupBy("signal_id", bin_of_hour(F.col("t"), minutes).alias("bin"), "phase").agg(F.count("*").alias("total_detections"), F.sum("red").alias("arrivals_on_red"))
    whole = Window.partitionBy("signal_id")
    binned = binned.withColumn("total_detector_hits", F.sum("total_detections").over(whole)).withColumn("total_arrival_on_red", F.sum("arrivals_on_red").over(whole))
    return binned.select(
        "signal_id", timestamp(F.col("bin")).alias("bin_start"), F.col("phase").alias("phase_number"), "total_detections", "arrivals_on_red",
        share(F.col("arrivals_on_red"), F.col("total_detections")).alias("pct_arrivals_on_red"),
        (F.col("total_detections") * (60.0 / minutes)).alias("total_vehicles_per_hour"), (F.col("arrivals_on_red") * (60.0 / minutes)).alias("arrivals_on_red_per_hour"),
        "total_detector_hits", "total_arrival_on_red", share(F.col("total_arrival_on_red"), F.col("total_detector_hits")).alias("pct_arrival_on_red_overall"),
    )


def arrivals_on_green(tables: Tables) -> DataFrame:
    """Green until yellow; phases without arrivals have zero rows."""
    state = last(F.when(F.col("code") == GREEN, 1).when(F.col("code") == YELLOW, 0), along(PHASE))
    hits = tables.stream((GREEN, YELLOW)).withColumn("green", F.coalesce(state, F.lit(0))).where(F.col("code") == ON)
    counts = hits.groupBy(*PHASE).agg(F.count("*").alias("n"), F.sum("green").alias("g"))
    phases = tables.approaches.select(*PHASE).distinct()
    n, g = F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0))
    return phases.join(counts, PHASE, "left").select("signal_id", F.col("phase").alias("phase_number"), n.alias("total_arrivals"), g.alias("arrivals_on_green"), share(g, n).alias("aog_percentage"))


def _cycles(tables: Tables, codes: tuple[int, ...], detector_codes: tuple[int, ...] = (ON,)) -> DataFrame:
    """The stream with `cycle` (counted by greens) and `green`, the start of the row's cycle; rows before the first green go."""
    w = along(PHASE)
    rows = tables.stream(codes, detector_codes).withColumn("cycle", cycle(F.col("code") == GREEN, w)).where("cycle > 0")
    return rows.withColumn("green", last(F.when(F.col("code") == GREEN, F.col("t")), w))


def yellow_red_actuations(tables: Tables) -> DataFrame:
    """Arrivals of each cycle, the last one too, by the furthest state it has reached."""
    w = along([*PHASE, "cycle"])
    reached = F.max(F.when(F.col("code").isin(RED, PHASE_END), 2).when(F.col("code") == YELLOW, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = _cycles(tables, (GREEN, YELLOW, RED, PHASE_END)).withColumn("state", reached)
    hits = lambda s: F.count(F.when((F.col("code") == ON) & (F.col("state") == s), 1))
    out = rows.groupBy(*PHASE, "cycle").agg(F.min("green").alias("green"), hits(0).alias("green_actuations"), hits(1).alias("yellow_actuations"), hits(2).alias("red_actuations"))
    return out.select("signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("green")).alias("cycle_start"), "green_actuations", "yellow_actuations", "red_actuations", (F.col("green_actuations") + F.col("yellow_actuations") + F.col("red_actuations")).alias("total_actuations"))


def red_light_monitor(tables: Tables, grace: float = 2.0) -> DataFrame:
    """Arrivals after the start of red clearance and, once the phase has ended, at most ``grace`` seconds after that."""
    w = along([*PHASE, "cycle"])
    rows = _cycles(tables, (GREEN, RED, PHASE_END)).withColumn("red", last(F.when(F.col("code") == RED, F.col("t")), w)).withColumn("ended", last(F.when(F.col("code") == PHASE_END, F.col("t")), w))
    hit = (F.col("code") == ON) & F.col("red").isNotNull() & (F.col("ended").isNull() | (F.col("t") <= F.col("ended") + int(grace * SECOND)))
    out = rows.groupBy(*PHASE, "cycle").agg(F.min("green").alias("green"), F.max("red").alias("red"), F.array_sort(F.collect_list(F.when(hit, F.date_format(timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS")))).alias("violations"))
    return out.where(F.size("violations") > 0).select("signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("green")).alias("cycle_start"), timestamp(F.col("red")).alias("red_clearance_start"), "violations", F.size("violations").cast("long").alias("violation_count"))


def wait_time(tables: Tables) -> DataFrame:
    """Waits of arrivals between a phase's end and its next green; a row for each green that follows an end."""
    w = along(PHASE)
    rows = tables.stream((GREEN, PHASE_END)).withColumn("before", previous(F.when(F.col("code").isin(GREEN, PHASE_END), F.col("code")), w)).withColumn("ended", last(F.when(F.col("code") == PHASE_END, F.col("t")), w))
    rows = rows.withColumn("next", F.when(F.col("code") == GREEN, F.col("t")).otherwise(following(F.when(F.col("code") == GREEN, F.col("t")), PHASE))).where((F.col("before") == PHASE_END) & F.col("next").isNotNull())
    final = F.max("ended").over(along([*PHASE, "next"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("final", final)
    wait = F.when((F.col("code") == ON) & (F.col("ended") == F.col("final")), F.col("next") - F.col("t"))
    zero = lambda c: F.coalesce(seconds(c), F.lit(0.0))
    out = rows.groupBy(*PHASE, "next").agg(F.count(F.when(F.col("code") == GREEN, 1)).alias("greens"), F.count(wait).alias("n"), zero(F.sum(wait) / F.count(wait)).alias("avg_wait_time"), zero(F.max(wait)).alias("max_wait_time"), zero(F.min(wait)).alias("min_wait_time"))
    return out.where("greens > 0").select("signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("next")).alias("cycle_start"), F.col("n").alias("arrivals_during_red"), "avg_wait_time", "max_wait_time", "min_wait_time")


def split_failure(tables: Tables, seconds_window: int = 5, green_threshold: float = 0.79, red_threshold: float = 0.79) -> DataFrame:
    """Cycles (green to next green, with a yellow) whose detectors stay occupied at the start of green and of red.

    The last yellow, red and phase end of the cycle count; red starts at its red, else phase end, else
    yellow. Occupancy looks at the detector events of the cycle itself.
    """
    w = along([*PHASE, "cycle"])
    width = seconds_window * SECOND
    # Events of one phase at one instant: ON before OFF would hide a turn, so the order of codes serves.
    rows = _cycles(tables, (GREEN, YELLOW, RED, PHASE_END), (ON, OFF))
    of = lambda code: F.max(F.when(F.col("code") == code, F.col("t")))
    cycles = rows.groupBy(*PHASE, "cycle").agg(F.min("green").alias("green"), of(YELLOW).alias("yellow"), of(RED).alias("red"), of(PHASE_END).alias("ended"))
    cycles = cycles.withColumn("next", F.lead("green").over(along(PHASE, ("cycle",)))).where(F.col("yellow").isNotNull() & F.col("next").isNotNull()).withColumn("red_from", F.coalesce("red", "ended", "yellow"))
    turns = rows.where(F.col("code").isin(ON, OFF)).withColumn("was", F.coalesce(F.lag("code").over(w), F.lit(OFF))).where(F.col("code") != F.col("was"))
    on = turns.withColumn("finish", F.lead("t").over(w)).where(F.col("code") == ON).select(*PHASE, "cycle", F.col("t").alias("begin"), "finish")
    met = cycles.join(on, [*PHASE, "cycle"], "left")
    inside = lambda at: F.coalesce(F.sum(F.when(F.col("begin").isNotNull(), overlap(F.col("begin"), F.coalesce("finish", F.col(at) + width), F.col(at), F.col(at) + width))), F.lit(0))
    out = met.groupBy(*PHASE, "cycle").agg(F.min("green").alias("green"), F.min("yellow").alias("yellow"), F.min("next").alias("next"), *(F.least(inside(a) / F.lit(float(width)), F.lit(1.0)).alias(n) for a, n in (("green", "green_start_occupancy"), ("red_from", "red_start_occupancy"))))
    return out.select("signal_id", F.col("phase").alias("phase_number"), timestamp(F.col("green")).alias("cycle_start"), "green_start_occupancy", "red_start_occupancy", seconds(F.col("yellow") - F.col("green")).alias("green_duration"), seconds(F.col("next") - F.col("green")).alias("cycle_length"), ((F.col("green_start_occupancy") >= green_threshold) & (F.col("red_start_occupancy") >= red_threshold)).alias("is_split_failure"))
