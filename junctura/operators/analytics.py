"""Analytics of detectors, phases, coordination, preemption and health, over every signal at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, SECOND, along, last, seconds, settled, share, split_over_bins, timestamp
from junctura.functions.vocabulary import FORCE_OFF, GAP_OUT, GREEN, MAX_OUT, OFF, ON, PATTERN, PREEMPT_CALL, PREEMPT_OFF, RED, YELLOW
from junctura.operators.volumes import occupied_intervals
from junctura.sources.derived import Tables

CHANNEL = ["signal_id", "channel"]
PHASE = ["signal_id", "phase"]


def _n(cond):
    return F.count(F.when(cond, 1))


def _detector_rows(tables: Tables) -> DataFrame:
    return tables.between(ON, OFF).withColumn("channel", F.col("param"))


def detectors_stuck(tables: Tables, minutes: float = 30.0) -> DataFrame:
    """Channels whose last ON came after their last OFF (or that have no OFF), ``minutes`` or more before the end."""
    at = lambda c: F.max(F.when(F.col("code") == c, F.col("t")))
    rows = _detector_rows(tables).groupBy(*CHANNEL).agg(at(ON).alias("on"), at(OFF).alias("off"), _n(F.col("code") == ON).alias("event_count"))
    held = F.lit(tables.end) - F.col("on")
    return rows.where((F.col("off").isNull() | (F.col("on") > F.col("off"))) & (held >= int(minutes * MINUTE))).select(*CHANNEL, timestamp(F.col("on")).alias("last_on"), seconds(held).alias("stuck_seconds"), "event_count")


def detectors_gaps(tables: Tables) -> DataFrame:
    rows = _detector_rows(tables).where(F.col("code") == ON).withColumn("gap", F.col("t") - F.lag("t").over(along(CHANNEL, ("t",))))
    out = rows.groupBy(*CHANNEL).agg(F.count("*").alias("event_count"), (seconds(F.sum("gap")) / F.nullif(F.count("gap"), F.lit(0))).alias("avg_gap_seconds"), seconds(F.min("gap")).alias("min_gap_seconds"), seconds(F.max("gap")).alias("max_gap_seconds"))
    return out.where("event_count >= 2")


def detectors_occupancy(tables: Tables, minutes: int = 15) -> DataFrame:
    """Share of each bin (from the window's start) that a detector is on; bins without any time on have 0."""
    on = occupied_intervals(_detector_rows(tables).drop("param").withColumn("param", F.lit(0)), CHANNEL, tables.end)
    width = minutes * MINUTE
    held = split_over_bins(on, "begin", "finish", F.lit(tables.start), width).groupBy(*CHANNEL, "bin").agg(F.sum("inside").alias("inside"))
    grid = _detector_rows(tables).select(*CHANNEL).distinct().withColumn("bin", F.explode(F.sequence(F.lit(tables.start), F.lit(tables.end - 1), F.lit(width))))
    size = F.least(F.lit(width), F.lit(tables.end) - F.col("bin"))
    return grid.join(held, [*CHANNEL, "bin"], "left").select(*CHANNEL, timestamp(F.col("bin")).alias("bin_start"), timestamp(F.col("bin") + size).alias("bin_end"), (F.coalesce("inside", F.lit(0)) * 100.0 / size).alias("occupancy_pct"))


def phases_skipped(tables: Tables) -> DataFrame:
    greens = tables.phase_events(GREEN).groupBy(*PHASE).agg(F.count("*").alias("actual_cycles"))
    most = F.max("actual_cycles").over(Window.partitionBy("signal_id"))
    rows = greens.withColumn("expected_cycles", most)
    return rows.select(*PHASE, "expected_cycles", "actual_cycles", ((F.col("expected_cycles") - F.col("actual_cycles")) * 100.0 / F.col("expected_cycles")).alias("skip_rate_pct"))


def phases_split_monitor(tables: Tables) -> DataFrame:
    """Greens run until yellow, yellows until red; shares are of all terminations; phases without greens are left out."""
    w = along(PHASE)
    rows = tables.phase_events(GREEN, GAP_OUT, MAX_OUT, FORCE_OFF, YELLOW, RED).withColumn("param", F.lit(0))
    rows = rows.withColumn("green", last(F.when(F.col("code") == GREEN, F.col("t")), w)).withColumn("yellow", last(F.when(F.col("code") == YELLOW, F.col("t")), w))
    greens = rows.where((F.col("code") == YELLOW) & F.col("green").isNotNull()).groupBy(*PHASE, "green").agg(F.min("t").alias("end")).groupBy(*PHASE).agg((seconds(F.sum(F.col("end") - F.col("green"))) / F.count("*")).alias("g"))
    yellows = rows.where((F.col("code") == RED) & F.col("yellow").isNotNull()).groupBy(*PHASE, "yellow").agg(F.min("t").alias("end")).groupBy(*PHASE).agg((seconds(F.sum(F.col("end") - F.col("yellow"))) / F.count("*")).alias("y"))
    of = lambda c: _n(F.col("code") == c)
    counts = rows.groupBy(*PHASE).agg(of(GREEN).alias("cycle_count"), of(GAP_OUT).alias("gap"), of(MAX_OUT).alias("max"), of(FORCE_OFF).alias("force")).where("cycle_count > 0").withColumn("ends", F.col("gap") + F.col("max") + F.col("force"))
    out = counts.join(greens, PHASE, "left").join(yellows, PHASE, "left")
    pct = lambda c: share(F.col(c), F.col("ends"))
    return out.select(*PHASE, "cycle_count", F.coalesce("g", F.lit(0.0)).alias("avg_green_seconds"), F.coalesce("y", F.lit(0.0)).alias("avg_yellow_seconds"), pct("gap").alias("gap_out_pct"), pct("max").alias("max_out_pct"), pct("force").alias("force_off_pct"))


def phases_terminations(tables: Tables) -> DataFrame:
    of = lambda c: _n(F.col("code") == c)
    return tables.phase_events(GREEN, GAP_OUT, MAX_OUT, FORCE_OFF).groupBy(*PHASE).agg(of(GREEN).alias("total_cycles"), of(GAP_OUT).alias("gap_outs"), of(MAX_OUT).alias("max_outs"), of(FORCE_OFF).alias("force_offs"))


def _drifts(tables: Tables) -> DataFrame:
    """Cycle lengths of the coordinated phase and their distance from the signal's mean."""
    greens = tables.phase_events(GREEN).where("phase = 2").withColumn("length", seconds(F.col("t") - F.lag("t").over(along(["signal_id"], ("t",))))).where("length is not null")
    return greens.withColumn("mean", settled(F.avg("length").over(Window.partitionBy("signal_id")))).withColumn("drift", F.abs(F.col("length") - F.col("mean")))


def coordination_offset_drift(tables: Tables) -> DataFrame:
    return _drifts(tables).groupBy("signal_id").agg(F.max("mean").alias("expected_cycle_seconds"), F.count("*").alias("cycle_count"), settled(F.avg("drift")).alias("avg_drift_seconds"), settled(F.max("drift")).alias("max_drift_seconds"), settled(F.stddev_pop("drift")).alias("drift_stddev"))


def coordination_patterns(tables: Tables) -> DataFrame:
    w = along(["signal_id"])
    rows = tables.between(PATTERN)
    return rows.select("signal_id", timestamp(F.col("t")).alias("event_time"), F.lag("param", 1, 0).over(w).alias("from_pattern"), F.col("param").alias("to_pattern"), seconds(F.lead("t").over(w) - F.col("t")).alias("duration_seconds"))


def coordination_quality(tables: Tables, tolerance: float = 2.0) -> DataFrame:
    good = _n(F.col("drift") <= tolerance)
    return _drifts(tables).groupBy("signal_id").agg(F.count("*").alias("total_cycles"), good.alias("cycles_within_tolerance"), (good * 100.0 / F.count("*")).alias("quality_pct"), F.max("mean").alias("avg_cycle_seconds"), settled(F.avg("drift")).alias("avg_offset_error"))


def preemptions_summary(tables: Tables) -> DataFrame:
    w = along(["signal_id", "param"], ("t", "code"))
    rows = tables.between(PREEMPT_CALL, PREEMPT_OFF).withColumn("pc", F.lag("code").over(w)).withColumn("b", F.lag("t").over(w)).where((F.col("code") == PREEMPT_OFF) & (F.col("pc") == PREEMPT_CALL)).withColumn("d", F.col("t") - F.col("b"))
    per = rows.groupBy("signal_id", "param").agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.max("d").alias("m"))
    out = per.groupBy("signal_id").agg(F.sum("n").alias("total_preemptions"), F.sum("d").alias("d"), F.max("m").alias("m"), F.array_sort(F.collect_list(F.concat_ws("=", F.col("param").cast("string"), F.col("n").cast("string")))).alias("by_preempt_number"))
    return out.select("signal_id", "total_preemptions", (seconds(F.col("d")) / F.col("total_preemptions")).alias("avg_duration_seconds"), seconds(F.col("m")).alias("max_duration_seconds"), seconds(F.col("d")).alias("total_preempt_time_seconds"), F.array_join("by_preempt_number", ",").alias("by_preempt_number"), (F.col("d") * 100.0 / (tables.end - tables.start)).alias("pct_time_preempted"))


def preemptions_recovery(tables: Tables) -> DataFrame:
    """From the latest preempt end to the next green of phase 2, one row for each such green."""
    rows = tables.between(PREEMPT_OFF, GREEN).where((F.col("code") == PREEMPT_OFF) | (F.col("param") == 2))
    w = along(["signal_id"])
    back = rows.withColumn("pc", F.lag("code").over(w)).withColumn("b", F.lag("t").over(w)).where((F.col("code") == GREEN) & (F.col("pc") == PREEMPT_OFF))
    return back.select("signal_id", timestamp(F.col("b")).alias("preempt_end_time"), timestamp(F.col("t")).alias("recovery_complete_time"), seconds(F.col("t") - F.col("b")).alias("recovery_seconds"))


def _grade(score):
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 50, "Fair").otherwise("Poor")


def health_detector(tables: Tables) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("code") == c, F.col("t")))
    rows = _detector_rows(tables).groupBy(*CHANNEL).agg(_n(F.col("code") == ON).alias("on"), _n(F.col("code") == OFF).alias("off"), at(ON).alias("last_on"), at(OFF).alias("last_off"))
    on, off = F.col("on"), F.col("off")
    stuck = F.when(F.col("last_on").isNotNull() & F.col("last_off").isNull(), -30).when((F.col("last_on") > F.col("last_off")) & (F.lit(tables.end) - F.col("last_on") > 1800 * SECOND), -30).otherwise(0)
    chatter = F.when(on / tables.hours > 2000, -20).when(on / tables.hours > 1000, -10).otherwise(0)
    activity = F.when(on < tables.hours, -15).otherwise(0)
    balance = F.when((on > 0) & (off == 0), -20).when((on > 0) & ((on * 1.0 / off > 1.5) | (on * 1.0 / off < 0.67)), -10).otherwise(0)
    parts = rows.select(*CHANNEL, stuck.alias("stuck_penalty"), chatter.alias("chatter_penalty"), activity.alias("activity_penalty"), balance.alias("balance_penalty"))
    score = F.greatest(F.lit(0), 100 + F.col("stuck_penalty") + F.col("chatter_penalty") + F.col("activity_penalty") + F.col("balance_penalty"))
    return parts.withColumn("score", score).withColumn("grade", _grade(F.col("score"))).withColumn("status", F.when(F.col("score") >= 50, "HEALTHY").otherwise("DEGRADED"))


def health_signal(tables: Tables) -> DataFrame:
    """Weighted detector (0.35), phase (0.25), coordination (0.2) and communication (0.2) scores."""
    det = _detector_rows(tables).groupBy(*CHANNEL).agg(_n(F.col("code") == ON).alias("on"), _n(F.col("code") == OFF).alias("off"))
    loss = F.when((F.col("on") > 0) & (F.col("off") == 0), 15).otherwise(0) + F.when(F.col("on") / tables.hours > 2000, 10).otherwise(0)
    det = det.groupBy("signal_id").agg(F.greatest(F.lit(0), 100 - F.sum(loss)).alias("detector_health"))
    skipped = phases_skipped(tables).groupBy("signal_id").agg(F.greatest(F.lit(0), 100 - 10 * _n(F.col("skip_rate_pct") > 10)).alias("phase_health"))
    far = _drifts(tables).groupBy("signal_id").agg((_n(F.col("drift") > 5) * 1.0 / F.count("*")).alias("rate"))
    far = far.select("signal_id", F.when(F.col("rate") > 0.2, 80).when(F.col("rate") > 0.1, 90).otherwise(100).alias("coordination_health"))
    comm = tables.between().groupBy("signal_id").agg(F.when(F.count("*") / tables.hours < 10, 50).otherwise(100).alias("communication_health"))
    out = comm.join(det, "signal_id", "left").join(skipped, "signal_id", "left").join(far, "signal_id", "left")
    names = ("detector_health", "phase_health", "coordination_health", "communication_health")
    out = out.select("signal_id", *(F.coalesce(n, F.lit(100)).cast("long").alias(n) for n in names))
    score = sum((F.col(n) * w for n, w in zip(names[1:], (0.25, 0.2, 0.2), strict=True)), F.col(names[0]) * 0.35)
    return out.withColumn("overall_score", score).withColumn("overall_grade", _grade(F.col("overall_score")))


ALL = (
    detectors_stuck, detectors_gaps, detectors_occupancy, phases_skipped, phases_split_monitor, phases_terminations, coordination_offset_drift,
    coordination_patterns, coordination_quality, preemptions_summary, preemptions_recovery, health_detector, health_signal,
)
