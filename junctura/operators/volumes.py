"""Counts and speeds at detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, SECOND, along, bin_of_hour, following, overlap, seconds, settled, timestamp
from junctura.functions.vocabulary import GREEN, OFF, ON, YELLOW, named
from junctura.sources.derived import Tables


def approach_volume(tables: Tables, minutes: int = 15) -> DataFrame:
    hits = tables.arrivals().withColumn("bin", bin_of_hour(F.col("t"), minutes))
    return hits.groupBy("signal_id", "approach_id", "direction", "bin").agg(F.count("*").alias("volume")).select("signal_id", "approach_id", "direction", timestamp(F.col("bin")).alias("bin_start"), "volume")


def turning_movement_counts(tables: Tables, minutes: int = 15) -> DataFrame:
    """Counts by approach and bin; despite its name the report does not tell movements apart."""
    return approach_volume(tables, minutes)


def bike_volume(tables: Tables, channels: tuple[int, ...] = (1, 5), minutes: int = 15) -> DataFrame:
    hits = tables.between(ON).where(F.col("param").isin(*channels)).withColumn("bin", bin_of_hour(F.col("t"), minutes))
    return hits.groupBy("signal_id", "bin", F.col("param").alias("channel")).agg(F.count("*").alias("volume")).select("signal_id", timestamp(F.col("bin")).alias("bin_start"), "channel", "volume")


def approach_speed(tables: Tables, slowest_limit: float = 150.0) -> DataFrame:
    """Speeds from the occupancy of detectors set back from the stop bar; percentiles by index int(n * p / 100)."""
    w = along(["signal_id", "channel"])
    rows = tables.arrivals(ON, OFF).where("distance > 0 and min_speed is not null").withColumn("param", F.col("channel"))
    paired = rows.withColumn("on_t", F.when((F.lag("code").over(w) == ON) & (F.col("code") == OFF), F.lag("t").over(w)))
    held = paired.where(F.col("on_t").isNotNull() & (F.col("t") > F.col("on_t")))
    mph = (F.col("distance") / seconds(F.col("t") - F.col("on_t"))) / F.lit(1.467)
    kept = held.withColumn("mph", mph).where((F.col("mph") >= F.col("min_speed")) & (F.col("mph") <= slowest_limit))
    by = along(["signal_id", "approach_id"], ("mph", "t", "channel"))
    placed = kept.withColumn("place", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pick = lambda p: F.max(F.when(F.col("place") == F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("mph")))
    out = placed.groupBy("signal_id", "approach_id", "direction").agg(settled(F.avg("mph")).alias("avg_speed"), pick(85).alias("p85_speed"), pick(15).alias("p15_speed"), F.count("*").alias("sample_count"))
    return out.join(tables.approaches.select("signal_id", "approach_id", F.col("mph").alias("speed_limit")), ["signal_id", "approach_id"], "left")


def timing_and_actuations(tables: Tables, phases: tuple[int, ...] | None = None) -> DataFrame:
    """Phase and detector events with names; the phase filter does not touch detector events."""
    rows = tables.between(1, 4, 5, 6, 7, 8, 9, 10, OFF, ON)
    if phases:
        rows = rows.where(F.col("code").isin(OFF, ON) | F.col("param").isin(*phases))
    return rows.select("signal_id", timestamp(F.col("t")).alias("event_time"), F.col("code").alias("event_code"), F.col("param").alias("event_param"), named(F.col("code")).alias("event_name"))


def ramp_metering(tables: Tables, demand: int = 1, passage: int = 2, queue: int = 3, meter_phase: int = 2, minutes: int = 15, longest: float = 60.0) -> DataFrame:
    """Metering rate, greens, demand and queue occupancy by bin; bins with anything at all."""
    hits = tables.between(ON).where(F.col("param").isin(demand, passage)).select("signal_id", bin_of_hour(F.col("t"), minutes).alias("bin"), F.when(F.col("param") == demand, 1).alias("demand"), F.when(F.col("param") == passage, 1).alias("passage"))
    phase = tables.phase_events(GREEN, YELLOW).where(F.col("phase") == meter_phase).withColumn("param", F.lit(0))
    ended = phase.withColumn("yellow", following(F.when(F.col("code") == YELLOW, F.col("t")), ["signal_id"]))
    greens = ended.where((F.col("code") == GREEN) & (F.col("yellow") - F.col("t") <= int(longest * SECOND)) & (F.col("yellow") > F.col("t")))
    greens = greens.select("signal_id", bin_of_hour(F.col("t"), minutes).alias("bin"), (F.col("yellow") - F.col("t")).alias("green"))
    occupied = queue_occupancy(tables.between(ON, OFF).where(F.col("param") == queue), minutes, tables.end)
    rows = hits.unionByName(greens, allowMissingColumns=True).unionByName(occupied, allowMissingColumns=True)
    out = rows.groupBy("signal_id", "bin").agg(F.count("demand").alias("demand_volume"), F.count("passage").alias("passage_volume"), F.coalesce(seconds(F.sum("green")) / F.count("green"), F.lit(0.0)).alias("avg_green_seconds"), F.sum("inside").alias("inside"))
    return out.select("signal_id", timestamp(F.col("bin")).alias("time_bin"), (F.col("passage_volume") * (3600.0 / (minutes * 60))).alias("metering_rate"), "avg_green_seconds", "demand_volume", "passage_volume", F.when(F.col("inside").isNotNull(), F.least(F.col("inside") * 100.0 / (minutes * MINUTE), F.lit(100.0))).alias("queue_occupancy_pct"))


def occupied_intervals(rows: DataFrame, keys: list[str], end: int) -> DataFrame:
    """begin, finish of the times a detector is on: the first ON after an OFF opens, the next OFF closes, an open one ends at ``end``."""
    w = along(keys)
    before = F.coalesce(F.lag("code").over(w), F.lit(OFF))
    turns = rows.where(F.col("code").isin(ON, OFF)).withColumn("before", before).where(F.col("code") != F.col("before"))
    return turns.withColumn("finish", F.coalesce(F.lead("t").over(w), F.lit(end))).where((F.col("code") == ON) & (F.col("finish") > F.col("t"))).select(*keys, F.col("t").alias("begin"), "finish")


def queue_occupancy(rows: DataFrame, minutes: int, end: int) -> DataFrame:
    """signal_id, bin, inside (microseconds on); bins are those of the minute of the hour."""
    on = occupied_intervals(rows, ["signal_id"], end)
    first, final = bin_of_hour(F.col("begin"), minutes), bin_of_hour(F.col("finish") - 1, minutes)
    # Bins of one hour have equal width but for the last, so hours are walked one by one.
    hour = 60 * MINUTE
    hours = F.sequence(F.floor(F.col("begin") / hour), F.floor((F.col("finish") - 1) / hour))
    slots = on.withColumn("first", first).withColumn("final", final).withColumn("h", F.explode(hours)).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit((59 // minutes) * minutes), F.lit(minutes))))
    low = F.col("h") * hour + F.col("m").cast("long") * MINUTE
    high = F.least(low + minutes * MINUTE, (F.col("h") + 1) * hour)
    spread = slots.withColumn("bin", low).where((low >= F.col("first")) & (low <= F.col("final")))
    return spread.select("signal_id", "bin", overlap(F.col("begin"), F.col("finish"), F.col("bin"), high).alias("inside")).where("inside > 0")

