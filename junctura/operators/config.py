"""Configuration as of a time, and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.history import as_of
from junctura.functions.temporal import timestamp
from junctura.sources.derived import START, Tables

APPROACH = "signal_id string, direction_type_id smallint, protected_phase_number smallint, permissive_phase_number smallint, ped_phase_number smallint, mph smallint, description string"
DETECTOR = "approach_id string, detector_channel smallint, distance_from_stop_bar int, min_speed_filter smallint, lane_number smallint, movement_type_code string"


def audit_example(tables: Tables) -> DataFrame:
    """A history of approaches: every one inserted, phase 4 given another speed at 2 h, phase 6 deleted at 3 h; phase 8 has no history."""
    a = tables.approaches.where("phase != 8")
    row = lambda df, op, hours, mph: df.select("approach_id", timestamp(F.lit(START + int(hours * 3_600_000_000))).alias("changed_at"), F.lit(int(hours * 10)).alias("audit_id"), F.lit(op).alias("operation"), F.to_json(F.struct("signal_id", F.col("phase").alias("protected_phase_number"), F.lit(mph).alias("mph"))).alias("new_values"))
    return row(a, "INSERT", 0, 35).unionByName(row(a.where("phase = 4"), "UPDATE", 2, 45)).unionByName(row(a.where("phase = 6"), "DELETE", 3, 35))


def approaches_as_of(tables: Tables, hours: float = 4.0) -> DataFrame:
    fields = "signal_id string, protected_phase_number smallint, mph smallint"
    live = tables.approaches.select("approach_id", "signal_id", F.col("phase").cast("smallint").alias("protected_phase_number"), F.lit(30).cast("smallint").alias("mph"))
    found = as_of(audit_example(tables), live, "approach_id", fields, timestamp(F.lit(START + int(hours * 3_600_000_000))))
    return found.select("approach_id", "signal_id", F.col("protected_phase_number").cast("int").alias("phase"), F.col("mph").cast("int").alias("mph"))


def signal_tree(tables: Tables) -> DataFrame:
    """Signals with their approaches and these with their detectors, as nested columns."""
    detectors = tables.detectors.groupBy("signal_id", "approach_id").agg(F.array_sort(F.collect_list(F.struct("channel", "movement"))).alias("detectors"))
    approaches = tables.approaches.join(detectors, ["signal_id", "approach_id"], "left")
    return approaches.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("approach_id", "direction", "phase", "detectors"))).alias("approaches"))


def signal_tree_flat(tables: Tables) -> DataFrame:
    rows = signal_tree(tables).select("signal_id", F.explode("approaches").alias("a"))
    return rows.select("signal_id", "a.approach_id", "a.direction", F.size("a.detectors").cast("long").alias("n_detectors"), F.array_join(F.transform("a.detectors", lambda d: d["channel"].cast("string")), ",").alias("channels"))


def channels_for_phase(tables: Tables) -> DataFrame:
    return tables.detectors.groupBy("signal_id", "phase").agg(F.array_join(F.array_sort(F.collect_list("channel")).cast("array<string>"), ",").alias("channels"))
