"""The engine's tables, derived from a folder's generic `events` table.

A controller log comes from `events` by a fixed recipe (time runs sixtyfold, codes follow a hash of
ids), intersections from `supplier`; approaches, detectors, plans and a route follow by arithmetic. `PRELUDE` is the recipe in SQL.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions.temporal import along, micros
from junctura.functions.vocabulary import DIRECTIONS, OFF, ON

START = 1_704_067_200_000_000
END = START + 12 * 3_600_000_000
DAY = 24 * 3_600_000_000

_CODES = ((12, 1), (24, 8), (36, 9), (44, 10), (48, 4), (51, 5), (54, 6), (74, 82), (88, 81), (90, 21), (92, 45), (93, 102), (94, 105), (95, 104), (96, 112), (97, 114), (98, 131), (100, 113))
_PHASES = ((2, 1), (4, 3), (6, 2), (8, 4))


@dataclass
class Tables:
    """The tables that operators take, over a window and for all signals or some; each is built when first asked for.

    Here they come from the generic tables of a folder; `lake_tables` has those of an event lake.
    """

    spark: SparkSession
    folder: str
    start: int = START
    end: int = END
    chosen: tuple[str, ...] = ()

    def over(self, start: int | None = None, end: int | None = None, signals: tuple[str, ...] = ()) -> Tables:
        """The same tables over another window (microseconds) or for some signals only."""
        return replace(self, start=self.start if start is None else start, end=self.end if end is None else end, chosen=tuple(signals) or self.chosen)

    def with_permissive(self) -> Tables:
        """The same tables, with detectors that have no protected phase at their permissive one."""
        other = copy(self)
        if "permissive_phase" in self.detectors.columns:
            other.detectors = self.detectors.withColumn("phase", F.coalesce("phase", "permissive_phase"))
        return other

    def of_chosen(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("signal_id").isin(*self.chosen)) if self.chosen else rows

    @property
    def hours(self) -> float:
        return (self.end - self.start) / 3_600_000_000

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        """signal_id, t, code, param: the controller log, one row for each key."""
        t = F.lit(START) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {START}) div 60")
        h = (F.col("event_id") * 7919 + F.col("user_id") * 31) % 100
        code = F.lit(None)
        for most, value in reversed(_CODES):
            code = F.when(h < most, value).otherwise(code)
        k = F.get_json_object("props", "$.k").cast("int")
        rows = self.read("events").select(F.concat(F.lit("SIG-00"), (F.col("user_id") % 5).cast("string")).alias("signal_id"), t.alias("t"), code.cast("int").alias("code"), k.alias("k"))
        param = F.when(F.col("code").isin(OFF, ON), 1 + F.col("k") % 8).when(F.col("code").isin(102, 104, 105), 1 + F.col("k") % 2).when(F.col("code") == 131, 1 + F.col("k") % 3).otherwise(2 + 2 * (F.col("k") % 4))
        return self.of_chosen(rows.select("signal_id", "t", "code", param.cast("int").alias("param")))

    def between(self, *codes: int, start: int | None = None, end: int | None = None) -> DataFrame:
        """The log's rows with these codes in [start, end] (the window, if not given), both ends included."""
        rows = self.log.where(F.col("t").between(self.start if start is None else start, self.end if end is None else end))
        return rows.where(F.col("code").isin(*codes)) if codes else rows

    @cached_property
    def signals(self) -> DataFrame:
        """The intersections: suppliers stand for the crews that keep them, five to a round."""
        return self.of_chosen(self.read("supplier").select(F.concat(F.lit("SIG-00"), (F.col("s_suppkey") % 5).cast("string")).alias("signal_id")).distinct())

    @cached_property
    def approaches(self) -> DataFrame:
        """signal_id, approach_id, phase, direction, mph, ped_phase."""
        each = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(DIRECTIONS[d]).alias("direction")) for p, d in _PHASES)))
        return self.signals.select("signal_id", each.alias("a")).select("signal_id", F.concat("signal_id", F.lit("-P"), F.col("a.phase").cast("string")).alias("approach_id"), "a.phase", "a.direction", F.lit(35).alias("mph"), F.col("a.phase").alias("ped_phase"))

    @cached_property
    def detectors(self) -> DataFrame:
        """signal_id, channel, phase, approach_id, direction, movement, distance, min_speed, ped_phase."""
        c, phase = F.col("channel"), F.col("phase")
        rows = self.signals.select("signal_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("channel")).withColumn("phase", (2 + 2 * ((c - 1) % 4)).cast("int"))
        direction = F.lit(None)
        for p, d in _PHASES:
            direction = F.when(phase == p, DIRECTIONS[d]).otherwise(direction)
        odd = c % 2 == 1
        return rows.select(
            "signal_id", "channel", "phase", F.concat("signal_id", F.lit("-P"), phase.cast("string")).alias("approach_id"), direction.alias("direction"), F.when(c <= 4, "T").otherwise("L").alias("movement"),
            F.when(odd, 400).alias("distance"), F.when(odd, 5).alias("min_speed"), phase.alias("ped_phase"),
        )

    @cached_property
    def plans(self) -> DataFrame:
        """signal_id, plan_number, begin, finish (null while open), cycle_length, offset_seconds, splits."""
        rows = self.log.where("code = 131").select("signal_id", "t", "code", "param")
        splits = F.create_map(*(F.lit(v) for pair in ((2, 35), (4, 25), (6, 40), (8, 20)) for v in pair))
        return rows.select("signal_id", F.col("param").alias("plan_number"), F.col("t").alias("begin"), F.lead("t").over(along(["signal_id"])).alias("finish"), F.lit(90).alias("cycle_length"), (F.col("param") * 10).alias("offset_seconds"), splits.alias("splits"))

    @cached_property
    def route(self) -> DataFrame:
        """signal_id, place, phase of the signals along one route."""
        return self.signals.select("signal_id", F.substring("signal_id", -1, 1).cast("int").alias("place"), F.lit(2).alias("phase"))

    @cached_property
    def speeds(self) -> DataFrame:
        """signal_id, lane, approach_id, t, mph of roadside speed samples."""
        rows = self.read("events").select(F.concat(F.lit("SIG-00"), (F.col("user_id") % 5).cast("string")).alias("signal_id"), F.expr(f"{START} + (unix_micros(cast(ts as timestamp)) - {START}) div 60").alias("t"), (1 + F.col("event_id") % 2).cast("int").alias("lane"), (F.col("value").cast("int") % 70 + 10).alias("mph"))
        return rows.withColumn("approach_id", F.concat("signal_id", F.lit("-P"), (2 * F.col("lane")).cast("string")))

    @cached_property
    def sites(self) -> DataFrame:
        """signal_id, primary_street, region_id, corridor_id, jurisdiction_id, enabled: every supplier as an intersection of its nation and region."""
        nations, regions = self.read("nation"), self.read("region")
        rows = self.read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        key = F.col("s_suppkey")
        return rows.select(F.concat(F.lit("SITE-"), key.cast("string")).alias("signal_id"), F.col("s_name").alias("primary_street"), F.col("r_name").alias("region_id"), F.concat(F.lit("C-"), (key % 7).cast("string")).alias("corridor_id"), F.col("n_name").alias("jurisdiction_id"), (key % 9 != 0).alias("enabled"))

    @cached_property
    def site_audit(self) -> DataFrame:
        """audit_id, signal_id, changed_at, changed_by, operation, old_values, new_values: every order as a change of an intersection."""
        value = F.to_json(F.struct(F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_totalprice").cast("long").cast("string").alias("cost")))
        before = F.to_json(F.struct(F.lit("3").alias("priority"), F.lit(None).cast("string").alias("cost")))
        operation = F.when(F.col("o_orderstatus") == "O", "INSERT").when(F.col("o_orderstatus") == "F", "UPDATE").otherwise("DELETE")
        return self.read("orders").select(
            F.col("o_orderkey").alias("audit_id"), F.concat(F.lit("SITE-"), (F.col("o_custkey") % 40).cast("string")).alias("signal_id"), F.col("o_orderdate").alias("changed_at"), F.concat(F.lit("user-"), (F.col("o_custkey") % 3).cast("string")).alias("changed_by"),
            operation.alias("operation"), F.when(operation != "INSERT", before).alias("old_values"), F.when(operation != "DELETE", value).alias("new_values"),
        )

    @cached_property
    def checkpoints(self) -> DataFrame:
        """device_type, device_id, method, last_event_timestamp, events_ingested, consecutive_errors: each user as a device, each kind of event as a method."""
        t = F.lit(START) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {START}) div 60")
        kind = F.when(F.col("user_id") % 3 == 0, "sensor").otherwise("controller")
        rows = self.read("events").groupBy(kind.alias("device_type"), F.concat(F.lit("DEV-"), F.col("user_id").cast("string")).alias("device_id"), F.col("event_type").alias("method"))
        return rows.agg(F.timestamp_micros(F.max(t)).cast("timestamp_ntz").alias("last_event_timestamp"), F.count("*").alias("events_ingested"), F.count(F.when(F.col("value") > 150, 1)).alias("consecutive_errors"))

    def phase_events(self, *codes: int, **window: int) -> DataFrame:
        return self.between(*codes, **window).withColumnRenamed("param", "phase")

    def arrivals(self, *codes: int, **window: int) -> DataFrame:
        """Detector events with the detector's phase, approach, direction and movement."""
        return self.between(*(codes or (ON,)), **window).withColumnRenamed("param", "channel").join(self.detectors, ["signal_id", "channel"])

    def stream(self, phase_codes: tuple[int, ...], detector_codes: tuple[int, ...] = (ON,), **window: int) -> DataFrame:
        """signal_id, phase, t, code, param, approach_id: phase events and the detector events that serve the phase, for one window.

        One scan gives both; only detector events look up their phase, and those of unknown channels go.
        """
        hit = F.col("code").isin(*detector_codes)
        served = self.detectors.select(F.col("signal_id").alias("_signal"), F.col("channel").alias("_channel"), F.col("phase").alias("_phase"), "approach_id")
        met = self.between(*phase_codes, *detector_codes, **window).withColumn("_at", F.when(hit, F.col("param")))
        met = met.join(served, (F.col("signal_id") == F.col("_signal")) & (F.col("_at") == F.col("_channel")), "left")
        phase = F.when(hit, F.col("_phase")).otherwise(F.col("param"))
        return met.select("signal_id", phase.alias("phase"), "t", "code", F.when(hit, F.col("param")).otherwise(0).alias("param"), "approach_id").where("phase is not null")


@dataclass
class DayTables(Tables):
    """The same log dealt out over a week by the events' numbers; each event keeps its time of day."""

    end: int = START + 7 * DAY - 1

    def read(self, name: str) -> DataFrame:
        rows = super().read(name)
        return rows.withColumn("ts", F.expr("ts + make_dt_interval(cast(60 * (event_id % 7) as int))")) if name == "events" else rows


_CASE = " ".join(f"WHEN h < {m} THEN {v}" for m, v in _CODES)
PRELUDE = f"""ev0 AS (SELECT event_id, user_id % 5 AS sn, value, {START} + (epoch_us(ts) - {START}) // 60 AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, (event_id * 7919 + user_id * 31) % 100 AS h FROM events),
ev1 AS (SELECT 'SIG-00' || sn AS signal_id, t, k, CASE {_CASE} END AS code FROM ev0),
cel AS (SELECT signal_id, t, code, CASE WHEN code IN (81, 82) THEN 1 + k % 8 WHEN code IN (102, 104, 105) THEN 1 + k % 2 WHEN code = 131 THEN 1 + k % 3 ELSE 2 + 2 * (k % 4) END AS param FROM ev1),
win AS (SELECT * FROM cel WHERE t BETWEEN {START} AND {END}),
sig AS (SELECT DISTINCT 'SIG-00' || (s_suppkey % 5) AS signal_id, s_suppkey % 5 AS place FROM supplier),
app AS (SELECT signal_id, signal_id || '-P' || phase AS approach_id, phase, direction FROM sig, (VALUES (2, 'NB'), (4, 'EB'), (6, 'SB'), (8, 'WB')) v(phase, direction)),
det AS (SELECT app.*, c AS channel, CASE WHEN c <= 4 THEN 'T' ELSE 'L' END AS movement, CASE WHEN c % 2 = 1 THEN 400 END AS distance FROM app JOIN range(1, 9) g(c) ON phase = 2 + 2 * ((c - 1) % 4)),
pev AS (SELECT signal_id, param AS phase, t, code, 0 AS param, NULL AS approach_id FROM win WHERE code IN (1, 4, 5, 6, 7, 8, 9, 10)),
dev AS (SELECT w.signal_id, d.phase, w.t, w.code, w.param, d.approach_id, d.direction, d.movement, d.distance FROM win w JOIN det d ON d.signal_id = w.signal_id AND d.channel = w.param WHERE code IN (81, 82)),
stm AS (SELECT * FROM pev UNION ALL SELECT signal_id, phase, t, code, param, approach_id FROM dev),
plans AS (SELECT signal_id, param AS plan_number, t AS begin, lead(t) OVER (PARTITION BY signal_id ORDER BY t, param) AS finish FROM cel WHERE code = 131)"""
