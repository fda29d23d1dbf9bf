"""The tables of an event lake and a configuration folder, over a window and for some signals.

The window, the codes and the signals reach the lake's Parquet scan: folders of other dates are not
opened, and row groups of other signals, times or codes are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.history import as_of
from junctura.functions.temporal import micros, timestamp
from junctura.sources.derived import Tables
from junctura.sources.lake import existing, scan

_APPROACH = "signal_id string, phase int, direction string, mph int, ped_phase int"
_DETECTOR = "signal_id string, channel int, phase int, approach_id string, direction string, movement string, distance int, min_speed int, ped_phase int, permissive_phase int"


def moment(t: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=t)


def plans_between(plans: DataFrame, start: int, end: int) -> DataFrame:
    """Plans (begin, finish or null) that overlap [start, end]."""
    return plans.where((F.col("begin") <= end) & (F.col("finish").isNull() | (F.col("finish") >= start)))


@dataclass
class LakeTables(Tables):
    """``folder``: approaches, detectors, plans, route, speeds (Parquet) and, where they are kept, approach_audit, detector_audit, sites, site_audit and checkpoints; ``lake``: the events.

    Configuration is that of the window's start: of entities with a history, the fields they had then. ``store``, where one is kept, has
    the cycle tables built so far, which some reports read first.
    """

    lake: str = ""
    store: str = ""

    def between(self, *codes: int, start: int | None = None, end: int | None = None) -> DataFrame:
        rows = scan(self.spark, self.lake, moment(self.start if start is None else start), moment(self.end if end is None else end), codes, self.chosen)
        return self._short(rows)

    @staticmethod
    def _short(rows: DataFrame) -> DataFrame:
        return rows.select("signal_id", micros(F.col("event_time")).alias("t"), F.col("event_code").alias("code"), F.col("event_param").alias("param"))

    @cached_property
    def log(self) -> DataFrame:
        """The whole log of the chosen signals."""
        return self._short(self.of_chosen(existing(self.spark, self.lake)))

    def _then(self, name: str, entity: str, fields: str) -> DataFrame:
        live = self.read(f"{name}es" if name.endswith("ch") else f"{name}s")
        if name == "detector" and "permissive_phase" not in live.columns:
            live = live.withColumn("permissive_phase", F.lit(None).cast("int"))
        audit = existing(self.spark, f"{self.folder}/{name}_audit.parquet", None)
        found = live if audit is None else as_of(audit, live, entity, fields, timestamp(F.lit(self.start)))
        return self.of_chosen(found)

    @cached_property
    def approaches(self) -> DataFrame:
        return self._then("approach", "approach_id", _APPROACH)

    @cached_property
    def detectors(self) -> DataFrame:
        return self._then("detector", "detector_id", _DETECTOR)

    @cached_property
    def signals(self) -> DataFrame:
        return self.approaches.select("signal_id").distinct()

    @cached_property
    def plans(self) -> DataFrame:
        return self.of_chosen(plans_between(self.read("plans"), self.start, self.end))

    @cached_property
    def route(self) -> DataFrame:
        return self.of_chosen(self.read("route"))

    @cached_property
    def speeds(self) -> DataFrame:
        return self.of_chosen(self.read("speeds").where(F.col("t").between(self.start, self.end)))

    @cached_property
    def sites(self) -> DataFrame:
        return self.of_chosen(self.read("sites"))

    @cached_property
    def site_audit(self) -> DataFrame:
        return self.of_chosen(self.read("site_audit"))

    @cached_property
    def checkpoints(self) -> DataFrame:
        return self.read("checkpoints")
