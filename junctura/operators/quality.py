"""Data quality: the row validator and its merge, the watchdog's checks, alert suppression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions.temporal import MINUTE, bin_of, settled, timestamp
from junctura.functions.vocabulary import FORCE_OFF, GAP_OUT, GREEN, MAX_OUT, ON, PED_CALL
from junctura.sources.derived import Tables

HOUR = 60 * MINUTE
#: Least and largest parameter by kind.
RANGES = {"phase": (0, 40), "detector": (0, 128), "overlap": (0, 16), "ring": (0, 8), "channel": (0, 64), "preempt": (0, 10), "coord_pattern": (0, 255), "unit": (0, 255), "other": (0, 65535)}
#: The kind of parameter of each known code.
KINDS = {1: "phase", 4: "phase", 5: "phase", 6: "phase", 7: "phase", 8: "phase", 9: "phase", 10: "phase", 21: "phase", 22: "phase", 23: "phase", 45: "phase", 81: "detector", 82: "detector", 102: "preempt", 104: "preempt", 105: "preempt", 112: "unit", 113: "unit", 114: "unit", 115: "unit", 131: "coord_pattern"}
#: Statuses from best to worst.
STATUSES = ("unvalidated", "clean", "suspect", "invalid")


def validate(events: DataFrame, kinds: dict[int, str] = KINDS, ranges: dict[str, tuple[int, int]] = RANGES) -> DataFrame:
    """``events`` (code, param) with `rules_failed` and `status`; a null parameter breaks no range."""
    kind_of = F.create_map(*chain.from_iterable((F.lit(c), F.lit(k)) for c, k in kinds.items()))
    bound = lambda i: F.create_map(*chain.from_iterable((F.lit(k), F.lit(r[i])) for k, r in ranges.items()))
    kind = F.try_element_at(kind_of, F.col("code"))
    low, high = F.coalesce(F.try_element_at(bound(0), kind), F.lit(0)), F.coalesce(F.try_element_at(bound(1), kind), F.lit(65535))
    rules = F.array_compact(F.array(
        F.when(F.col("param") < 0, F.lit("negative_param")),
        F.when(kind.isNull(), F.lit("unknown_event_code")),
        F.when(kind.isNotNull() & ~F.col("param").between(low, high), F.lit("param_out_of_range")),
    ))
    return events.withColumn("rules_failed", rules).withColumn("status", F.when(F.size("rules_failed") > 0, "invalid").otherwise("clean"))


def worst(*statuses: Column) -> Column:
    """The worst of several validators' statuses; an unknown or null one counts as unvalidated."""
    order = F.create_map(*chain.from_iterable((F.lit(s), F.lit(k)) for k, s in enumerate(STATUSES)))
    rank = F.greatest(*(F.coalesce(F.try_element_at(order, s), F.lit(0)) for s in statuses), F.lit(0))
    return F.element_at(F.array(*map(F.lit, STATUSES)), rank + 1)


def validation_summary(tables: Tables) -> DataFrame:
    """Rows by code and status; codes moved up by 40 for one param in eight stand in for faulty events."""
    rows = tables.between().withColumn("code", F.when(F.col("param") == 8, F.col("code") + 40).otherwise(F.col("code")))
    return validate(rows).groupBy("code", "status").agg(F.count("*").alias("n"))


def _recent(tables: Tables, as_of: int | None, span: int, *codes: int) -> DataFrame:
    """The rows of the span before a time, the window's end if none is given."""
    as_of = tables.end if as_of is None else as_of
    return tables.between(*codes, start=as_of - span, end=as_of)


def silent_signal(tables: Tables, as_of: int | None = None, hours: int = 24) -> DataFrame:
    """Signals whose last event is older; signals never seen are not known here."""
    as_of = tables.end + 26 * HOUR if as_of is None else as_of
    return tables.log.groupBy("signal_id").agg(F.max("t").alias("t")).where(F.col("t") < as_of - hours * HOUR).select("signal_id", timestamp(F.col("t")).alias("last_event"))


def stuck_detector(tables: Tables, as_of: int | None = None, most: int = 8) -> DataFrame:
    """Channels with more than ``most`` activations in the last hour (3600 in production)."""
    return _recent(tables, as_of, HOUR, ON).groupBy("signal_id", F.col("param").alias("channel")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def low_event_count(tables: Tables, as_of: int | None = None, least: int = 175) -> DataFrame:
    """Signals with fewer events in the last hour (100 in production)."""
    return _recent(tables, as_of, HOUR).groupBy("signal_id").agg(F.count("*").alias("n")).where(F.col("n") < least)


def missing_data_window(tables: Tables, as_of: int | None = None, minutes: int = 30) -> DataFrame:
    as_of = tables.end + HOUR if as_of is None else as_of
    return tables.log.groupBy("signal_id").agg(F.max("t").alias("t")).where(F.col("t") < as_of - minutes * MINUTE).select("signal_id", timestamp(F.col("t")).alias("last_event"))


def stuck_ped(tables: Tables, as_of: int | None = None, minutes: int = 120, per_minute: float = 0.02) -> DataFrame:
    """Phases with more pedestrian calls than the rate allows over the window (2 a minute in production)."""
    return _recent(tables, as_of, minutes * MINUTE, PED_CALL).groupBy("signal_id", F.col("param").alias("phase")).agg(F.count("*").alias("n")).where(F.col("n") > per_minute * minutes)


def phase_termination_anomaly(tables: Tables, as_of: int | None = None, sigmas: float = 1.0) -> DataFrame:
    """Phases whose termination mix in the last hour lies beyond ``sigmas`` deviations of seven days' hourly mixes (3 in production)."""
    of = lambda c: F.count(F.when(F.col("code") == c, 1))
    names = {"gap": GAP_OUT, "max": MAX_OUT, "force": FORCE_OFF}
    hourly = _recent(tables, as_of, 7 * 24 * HOUR, GREEN, GAP_OUT, MAX_OUT, FORCE_OFF).groupBy("signal_id", F.col("param").alias("phase"), bin_of(F.col("t"), HOUR).alias("hour")).agg(*(of(c).alias(n) for n, c in names.items())).withColumn("total", sum((F.col(n) for n in list(names)[1:]), F.col("gap")))
    ratio = lambda n: F.when(F.col("total") == 0, 0.0).otherwise(F.col(n) * 1.0 / F.col("total"))
    base = [settled(f(ratio(n))).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    now = F.col("hour") >= (tables.end if as_of is None else as_of) - HOUR
    both = hourly.groupBy("signal_id", "phase").agg(*(F.sum(F.when(now, F.col(n))).alias(n) for n in (*names, "total")), *base).where("total is not null")
    met = both.select("signal_id", "phase", *(ratio(n).alias(f"{n}_ratio") for n in names), *(f"{n}_{k}" for n in names for k in ("mean", "sd")))
    odd = F.lit(False)
    for n in names:
        odd |= (F.col(f"{n}_sd") > 0) & (F.abs(F.col(f"{n}_ratio") - F.col(f"{n}_mean")) > sigmas * F.col(f"{n}_sd"))
    return met.where(odd)


def low_hit_count(tables: Tables, as_of: int | None = None, least: int = 5) -> DataFrame:
    """Channels with few activations in the last hour at signals that do run."""
    running = _recent(tables, as_of, HOUR, GREEN).select("signal_id").distinct()
    return _recent(tables, as_of, HOUR, ON).join(running, "signal_id", "left_semi").groupBy("signal_id", F.col("param").alias("channel")).agg(F.count("*").alias("n")).where(F.col("n") < least)


def unsuppressed(alerts: DataFrame, rules: DataFrame, check: str, as_of: int) -> DataFrame:
    """Alerts no rule (signal_id or null for all, check_name, expires_at or null for never) holds back."""
    live = rules.where((F.col("check_name") == check) & (F.col("expires_at").isNull() | (F.col("expires_at") > timestamp(F.lit(as_of))))).select(F.col("signal_id").alias("_signal"))
    left = alerts.join(live.where("_signal is not null"), F.col("signal_id") == F.col("_signal"), "left_anti")
    return left.join(live.where("_signal is null").distinct(), how="left_anti")  # at most one row, so no pairs


def suppressed_alerts(tables: Tables) -> DataFrame:
    """Missing-data alerts left over by a rule for one signal and an expired one for all."""
    rules = tables.spark.sql("select * from values ('SIG-001', 'missing_data_window', timestamp_ntz'2030-01-01'), (null, 'missing_data_window', timestamp_ntz'2020-01-01') as r(signal_id, check_name, expires_at)")
    return unsuppressed(missing_data_window(tables), rules, "missing_data_window", tables.end)


CHECKS = (silent_signal, stuck_detector, low_event_count, missing_data_window, stuck_ped, phase_termination_anomaly, low_hit_count)


def latest_status(tables: Tables) -> DataFrame:
    """The validator's status merged with a second one that suspects parameters over 6, by signal: rows by the worse of the two, over all rows."""
    rows = validate(tables.between()).withColumn("merged", worst(F.col("status"), F.when(F.col("param") > 6, "suspect").otherwise("clean")))
    return rows.groupBy("signal_id", "merged").agg(F.count("*").alias("n"))
