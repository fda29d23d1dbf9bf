"""The validation loop: each row of an event lake is judged once, by what was committed since the last run.

Verdicts are a table of their own, by date and key. Its commits are named for the lake's version that they reach, which is the
loop's state: a run reads only files that later versions added, and one that died is done again as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators.quality import validate, worst
from junctura.sources.commits import Store, added_since, commit, committed, snapshot
from junctura.sources.lake import EVENT_KEY, EVENT_SCHEMA

VERDICTS = "signal_id string, event_time timestamp_ntz, event_code int, event_param int, rules_failed array<string>, status string, event_date date"
_LAKE = EVENT_SCHEMA + ", event_date date"


def reached(spark: SparkSession, verdicts: str, validator: str = "rules") -> int:
    """The lake's version up to which a validator has judged."""
    now = snapshot(Store(spark, verdicts))
    return max((int(b.rpartition("@")[2]) for b in (now.batches if now else ()) if b.startswith(f"{validator}@")), default=0)


def validate_new(spark: SparkSession, lake: str, verdicts: str, validator: str = "rules", judge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Judge what is new in the lake and merge it into the verdicts; returns the version reached.

    ``judge`` adds rules_failed and status to rows with code and param (`quality.validate`, if not given); each ``validator`` has a state
    of its own. Of several verdicts on a row the worst status stays, and the rules of all.
    """
    rows, version = added_since(spark, lake, _LAKE, reached(spark, verdicts, validator))
    if rows is None:
        if version > reached(spark, verdicts, validator):
            commit(spark.createDataFrame([], VERDICTS), verdicts, EVENT_KEY, ["event_date"], f"{validator}@{version}", replace=True)
        return version
    judged = (judge or validate)(rows.withColumnsRenamed({"event_code": "code", "event_param": "param"})).withColumnsRenamed({"code": "event_code", "param": "event_param"})
    judged = judged.select(*EVENT_KEY, "event_date", "rules_failed", "status")
    dates = {f"event_date={r.event_date}" for r in rows.select("event_date").distinct().collect()}
    old = committed(spark, verdicts, VERDICTS, lambda part: part in dates)
    if old is not None:
        before = old.withColumnsRenamed({"rules_failed": "_rules", "status": "_status"})
        met = judged.join(before, [*EVENT_KEY, "event_date"], "left")
        judged = met.withColumn("rules_failed", F.array_sort(F.array_union("rules_failed", F.coalesce("_rules", F.array().cast("array<string>"))))).withColumn("status", worst(F.col("status"), F.col("_status"))).drop("_rules", "_status")
    commit(judged.select(*EVENT_KEY, "rules_failed", "status", "event_date"), verdicts, EVENT_KEY, ["event_date"], f"{validator}@{version}", replace=True)
    return version
