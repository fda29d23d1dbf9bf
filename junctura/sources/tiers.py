"""Hot and cold events as one view.

Events are hot, by date, until they move to the cold table, by signal and date. A boundary date, kept beside the cold table under names that
are only ever added, says which of the two answers for a date. It moves after the rows have been committed there and before
they leave the hot table, so every row is seen once at any moment, whether a move ends or dies.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.commits import Store, commit, committed, snapshot
from junctura.sources.lake import EVENT_KEY, drop_before, scan

_BOUNDARY = "_boundary"
_COLD = "event_time timestamp_ntz, event_code int, event_param int, device_id smallint, signal_id string, event_date date"
_COLUMNS = [*EVENT_KEY, "device_id"]


def boundary(spark: SparkSession, cold: str) -> date | None:
    """The first date that is hot; None before anything has moved."""
    names = Store(spark, cold).names(_BOUNDARY)
    return date.fromisoformat(names[-1].removesuffix(".json")) if names else None


def _date(part: str) -> str:
    return part.rpartition("event_date=")[2]


def events_view(spark: SparkSession, hot: str, cold: str, start: datetime, end: datetime, codes: tuple[int, ...] = (), signals: tuple[str, ...] = ()) -> DataFrame:
    """Events in [start, end] of both tables, each once; dates and signals choose the files that either side opens."""
    first = boundary(spark, cold)
    if first is None:
        return scan(spark, hot, start, end, codes, signals).select(_COLUMNS)
    edge = datetime.combine(first, time())
    low, high = f"{start:%Y-%m-%d}", min(f"{end:%Y-%m-%d}", f"{first - timedelta(days=1):%Y-%m-%d}")
    wanted = lambda part: low <= _date(part) <= high and (not signals or part.split("/")[0].removeprefix("signal_id=") in signals)
    old = committed(spark, cold, _COLD, wanted)
    old = old.where(F.col("event_date").between(F.lit(low).cast("date"), F.lit(high).cast("date")) & F.col("event_time").between(F.lit(start), F.lit(end)))
    old = old.where(F.col("event_code").isin(*codes)) if codes else old
    old = (old.where(F.col("signal_id").isin(*signals)) if signals else old).select(_COLUMNS)
    now = snapshot(Store(spark, hot))
    if start < edge and now and any(low <= _date(f.rpartition("/")[0]) <= high for f in now.files):
        # Rows that came after their date had moved, or whose move was broken off.
        late = scan(spark, hot, start, min(end, edge - timedelta(microseconds=1)), codes, signals).select(_COLUMNS)
        old = old.unionByName(late).dropDuplicates(EVENT_KEY)
    return old.unionByName(scan(spark, hot, max(start, edge), end, codes, signals).select(_COLUMNS)) if end >= edge else old


def move(spark: SparkSession, hot: str, cold: str, upto: date) -> bool:
    """Make all dates before ``upto`` cold, late rows of earlier ones too. Run again, it goes on where it broke off."""
    whole = scan(spark, hot, datetime(1, 1, 1), datetime.combine(upto, time()) - timedelta(microseconds=1)).select(_COLUMNS)
    commit(whole.withColumn("event_date", F.to_date("event_time")), cold, EVENT_KEY, ["signal_id", "event_date"], sort=["event_time"])
    store, known = Store(spark, cold), boundary(spark, cold)
    moved = (known is None or known < upto) and store.create(f"{_BOUNDARY}/{upto:%Y-%m-%d}.json", "{}")
    drop_before(spark, hot, f"{upto:%Y-%m-%d}")
    return moved
