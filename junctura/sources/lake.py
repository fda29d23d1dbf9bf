"""The event lake: scans that prune by date, raw event queries, idempotent appends, cold export, corrections, retention, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.commits import Store, commit, committed, remove
from junctura.sources.derived import END, START, Tables

EVENT_KEY = ["signal_id", "event_time", "event_code", "event_param"]
EVENT_SCHEMA = "signal_id string, event_time timestamp_ntz, event_code int, event_param int, device_id smallint"
LIMIT, MOST = 10_000, 100_000


_LAKE = EVENT_SCHEMA + ", event_date date"


def write_events(events: DataFrame, path: str, batch: str | None = None) -> bool:
    """Commit events in one folder a date, sorted by signal and time inside; keys that are there already stay as they are.

    Only the folders of the new rows' dates are read. A named ``batch`` is taken once.
    """
    dated = events.withColumn("event_date", F.to_date("event_time"))
    return commit(dated, path, EVENT_KEY, ["event_date"], batch, sort=["signal_id", "event_time"])


def existing(spark: SparkSession, path: str, schema: str | None = _LAKE) -> DataFrame | None:
    """A Parquet table (its committed rows, where it has commits), None where there is none."""
    if schema and (rows := committed(spark, path, schema)) is not None:
        return rows
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path) if there else None


def scan(spark: SparkSession, path: str, start, end, codes: tuple[int, ...] = (), signals: tuple[str, ...] = ()) -> DataFrame:
    """Events in [start, end]; the dates choose the committed files and are asked for too, so other folders are not opened."""
    first, final = (f"event_date={v:%Y-%m-%d}" for v in (start, end))
    rows = committed(spark, path, _LAKE, lambda part: first <= part <= final)
    rows = spark.read.schema(_LAKE).parquet(path) if rows is None else rows
    rows = rows.where(F.col("event_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & F.col("event_time").between(F.lit(start), F.lit(end)))
    rows = rows.where(F.col("event_code").isin(*codes)) if codes else rows
    return (rows.where(F.col("signal_id").isin(*signals)) if signals else rows).drop("event_date")


def events_query(tables: Tables, signal: str = "SIG-001", codes: tuple[int, ...] = (1, 8, 9), param: int | None = 2, start: int = START, end: int = END, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    """A page of raw events, earliest first; the limit is the page's size, at most 100,000, the offset where it begins."""
    if end < start:
        raise ValueError("the end lies before the start")
    rows = tables.between(*codes, start=start, end=end).where(F.col("signal_id") == signal)
    rows = rows.where(F.col("param") == param) if param is not None else rows
    return rows.orderBy("t", "code", "param").offset(offset).limit(min(limit, MOST)).select("signal_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("event_time"), F.col("code").alias("event_code"), F.col("param").alias("event_param"))


def export_cold(events: DataFrame, path: str) -> None:
    """Parquet with one folder for each signal and date."""
    dated = events.withColumn("event_date", F.to_date("event_time"))
    dated.repartition("signal_id", "event_date").sortWithinPartitions("event_time").write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("signal_id", "event_date").parquet(path)


def corrected(events: DataFrame, signal: str, start, end, offset_seconds: float) -> DataFrame:
    """Events with the clock of one signal put right in [start, end]; keys that meet others then fall together."""
    hit = (F.col("signal_id") == signal) & F.col("event_time").between(F.lit(start), F.lit(end))
    moved = F.when(hit, F.timestamp_micros(F.unix_micros(F.col("event_time").cast("timestamp")) + int(offset_seconds * 1_000_000)).cast("timestamp_ntz")).otherwise(F.col("event_time"))
    return events.withColumn("event_time", moved).dropDuplicates(EVENT_KEY)


def anchor_offset(recorded, actual) -> float:
    """The offset in seconds by which an event of known time was recorded wrongly."""
    return (actual - recorded).total_seconds()


def clock_correction(tables: Tables) -> DataFrame:
    """The log with SIG-002 moved by 90 s in its second hour, counted by signal and quarter hour."""
    rows = tables.between().select("signal_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("event_time"), F.col("code").alias("event_code"), F.col("param").alias("event_param"))
    moved = corrected(rows, "SIG-002", F.timestamp_micros(F.lit(START + 3_600_000_000)).cast("timestamp_ntz"), F.timestamp_micros(F.lit(START + 7_200_000_000)).cast("timestamp_ntz"), 90.0)
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    return moved.groupBy("signal_id", F.timestamp_micros(F.floor(t / 900_000_000) * 900_000_000).cast("timestamp_ntz").alias("bin_start")).agg(F.count("*").alias("n"))


def drop_before(spark: SparkSession, path: str, keep_from: str) -> list[str]:
    """Delete the date folders older than ``keep_from`` (yyyy-mm-dd); returns their dates."""
    old = lambda part: part.startswith("event_date=") and part.removeprefix("event_date=") < keep_from
    remove(spark, path, old)
    store = Store(spark, path)
    gone = [name for name in store.names("") if old(name)]
    for name in gone:
        store.delete(name)
    return [name.removeprefix("event_date=") for name in gone]


def export(report: DataFrame, path: str, kind: str) -> None:
    """A report as csv (with a header even when empty), json lines or xml; nested columns do not go into csv."""
    if kind == "csv":
        nested = [n for n, t in report.dtypes if t.startswith(("array", "map", "struct"))]
        if nested:
            raise ValueError(f"csv cannot hold the nested columns {nested}")
        report.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "ndjson"):
        report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind == "xml":
        report.write.mode("overwrite").option("rowTag", "row").xml(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def future_dated(events: DataFrame, now, tolerance_seconds: int = 300) -> DataFrame:
    """Events with `is_future`: later than now and the tolerance. They are kept, but a cursor must not follow them."""
    limit = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(tolerance_seconds))
    return events.withColumn("is_future", F.col("event_time") > limit)


def cursor(events: DataFrame, now, tolerance_seconds: int = 300) -> DataFrame:
    """signal_id, the time up to which it has been read, capped at now and the tolerance."""
    limit = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(tolerance_seconds))
    return events.groupBy("signal_id").agg(F.least(F.max("event_time"), limit).alias("last_event_time"), F.count("*").alias("events"))


def resolved_detections(detections: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensor detections with the sensor and signal of their vendor tag; unknown tags take no part."""
    return detections.join(sensors.select("vendor_tag", "sensor_id", "signal_id"), "vendor_tag")
