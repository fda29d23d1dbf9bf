"""Streaming forms of ingestion and counters; the state machines stand in `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.decoders import decode_files
from junctura.sources.lake import EVENT_KEY, EVENT_SCHEMA, write_events
from junctura.streaming.ordered import PLAN_SCHEMA, closed_plans, device_watch, preempts  # noqa: F401 - the stateful streams

MESSAGE = "signal_id: string, event_time: timestamp_ntz, event_code: int, event_param: int, device_id: smallint"
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def landed_logs(spark: SparkSession, folder: str, kind: str = "auto", archive: str | None = None) -> DataFrame:
    """Events of log files as they land in a folder; read files move to ``archive`` if one is given."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return decode_files(reader.load(folder), kind).where("error is null").select("signal_id", "event_time", "event_code", "event_param")


def message_events(messages: DataFrame) -> DataFrame:
    """Events of messages whose ``value`` is a JSON object of the event table's fields, or a list of such objects.

    Objects without a signal, a time, a code or a parameter go, and so does what is not JSON.
    """
    value = F.col("value").cast("string")
    parsed = F.when(F.ltrim(value).startswith("["), F.from_json(value, f"array<struct<{MESSAGE}>>")).otherwise(F.array(F.from_json(value, f"struct<{MESSAGE}>")))
    rows = messages.select(F.inline(parsed))
    return rows.dropna(subset=EVENT_KEY).withColumn("device_id", F.coalesce("device_id", F.lit(1)).cast("smallint")).select(*EVENT_KEY, "device_id")


def broker_stream(spark: SparkSession, servers: str, topic: str, most: int = 1_000_000, **options: str) -> DataFrame:
    """Events of a Kafka topic, at most ``most`` messages a batch; Spark's Kafka package must be on the session's class path."""
    settings = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(most)} | options
    return message_events(spark.readStream.format("kafka").options(**settings).load())


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).parquet(folder)


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """One event for each key, remembered as long as late copies may come."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(EVENT_KEY)


def quarter_hour_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events, activations and greens by signal and quarter hour."""
    of = lambda c: F.count(F.when(F.col("event_code") == c, 1))
    rows = deduplicated(events, late).groupBy(F.window("event_time", "15 minutes"), "signal_id")
    return rows.agg(F.count("*").alias("event_count"), of(82).alias("activations"), of(1).alias("greens")).select("signal_id", F.col("window.start").alias("bin_start"), "event_count", "activations", "greens")


def append_to_lake(path: str, device_id: int = 1, stream: str | None = None):
    """A foreachBatch sink into an event lake: a micro-batch is one commit.

    ``stream``, a name that stays with the stream's checkpoint, makes a batch that is run again a matter of looking it up; without
    it such a batch adds nothing since its keys are there.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if "device_id" in batch.columns else batch.withColumn("device_id", F.lit(device_id).cast("smallint"))
        write_events(rows, path, stream and f"{stream}-{number}")

    return write


def run_once(frame: DataFrame, checkpoint: str, table: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now into an in-memory table (for tests and back-fills)."""
    query = frame.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(table)
