"""Log files that land in a folder: which are new, have grown, were renamed or written anew, and what became of each.

A table of the files seen (path, length, time, digest, outcome) is the state. A run lists names and sizes only, opens the files that differ,
and compares digests: a file that grew begins with what was read before, one that was renamed is whole what another was. Events
go into the lake by key, so a file that grew adds what is new. A file that no decoder reads is kept with its error and
is tried again when it changes. The fingerprint of the changed files names the commit, so a run that died is completed by the next and adds nothing twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.commits import commit, committed
from junctura.sources.decoders import decode_files
from junctura.sources.lake import write_events

FILES = "path string, length long, modified timestamp, digest string, change string, events long, error string, bucket int"
_BUCKETS = 16


def files_seen(spark: SparkSession, state: str) -> DataFrame:
    """The state: one row a path."""
    found = committed(spark, state, FILES)
    return spark.createDataFrame([], FILES) if found is None else found


def failed(spark: SparkSession, state: str) -> DataFrame:
    """The files that no decoder could read, with their errors."""
    return files_seen(spark, state).where("error is not null").select("path", "length", "modified", "error")


def _reader(spark: SparkSession, pattern: str):
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)


def changed(spark: SparkSession, folder: str, state: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files that are not as they were seen; no contents are read."""
    listed = _reader(spark, pattern).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    seen = files_seen(spark, state).select("path", "length", "modified")
    return listed.join(seen, ["path", "length", "modified"], "left_anti")


def ingest(spark: SparkSession, folder: str, state: str, lake: str, kind: str = "auto", pattern: str = "*", device_id: int = 1, most_files: int = 10_000) -> dict[str, int]:
    """Take in the files that changed, the oldest ``most_files`` of them in one run; returns their number by kind of change, "failed" among them.

    The driver holds the names of one run's files. The rest is for the next run.
    """
    todo = changed(spark, folder, state, pattern).orderBy("modified", "path").limit(most_files).collect()
    if not todo:
        return {}
    batch = hashlib.sha256(repr([tuple(r) for r in todo]).encode()).hexdigest()
    opened = _reader(spark, pattern).load([r.path for r in todo])
    seen = files_seen(spark, state)
    before = seen.select("path", F.col("length").alias("was_length"), F.col("digest").alias("was"), F.col("error").alias("was_error"))
    others = seen.where("error is null").groupBy("digest").agg(F.min("path").alias("other"))
    digest = F.sha2("content", 256)
    files = opened.select("path", "length", F.col("modificationTime").alias("modified"), "content", digest.alias("digest")).join(before, "path", "left").join(others, "digest", "left")
    grown = (F.col("length") > F.col("was_length")) & (F.sha2(F.substring("content", F.lit(1), F.col("was_length").cast("int")), 256) == F.col("was"))
    change = F.when(F.col("was") == F.col("digest"), "touched").when(F.col("was").isNull() & F.col("other").isNotNull(), "renamed").when(F.col("was").isNull(), "new").when(grown, "grown").otherwise("rewritten")
    files = files.withColumn("change", change)
    decoded = decode_files(files.where("change not in ('touched', 'renamed')"), kind)
    good = decoded.where("error is null and event_time is not null").select("signal_id", "event_time", "event_code", "event_param", F.lit(device_id).cast("smallint").alias("device_id"))
    write_events(good, lake, batch)
    outcome = decoded.groupBy("path").agg(F.count("event_time").alias("events"), F.max("error").alias("error"))
    rows = files.drop("content").join(outcome, "path", "left").withColumn("error", F.when(F.col("change") == "touched", F.col("was_error")).otherwise(F.col("error")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(_BUCKETS)).cast("int")).select("path", "length", "modified", "digest", "change", F.coalesce("events", F.lit(0)).alias("events"), "error", "bucket")
    commit(rows, state, ["path"], ["bucket"], batch, replace=True)
    done = files_seen(spark, state).join(F.broadcast(spark.createDataFrame([(r.path,) for r in todo], "path string")), "path")
    return {r.what: r.n for r in done.groupBy(F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("change")).alias("what")).agg(F.count("*").alias("n")).collect()}
