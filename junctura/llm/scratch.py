"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_FOLDERS: dict[str, object] = {}
_TABLES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, the warehouse, which executors share too."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/junctura-{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = spark
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone already; the shared folder's own clean-up takes over
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later reads need no lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _TABLES.append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch = path  # noqa: SLF001 - names the table for `free`
    return read


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, before the driver ends; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _TABLES:
            _TABLES.remove(path)
            _delete(table.sparkSession, path)


def mark() -> int:
    """The number of tables stored so far, for `free_since`."""
    return len(_TABLES)


def free_since(start: int, kept: DataFrame) -> None:
    """Delete the tables stored after the mark but for ``kept``, which was made from them."""
    for path in [p for p in _TABLES[start:] if p != kept._scratch]:  # noqa: SLF001
        _TABLES.remove(path)
        _delete(kept.sparkSession, path)


#: Rows up to which a counted table of a few numbers is broadcast.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A stored table, broadcast where its count says that it is small; a hot key then stays spread over its rows' tasks."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
