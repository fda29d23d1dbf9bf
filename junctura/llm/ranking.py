"""Gapless ranks inside groups of any size, without bringing a group into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.scratch import stored

#: Hex digits of the parts of an order key: md5 of the id, checksum, tie.
_LEVELS = (32, 40)


def order_key(doc_id: Column, checksum: Column, tie: Column) -> Column:
    """Hex digits by which rows are put in order: the id's md5 (of a null id, that of nothing), the checksum, a hash of ``tie``."""
    md5 = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.concat(md5, F.lpad(F.lower(F.hex(checksum.cast("long"))), 8, "0"), F.lpad(F.lower(F.hex(F.xxhash64(tie))), 16, "0"))


def _digits(rows: int, bucket_rows: int) -> int:
    return min(8, max(0, math.ceil(math.log(max(1.0, rows / bucket_rows), 16))))


def ranked(rows: DataFrame, group: str, name: str, bucket_rows: int = 4_000, levels: tuple[int, ...] = _LEVELS) -> DataFrame:
    """``rows`` with a long ``name``: 0, 1, 2, ... inside each value of ``group`` (never null), by the column ``_key``, which goes.

    A bucket is a prefix of the key. Hashes are even, so buckets of different ids have about
    ``bucket_rows`` rows. Where many rows share an id, and a bucket thus has over four times as many,
    its rows are told apart by further digits, from the places in ``levels`` on: of the checksum, then of the tie. Only
    rows equal in all of these stay together. A bucket's first rank is the sum of the sizes before it, over the table of bucket
    sizes; within a bucket rows are numbered. ``rows`` are read more than once and must be the same each time.
    """
    most = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bucket: Column = F.substring("_key", 1, _digits(most, bucket_rows))
    cut = rows.withColumn("_bucket", bucket)
    for level in (*levels, None):
        sizes = stored(cut.groupBy(group, "_bucket").agg(F.count("*").alias("_size")), "sizes")
        hot = sizes.where(F.col("_size") > 4 * bucket_rows).select(F.col(group).alias("_hot_group"), F.col("_bucket").alias("_hot"), "_size")
        n_hot, largest = hot.agg(F.count("*"), F.max("_size")).first()
        if not n_hot or level is None:
            break
        hot = hot.drop("_size")
        side = F.broadcast(hot) if n_hot <= 100_000 else hot
        met = cut.join(side, (F.col(group) == F.col("_hot_group")) & (F.col("_bucket") == F.col("_hot")), "left")
        finer = F.substring("_key", 1, level + _digits(largest, bucket_rows))
        cut = met.withColumn("_bucket", F.when(F.col("_hot").isNotNull(), finer).otherwise(F.col("_bucket"))).drop("_hot", "_hot_group")
    # Prefixes of which none begins another come in the order of the keys.
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_place"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    numbered = cut.withColumn("_inside", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_key")) - 1)
    met = numbered.join(first, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_place")))
    return met.withColumn(name, (F.col("_first") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_group", "_place", "_first", "_key")
