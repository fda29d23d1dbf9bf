"""The temporal kernel: state carried along an ordered event stream, pairing, cycles, overlaps, bins.

Times are whole microseconds (`t`), so sums and differences are exact and do not depend on order.
Every helper is a column expression over one window, so operators that use the same keys and order
share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def timestamp(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def seconds(t: Column) -> Column:
    return t / F.lit(float(SECOND))


def along(keys: list[str], order: tuple[str, ...] = ("t", "code", "param")):
    """The window of a stream: rows of equal keys by time, then code, then parameter."""
    return Window.partitionBy(*keys).orderBy(*order)


def last(value: Column, window) -> Column:
    """The latest value that is not null, at or before the row."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def previous(value: Column, window) -> Column:
    """The latest value that is not null, before the row."""
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))


def following(value: Column, keys: list[str], order: tuple[str, ...] = ("t", "code", "param"), own: bool = False) -> Column:
    """The first value that is not null, after the row (or, with ``own``, at or after it).

    A running frame along the reversed order: Spark computes a frame that shrinks towards the end anew
    for every row, which takes the square of a group's rows.
    """
    back = Window.partitionBy(*keys).orderBy(*map(F.desc, order))
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0 if own else -1))


def cycle(starts: Column, window) -> Column:
    """The number of starts at or before the row; 0 before the first."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))


def bin_of(t: Column, width: int) -> Column:
    """Floor of a time to a multiple of ``width`` microseconds since the epoch."""
    return F.floor(t / width) * width


def bin_of_hour(t: Column, minutes: int) -> Column:
    """Floor of the minute of the hour to a multiple of ``minutes``; bins start anew each hour."""
    hour = bin_of(t, 60 * MINUTE)
    return hour + F.floor((t - hour) / (minutes * MINUTE)) * (minutes * MINUTE)


def settled(value: Column) -> Column:
    """A mean or deviation of doubles to six digits, so that the order of summing does not show."""
    return F.round(value, 6)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def split_over_bins(rows: DataFrame, begin: str, end: str, origin: Column, width: int) -> DataFrame:
    """One row for each bin that [begin, end) touches: bin (its start) and inside (microseconds in it)."""
    first = F.floor((F.col(begin) - origin) / width)
    final = F.floor((F.col(end) - 1 - origin) / width)
    dealt = rows.where(F.col(end) > F.col(begin)).withColumn("_k", F.explode(F.sequence(first, final)))
    low = origin + F.col("_k") * width
    return dealt.withColumn("bin", low).withColumn("inside", overlap(F.col(begin), F.col(end), low, low + width)).drop("_k")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], time: str = "t") -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` at or before it, null where there is none.

    Both sides go through one window by union, so a long history on either side costs a sort, no range join.
    """
    cols = left.columns
    packed = F.struct(*values)
    one = left.select(*cols, F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_v"), F.lit(1).alias("_side"))
    two = right.select(*[(F.col(c) if c in (*keys, time) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], packed.alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = one.unionByName(two).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(*cols, *[F.col("_v")[v].alias(v) for v in values])
