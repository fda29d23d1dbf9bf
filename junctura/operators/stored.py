"""Reports from stored cycle tables where these have been built, from the log where not.

``store`` holds the tables, by date, and a coverage table of the spans built. A report over a window takes stored rows for the covered
parts and computes the others from the log, which it reads for these parts only and as far around them as a cycle reaches. Rows
belong to a part by their own time, so parts meet without gap or overlap, and the result is that of the log alone.

A span is built again as a whole: rows that late events have changed or undone are replaced. Spans are half open. Configuration
with a history is that of each part's start.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions.temporal import micros, timestamp
from junctura.operators import aggregates, scans
from junctura.sources.commits import commit, committed
from junctura.sources.derived import Tables

Span = tuple[int, int]
#: Table, the column of a row's own time, and the key.
TABLES: dict[str, tuple[Callable[[Tables], DataFrame], str, list[str]]] = {
    "cycle_boundary": (aggregates.cycle_boundary, "green_start", ["signal_id", "phase", "green_start"]),
    "cycle_detector_arrival": (aggregates.cycle_detector_arrival, "arrival_time", ["signal_id", "phase", "channel", "arrival_time"]),
    "cycle_summary_15min": (aggregates.cycle_summary_15min, "bin_start", ["signal_id", "phase", "bin_start"]),
}
_COVERAGE = "start long, finish long, name string"
_WIDE = aggregates.QUARTER


def from_log(tables: Tables, name: str, start: int, finish: int) -> DataFrame:
    """The table's rows of [start, finish), from the log of that span and what cycles reach into or out of it."""
    operator, time, _ = TABLES[name]
    t = micros(F.col(time))
    return operator(tables.over(start - aggregates.REACH, finish + aggregates.REACH)).where((t >= start) & (t < finish))


def build(tables: Tables, store: str, name: str, start: int, finish: int) -> None:
    """Store a span of a table, whole quarter hours, and then say that it is covered."""
    if start % _WIDE or finish % _WIDE or start >= finish:
        raise ValueError("a span begins and ends with a quarter hour")
    _, time, key = TABLES[name]
    t = micros(F.col(time))
    rows = from_log(tables, name, start, finish).withColumn("bin_date", F.to_date(time))
    commit(rows, f"{store}/{name}", key, ["bin_date"], replace=True, gone=(t >= start) & (t < finish))
    span = tables.spark.createDataFrame([(start, finish, name)], _COVERAGE)
    commit(span, f"{store}/coverage", ["name", "start", "finish"], ["name"])


def covered(spark: SparkSession, store: str, name: str, start: int, end: int) -> list[Span]:
    """The parts of [start, end) that have been built, in order and apart from each other."""
    known = committed(spark, f"{store}/coverage", _COVERAGE, lambda part: part == f"name={name}")
    spans = [] if known is None else known.where((F.col("finish") > start) & (F.col("start") < end)).select("start", "finish").distinct().orderBy("start").collect()
    out: list[Span] = []
    for a, b in ((max(s["start"], start), min(s["finish"], end)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def gaps(parts: list[Span], start: int, end: int) -> list[Span]:
    """What is left of [start, end)."""
    edges = [start, *(t for part in parts for t in part), end]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def rows(tables: Tables, store: str, name: str) -> DataFrame:
    """The table over the window of ``tables``: stored parts and those from the log."""
    start, end, (_, time, _) = tables.start, tables.end + 1, TABLES[name]
    parts, t = covered(tables.spark, store, name, start, end), micros(F.col(time))
    found = []
    if parts:
        dates = [(str(d0), str(d1)) for d0, d1 in ((_day(a), _day(b - 1)) for a, b in parts)]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name][0](tables).schema.fields)
        stored = committed(tables.spark, f"{store}/{name}", schema + ", bin_date date", lambda part: any(a <= part.removeprefix("bin_date=") <= b for a, b in dates))
        if stored is not None:
            inside = reduce(lambda x, y: x | y, ((t >= a) & (t < b) for a, b in parts))
            found.append(tables.of_chosen(stored.where(inside).drop("bin_date")))
    found += [from_log(tables, name, a, b) for a, b in gaps(parts, start, end)]
    return reduce(DataFrame.unionByName, found)


def _day(t: int):
    from junctura.sources.lake_tables import moment

    return moment(t).date()


def purdue_diagram(tables: Tables, store: str) -> DataFrame:
    return scans.purdue_from_cycles(rows(tables, store, "cycle_boundary"), tables.start, tables.end + 1)


def phase_termination(tables: Tables, store: str, minutes: int = 15) -> DataFrame:
    return scans.terminations_from_cycles(rows(tables, store, "cycle_boundary"), tables.start, tables.end + 1, minutes)


def arrivals_on_green(tables: Tables, store: str) -> DataFrame:
    return scans.arrivals_on_green_from_summaries(rows(tables, store, "cycle_summary_15min"), tables.start, tables.end + 1)
