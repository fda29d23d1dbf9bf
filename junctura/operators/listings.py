"""Listings of a network's configuration and collection: intersections by where they are, pages of their histories, polling checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.sources.derived import Tables

SITE = ("signal_id", "primary_street", "region_id", "corridor_id", "jurisdiction_id", "enabled")
AUDIT = ("audit_id", "signal_id", "changed_at", "changed_by", "operation", "old_values", "new_values")
#: A page has at most so many rows.
PAGE = 100


def _equal(rows: DataFrame, **wanted: str | None) -> DataFrame:
    for name, value in wanted.items():
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return rows


def signal_list(tables: Tables, region_id: str | None = None, corridor_id: str | None = None, jurisdiction_id: str | None = None, enabled_only: bool = True) -> DataFrame:
    """The intersections of a region, corridor and jurisdiction (whichever are given); those that are switched off only if asked for."""
    rows = _equal(tables.sites, region_id=region_id, corridor_id=corridor_id, jurisdiction_id=jurisdiction_id)
    return (rows.where("enabled") if enabled_only else rows).select(*SITE)


def audit_page(tables: Tables, signal_id: str, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of one intersection's history, the latest change first; an unknown intersection has none.

    Spark keeps the page's rows of each partition only.
    """
    known = tables.sites.where(F.col("signal_id") == signal_id).select("signal_id")
    rows = tables.site_audit.where(F.col("signal_id") == signal_id).join(known, "signal_id", "left_semi")
    return rows.select(*AUDIT).orderBy(F.desc("changed_at"), F.desc("audit_id")).offset(skip).limit(limit)


def audit_pages(tables: Tables, skip: int = 0, limit: int = PAGE, **where: str | None) -> DataFrame:
    """The same page of every listed intersection's history at once, with its rows' places from 1.

    A rank below a bound is kept by Spark's group limit before the shuffle, so a long history sends a page from each task.
    """
    latest = Window.partitionBy("signal_id").orderBy(F.desc("changed_at"), F.desc("audit_id"))
    rows = tables.site_audit.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= skip + limit).where(F.col("place") > skip)
    return rows.join(signal_list(tables, enabled_only=False, **where).select("signal_id"), "signal_id", "left_semi").select(*AUDIT, "place")


def changed_fields(audit: DataFrame, fields: str) -> DataFrame:
    """audit_id, signal_id, changed_at, field, old, new: one row for each field that a change touched.

    ``fields``: the names and types of the recorded JSON. Values are compared as text, null and absent are the same; an INSERT has no old values, a DELETE no new ones.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    text = ", ".join(f"{n} string" for n in names)
    old, new = (F.from_json(F.coalesce(c, F.lit("{}")), text) for c in ("old_values", "new_values"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col("_o")[n].alias("old"), F.col("_n")[n].alias("new")) for n in names)))
    rows = audit.withColumn("_o", old).withColumn("_n", new).select("audit_id", "signal_id", "changed_at", each.alias("c"))
    return rows.where("not (c.old <=> c.new)").select("audit_id", "signal_id", "changed_at", "c.field", "c.old", "c.new")


def checkpoint_list(tables: Tables, method: str | None = None, device_type: str | None = None, device_id: str | None = None) -> DataFrame:
    """The polling checkpoints of a method, a kind of device or a device (whichever are given)."""
    return _equal(tables.checkpoints, method=method, device_type=device_type, device_id=device_id)


def checkpoint_health(tables: Tables, now: int | None = None, stale_minutes: int = 60, most_errors: int = 3) -> DataFrame:
    """Checkpoints with what is wrong: "erring" by errors in a row, "ahead" of the clock, "stale" by their last event, else "ok"; a device without an event is stale.

    Times are microseconds; ``now`` is the window's end, if not given.
    """
    now = tables.end if now is None else now
    at: Column = F.unix_micros(F.col("last_event_timestamp").cast("timestamp"))
    late = at.isNull() | (at < now - stale_minutes * 60_000_000)
    state = F.when(F.col("consecutive_errors") >= most_errors, "erring").when(at > now, "ahead").when(late, "stale").otherwise("ok")
    return tables.checkpoints.select("device_type", "device_id", "method", "last_event_timestamp", "consecutive_errors", state.alias("state"))


def signal_list_query(tables: Tables) -> DataFrame:
    """The enabled intersections of one corridor."""
    return signal_list(tables, corridor_id="C-1")


def audit_pages_query(tables: Tables) -> DataFrame:
    """The second page, of five rows, of every intersection."""
    return audit_pages(tables, 5, 5)


def changed_fields_query(tables: Tables) -> DataFrame:
    return changed_fields(tables.site_audit, "priority string, cost string")


def checkpoint_list_query(tables: Tables) -> DataFrame:
    return checkpoint_list(tables, device_type="controller")


def checkpoint_health_query(tables: Tables) -> DataFrame:
    return checkpoint_health(tables, stale_minutes=20, most_errors=2)


ALL = (signal_list_query, audit_pages_query, changed_fields_query, checkpoint_list_query, checkpoint_health_query)
