"""Entities as they were at a time, from the log of their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(audit: DataFrame, live: DataFrame, entity: str, fields: str, at: Column) -> DataFrame:
    """The entities that existed at a time, with their fields then.

    ``audit``: entity id, changed_at, audit_id, operation, new_values (JSON). The latest row at or
    before the time decides; a DELETE removes the entity; entities without any such row come from ``live``.
    """
    seen = audit.where(F.col("changed_at") <= at)
    newest = Window.partitionBy(entity).orderBy(F.desc("changed_at"), F.desc("audit_id"))
    last = seen.withColumn("_k", F.row_number().over(newest)).where("_k = 1")
    values = F.from_json(F.coalesce("new_values", F.lit("{}")), fields)
    names = [f.split()[0] for f in fields.split(", ")]
    rebuilt = last.where("operation != 'DELETE'").select(entity, values.alias("v")).select(entity, *(F.col("v")[n].alias(n) for n in names))
    return rebuilt.unionByName(live.join(last.select(entity), entity, "left_anti").select(entity, *names))
