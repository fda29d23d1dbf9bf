"""Labelled rows to learn from, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5 are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, label: str, most_per_class: int) -> DataFrame:
    """(doc_id, label): of each class the ``most_per_class`` labelled rows first in an order of hashed ids.

    Rows with a null or another label, a null id or in the held-out fold take no part; of an id that
    occurs twice the smaller label counts. The bound makes the result fit for a broadcast.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    )
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [rows.where(F.col("label") == y).orderBy(order, "doc_id").limit(most_per_class) for y in (0, 1)]
    return parts[0].unionAll(parts[1])


def sampled_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled documents, each id once: of several texts the one with the smallest hash.

    The sample is small by its own limit, and so is the result, however often an id is repeated.
    """
    text = F.coalesce("text", F.lit(""))
    met = documents.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
