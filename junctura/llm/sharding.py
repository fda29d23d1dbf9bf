"""K-d tree sharding by bytes.

The rows' metadata (source, language, length, text checksum, id) become whole-number coordinates;
of a checksum or name the upper 16 bits of its crc32 serve.
A node that is to give k shards is split along its widest coordinate, extents being measured against
those of all rows, at the place where the bytes before it come nearest to floor(k / 2) / k of the
node's; the halves are split in turn until every leaf is one shard of the target bytes. The weighted
median is exact: histograms of equal cells over the node's range, summed by Spark for all nodes of a
level at once, close in on the single value where the target falls, and rows equal there are cut by
id, then by checksum, then by a number that each row is given. Only cell sums reach the driver, at most
``cells`` at a time (256 a node at least). Slots follow the hashes of ids, so a shard's rows are numbered
in even buckets whatever the ids.

Law: `bytes`. Each cut misses its target by at most half a row, so shards differ by less than two of
the largest rows. Equal texts are rows like any others: they have equal sizes and checksums, but may
fall into different shards.

Defined cases: a null text has no bytes and the checksum of an empty text; null coordinates count as
-1; a run of rows equal in all coordinates, however long, is cut where the target falls; with fewer rows
than shards some shards are empty; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.ranking import order_key, ranked
from junctura.llm.scratch import free, stored

AXES = ("source", "lang", "length", "crc", "id")
_TIES = ("id", "crc", "tie")


@dataclass
class Node:
    shards: int
    first: int


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every row, without the text."""
    names = documents.columns
    text = F.col("text").cast("binary")
    of = lambda c: (F.coalesce(F.shiftright(F.crc32(F.col(c).cast("string").cast("binary")), 16), F.lit(-1)) if c in names else F.lit(-1)).cast("long")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    return documents.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), of("source").alias("source"), of("lang").alias("lang"),
        size.alias("length"), F.shiftright(crc, 16).alias("crc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.monotonically_increasing_id().alias("tie"),
    )


def _closing_in(rows: DataFrame, aims: dict[int, dict], cells: int) -> dict[int, tuple[int, int, int, int]]:
    """For each node the value on its axis at which the running bytes reach its target, the bytes before it, its own bytes and rows.

    ``aims``: node -> axis (a column), condition, low, high, target.
    """
    found = {}
    open_ = {n: dict(a, before=0) for n, a in aims.items()}
    while open_:
        cell, width_of, each = F.lit(None).cast("long"), {}, max(256, cells // len(open_))
        for n, a in open_.items():
            width = width_of[n] = max(1, -(-(a["high"] - a["low"] + 1) // each))
            inside = (F.col("node") == n) & a["condition"] & F.col(a["axis"]).between(a["low"], a["high"])
            cell = F.when(inside, F.floor((F.col(a["axis"]) - F.lit(a["low"])) / width).cast("long")).otherwise(cell)
        sums: dict[int, list] = {}
        for r in rows.select("node", cell.alias("cell"), "size").where("cell is not null").groupBy("node", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
            sums.setdefault(r["node"], []).append((r["cell"], r["bytes"], r["rows"]))
        for n, a in list(open_.items()):
            before, at = a["before"], sorted(sums[n])
            for c, b, k in at:
                if before + b >= a["target"] or c == at[-1][0]:
                    break
                before += b
            low = a["low"] + c * width_of[n]
            if width_of[n] == 1:
                found[n] = (low, before, b, k)
                del open_[n]
            else:
                open_[n] |= {"low": low, "high": min(a["high"], low + width_of[n] - 1), "before": before}
    return found


def shards(documents: DataFrame, n_shards: int = 24, cells: int = 1 << 16, bucket_rows: int = 4_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stored(metadata(documents), "metadata")
    nodes: dict[int, Node] = {0: Node(n_shards, 0)}
    whole = rows.agg(*(f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("low", F.min), ("high", F.max)))).first()
    spread = {a: max(1, (whole[f"high_{a}"] or 0) - (whole[f"low_{a}"] or 0)) for a in AXES}
    node: Column = F.lit(0)
    while any(n.shards > 1 for n in nodes.values()):
        now = rows.withColumn("node", node)
        splitting = {k: n for k, n in nodes.items() if n.shards > 1}
        stats = now.where(F.col("node").isin(list(splitting))).groupBy("node").agg(F.sum("size").alias("bytes"), *(f(a).alias(f"{k}_{a}") for a in (*AXES, "tie") for k, f in (("low", F.min), ("high", F.max)))).collect()
        aims: dict[int, dict] = {}
        for r in stats:
            axis = max(AXES, key=lambda a, r=r: (r[f"high_{a}"] - r[f"low_{a}"]) / spread[a])
            k = splitting[r["node"]].shards
            aims[r["node"]] = {"axis": axis, "condition": F.lit(True), "low": r[f"low_{axis}"], "high": r[f"high_{axis}"], "target": r["bytes"] * (k // 2) / k}
        # Rows equal on the axis are cut by id, checksum and number, unless there is only one.
        cuts: dict[int, list] = {n: [] for n in aims}
        goes_left, ends = {}, {r["node"]: r for r in stats}
        while aims:
            for n, (value, before, size, count) in _closing_in(now, aims, cells).items():
                a = aims.pop(n)
                cuts[n].append((a["axis"], value))
                rest = [t for t in _TIES if t not in [c[0] for c in cuts[n]]]
                if count > 1 and rest:
                    aims[n] = {"axis": rest[0], "condition": a["condition"] & (F.col(a["axis"]) == value), "low": ends[n][f"low_{rest[0]}"], "high": ends[n][f"high_{rest[0]}"], "target": a["target"] - before}
                else:  # the rows at the cut itself go left if that comes nearer to the target
                    goes_left[n] = a["target"] - before > size / 2
        split = F.lit(None).cast("int")
        for n, old in splitting.items():
            low, high = 2 * n + 1, 2 * n + 2
            left = F.lit(True)
            if n in cuts:
                left = F.lit(goes_left[n])
                for axis, value in reversed(cuts[n]):
                    left = (F.col(axis) < value) | ((F.col(axis) == value) & left)
            split = F.when(node == n, F.when(left, low).otherwise(high)).otherwise(split)
            del nodes[n]
            nodes[low], nodes[high] = Node(old.shards // 2, old.first), Node(old.shards - old.shards // 2, old.first + old.shards // 2)
        # A level's result is written, so that later levels need not replay its conditions.
        last, rows = rows, stored(rows.withColumn("_next", F.coalesce(split, node)).drop("_node").withColumnRenamed("_next", "_node"), "nodes")
        free(last)
        node = F.col("_node")
    shard = F.create_map(*(F.lit(v) for k, n in nodes.items() for v in (k, n.first)))[node].cast("int")
    key = order_key(F.col("doc_id"), F.col("text_crc32"), F.col("tie"))
    placed = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"), key.alias("_key"))
    return ranked(placed, "shard", "slot", bucket_rows).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole documents into one folder for each shard, in the order of their slots (ids must be unique)."""
    by_id = documents.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    by_id.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_kd_shards(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
