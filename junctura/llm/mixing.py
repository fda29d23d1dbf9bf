"""Mixing sources to target weights by Pfair scheduling.

Every source's rows, in an order of hashed ids, form blocks of ``block_rows``. Block j of a source
with weight w of W in all may run from slot floor(j W / w) and must have run by slot
ceil((j + 1) W / w); each slot takes, among the blocks that may run, the one with the earliest
deadline (ties: the later release, then the source's place). When a source's last block has run, an
epoch ends: the sources that are left go on in a schedule of their own weights, counted anew. At
every row of an epoch the rows of each of its sources so far thus differ from their share of the
epoch's rows by less than one block. A schedule repeats after W slots, so the pattern of one period
of each epoch is worked out once, from the sources' numbers of rows alone, and every row's slot and
position follow by arithmetic. No row is dropped and no slot stays empty; `in_mix` marks the first
epoch, in which all sources still have rows.

Defined cases: a weight without rows takes no part in the plan; a null source, or one without a target
weight, belongs to the group ``rest``, which has a weight of its own; rows with equal ids follow each
other in the order of their texts' checksums, and equal ones of these in no particular order; weights
must be positive whole numbers; extra columns are not carried by `mix` and all kept by `ordered`.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.ranking import order_key, ranked
from junctura.llm.scratch import free_name, small, stored

REST = "rest"


def pattern(weights: dict[str, int]) -> list[str]:
    """The group that each slot of a period of sum(weights) goes to."""
    total = sum(weights.values())
    names = list(weights)
    given, out = dict.fromkeys(names, 0), []
    for slot in range(total):
        ready = []
        for place, name in enumerate(names):
            j, w = given[name], weights[name]
            if j < w and j * total // w <= slot:
                ready.append((-(-(j + 1) * total // w), -(j * total // w), place, name))
        deadline, _, _, name = min(ready)
        assert deadline > slot, "a deadline was missed"
        given[name] += 1
        out.append(name)
    return out


def epochs(weights: dict[str, int], counts: dict[str, int], block_rows: int) -> list[dict]:
    """Of each group and epoch: its first block there, the epoch's first slot and position, its period, the group's weight and slots in it."""
    blocks = {g: -(-counts[g] // block_rows) for g in weights if counts.get(g)}
    given = dict.fromkeys(blocks, 0)
    plan, slot, position, epoch = [], 0, 0, 0
    while live := [g for g in blocks if given[g] < blocks[g]]:
        unit = math.gcd(*(weights[g] for g in live))
        w = {g: weights[g] // unit for g in live}
        order = pattern(w)
        period, spots = len(order), {g: [s for s, p in enumerate(order) if p == g] for g in live}
        plan += [{"mix_group": g, "epoch": epoch, "from_block": given[g], "first_slot": slot, "first_position": position, "period": period, "weight": w[g], "spots": spots[g]} for g in live]
        ends = {g: (last := blocks[g] - given[g] - 1) // w[g] * period + spots[g][last % w[g]] for g in live}
        done = min(ends, key=ends.get)
        length = ends[done] + 1
        for g in live:
            given[g] += length // period * w[g] + sum(s < length % period for s in spots[g])
        # All blocks of an epoch are full but its last.
        slot, position, epoch = slot + length, position + (length - 1) * block_rows + counts[done] - (blocks[done] - 1) * block_rows, epoch + 1
    return plan


_EPOCH = [(name, pa.int64()) for name in ("from_block", "first_slot", "first_position", "period", "weight")] + [("spots", pa.list_(pa.int64())), ("epoch", pa.int32())]
_PLAN = pa.schema([("mix_group", pa.string()), ("epochs", pa.list_(pa.struct(_EPOCH)))])


def _scheduled(rows: DataFrame, weights: dict[str, int], block_rows: int, bucket_rows: int, **ranks) -> DataFrame:
    """``rows`` (with `mix_group` and `_key`) with slot, position, epoch and in_mix."""
    if any(not isinstance(w, int) or w < 1 for w in weights.values()) or REST not in weights:
        raise ValueError(f"weights must be positive whole numbers, one of them for {REST!r}")
    spark: SparkSession = rows.sparkSession
    counts = {r["mix_group"]: r["n"] for r in rows.groupBy("mix_group").agg(F.count("*").alias("n")).collect()}
    plan: dict[str, list] = {}
    for e in epochs(weights, counts, block_rows):
        plan.setdefault(e["mix_group"], []).append(e)
    # One row a group, with at most as many epochs as there are groups. An Arrow table needs no Python workers to become a DataFrame.
    table = spark.createDataFrame(pa.Table.from_pylist([{"mix_group": g, "epochs": e} for g, e in plan.items()], _PLAN))
    met = ranked(rows, "mix_group", "_rank", bucket_rows, **ranks).join(F.broadcast(table), "mix_group")
    block = F.floor(F.col("_rank") / block_rows)
    own = F.element_at(F.filter("epochs", lambda e: e["from_block"] <= block), -1)
    met = met.withColumn("_block", block).withColumn("_own", own).drop("epochs")
    j = F.col("_block") - F.col("_own.from_block")
    local = F.floor(j / F.col("_own.weight")) * F.col("_own.period") + F.element_at("_own.spots", (j % F.col("_own.weight") + 1).cast("int"))
    met = met.withColumn("_local", local.cast("long"))
    met = met.withColumn("slot", F.col("_own.first_slot") + F.col("_local")).withColumn("position", F.col("_own.first_position") + F.col("_local") * block_rows + F.col("_rank") % block_rows)
    return met.withColumn("epoch", F.col("_own.epoch")).withColumn("in_mix", F.col("epoch") == 0).drop("_rank", "_block", "_own", "_local")


def _group(source: Column, weights: dict[str, int]) -> Column:
    return F.when(source.isin([k for k in weights if k != REST]), source).otherwise(F.lit(REST))


def mix(documents: DataFrame, weights: dict[str, int], block_rows: int = 16, bucket_rows: int = 4_000) -> DataFrame:
    """doc_id, text_crc32, mix_group, slot, position, epoch, in_mix of every row; `position` runs gapless from 0."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    rows = documents.select("doc_id", crc.alias("text_crc32"), _group(F.col("source"), weights).alias("mix_group"), F.monotonically_increasing_id().alias("_tie"))
    rows = stored(rows, "mixing").withColumn("_key", order_key(F.col("doc_id"), F.col("text_crc32"), F.col("_tie"))).drop("_tie")
    return _scheduled(rows, weights, block_rows, bucket_rows).select("doc_id", "text_crc32", "mix_group", "slot", "position", "epoch", "in_mix")


#: Production weights: the large source src0 counts as three of the others.
WEIGHTS = {f"src{k}": 3 if k == 0 else 1 for k in range(20)} | {REST: 1}


def standing(documents: DataFrame) -> tuple[Column, Column] | None:
    """File and row of each row of a table as it is read; None for rows that come from no files."""
    try:
        documents.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018 - resolves the names
    except AnalysisException:
        return None
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def ordered(documents: DataFrame, weights: dict[str, int] = WEIGHTS, block_rows: int = 16, bucket_rows: int = 4_000, part_rows: int = 20_000) -> DataFrame:
    """``documents``, with no other columns, in the order of the mix: files and rows within them ascend.

    Whole rows move twice: to their bucket, where their rank is found, and to their place. Positions
    are gapless, so that place is known by arithmetic, without sampling. Rows equal in id and in all
    columns are interchangeable and told apart by where they stand, so many copies of a row are spread too. ``documents`` are read
    more than once and must be the same each time. Once written, the order is that of the files' numbers and of the rows in
    them, which `positions` reads; Spark itself reads files in any order.
    """
    names = documents.columns
    row, place = free_name(documents, "_row"), standing(documents)
    key = order_key(F.col("doc_id"), F.lit(0), F.xxhash64(*names))
    if place:
        key = F.concat(key, F.lpad(F.lower(F.hex(F.xxhash64(*place))), 16, "0"))
    narrow = documents.select(F.struct(*names).alias(row), _group(F.col("source"), weights).alias("mix_group"), key.alias("_key"))
    placed = _scheduled(narrow, weights, block_rows, bucket_rows, levels=(32, 40, 56) if place else (32, 40))
    parts = max(1, -(-documents.count() // part_rows))
    return placed.repartitionById(parts, F.floor(F.col("position") / part_rows).cast("int")).sortWithinPartitions("position").select(f"{row}.*")


def positions(documents: DataFrame, name: str = "position") -> DataFrame:
    """``documents`` with the place of each row, from 0, in the order in which the table was written.

    That is the order of the numbers in the files' names, then of the rows in a file. Rows that come from no files have null.
    """
    place = standing(documents)
    if not place:
        return documents.withColumn(name, F.lit(None).cast("long"))
    file, row = free_name(documents, "_file"), free_name(documents, "_at")
    number = lambda mark: F.regexp_extract(F.element_at(F.split(file, "/"), -1), mark, 1).try_cast("long")
    sizes = documents.select(place[0].alias(file)).groupBy(file).agg(F.count("*").alias("_size"))
    before = Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)"), file).rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    first = stored(sizes.select(F.col(file).alias("_name"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first")), "files")
    rows = documents.select("*", place[0].alias(file), place[1].alias(row))
    met = rows.join(small(first), F.col(file) == F.col("_name"))
    return met.withColumn(name, F.col("_first") + F.col(row)).drop(file, row, "_name", "_first")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS).drop("text_crc32")


def reference_sql(weights: dict[str, int] = WEIGHTS, block_rows: int = 16) -> str:
    """The same rows in SQL: each slot in turn goes to the ready block with the earliest deadline, over the real numbers of blocks."""
    named = ", ".join(f"'{g}'" for g in weights if g != REST)
    listed = ", ".join(f"({k}, '{g}', {w})" for k, (g, w) in enumerate(weights.items(), 1))
    live, of_live = "done[i] < n[i]", "list_sum([w[i] for i in range(1, len(w) + 1) if base[i] < n[i]])"
    release = "(done[i] - base[i]) * total // w[i]"
    deadline = "((done[i] - base[i] + 1) * total + w[i] - 1) // w[i]"
    return f"""
WITH RECURSIVE weights(k, mix_group, w) AS (VALUES {listed}),
r AS (SELECT doc_id, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS mix_group, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
ranks AS (SELECT *, row_number() OVER (PARTITION BY mix_group ORDER BY o) - 1 AS rk FROM r),
c AS (SELECT k, any_value(weights.mix_group) AS mix_group, any_value(w) AS w, (count(doc_id) + {block_rows - 1}) // {block_rows} AS n FROM weights LEFT JOIN r USING (mix_group) GROUP BY k),
given AS (SELECT list(CAST(w AS BIGINT) ORDER BY k) AS w, list(n ORDER BY k) AS n FROM c),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start, 0 AS epoch, 0 AS at_epoch, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS block, [CAST(0 AS BIGINT) for x in n] AS done, [CAST(0 AS BIGINT) for x in n] AS base, w, n FROM given
  UNION ALL
  SELECT slot + 1, CASE WHEN over THEN slot + 2 ELSE start END, CASE WHEN over THEN epoch + 1 ELSE epoch END, epoch, best, done[best], after, CASE WHEN over THEN after ELSE base END, w, n
  FROM (SELECT *, [CASE WHEN i = best THEN done[i] + 1 ELSE done[i] END for i in range(1, len(n) + 1)] AS after, done[best] + 1 = n[best] AS over
    FROM (SELECT *, list_sort([{{'d': {deadline}, 'r': -({release}), 'i': i}} for i in range(1, len(n) + 1) if {live} AND {release} <= slot + 1 - start])[1].i AS best
      FROM (SELECT *, CAST({of_live} AS BIGINT) AS total FROM run WHERE list_sum(done) < list_sum(n))))),
slots AS (SELECT slot, at_epoch AS epoch, block, mix_group FROM run JOIN weights ON who = k)
SELECT doc_id, CAST(mix_group AS VARCHAR) AS mix_group, slot, row_number() OVER (ORDER BY slot, rk) - 1 AS position, epoch, epoch = 0 AS in_mix
FROM ranks JOIN slots USING (mix_group) WHERE rk // {block_rows} = block"""
