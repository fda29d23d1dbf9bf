"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives each distinct vector a string of 32 bits: the sides of 32 random hyperplanes through
the mean of a sample. A query descends each tree to the entries that share the longest prefix with
its string, and all trees ascend together, one bit at a time, until the entries reached, summed over
the trees, are ``share`` of the index and ``least`` a tree. Counts of the strings by prefix settle that level for every
query beforehand; then the trees' strings are dealt out by their first bits (long runs in parts), and
each task keeps its part as a sorted array, in which the entries with the query's prefix are one
slice. Exact Euclidean distances on the original vectors rank them; each task gives up the few
nearest of its part only.

``share`` sets the recall. Where nearest neighbours are hardly nearer than other vectors, as in
unstructured data, prefixes tell little and recall of 0.9 takes a share of 0.75 to 1 (0.4 to 0.6 of
the index once entries reached by several trees count once); clustered vectors do with far less.

Equal vectors form one entry, and the smallest ids of each stand for all, as no others can be among
the nearest.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors of another length than the most frequent one; a query with fewer candidates than asked for
returns all that were found; ties go to the smaller id; an id with several vectors is one candidate, found at its
nearest, and one query, that asks with each of them (only where vectors stand each for several ids in common can
fewer than ``k`` ids come back); an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm import blocks
from junctura.llm.scratch import stored

BITS = 32
#: Levels that the ascent tells apart; it starts here.
_DEEPEST = 12


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(ok)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def entries(rows: DataFrame, most_ids: int, salts: int = 64) -> DataFrame:
    """(entry, first, alone, v, ids): each distinct vector with its ``most_ids`` smallest ids; salted, so a frequent vector is no single task's.

    ``entry`` is a number of the vector's own, good once the rows are stored; an id with several vectors is in several entries.
    ``first`` is the smallest id, ``alone`` says that there is no other.
    """
    key = rows.withColumn("hash", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    first = Window.partitionBy("hash", "v", "salt").orderBy("vec_id")
    few = key.dropDuplicates(["hash", "v", "vec_id"]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= most_ids)
    grouped = few.groupBy("hash", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kept = grouped.select("v", F.slice("ids", 1, most_ids).alias("ids"))
    return kept.select(F.monotonically_increasing_id().alias("entry"), F.col("ids")[0].alias("first"), (F.size("ids") == 1).alias("alone"), "v", "ids")


def _strings(planes: np.ndarray, centre: np.ndarray):
    """(entry, strings) with one string a tree."""
    trees = len(planes) // BITS
    place = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                x = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) - centre
                side = (x @ planes.T > 0).reshape(rows.num_rows, trees, BITS)
                strings = (side * place).sum(2, dtype=np.uint64).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * trees), pa.array(strings.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("entry"), rows.column("query"), lists], ["entry", "query", "strings"])

    return run


def _ranked(k: int):
    """Of each query in a part of a tree, its ``k`` nearest among the entries that share its prefix."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("level").to_numpy() >= 0
        entry, string, level, first = (table.column(c).to_numpy() for c in ("entry", "string", "level", "first"))
        alone = table.column("alone").to_numpy(zero_copy_only=False)
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(entry), -1)
        held = np.flatnonzero(~asked)
        held = held[np.lexsort((entry[held], string[held]))]
        # Further vectors of an id that has nothing else to offer only take the places of other ids.
        shared = len(np.unique(first[held[alone[held]]])) < np.count_nonzero(alone[held])
        strings, vectors = string[held], x[held]
        squares = (vectors**2).sum(1)
        out = ([], [], [], [], [])
        for q in np.flatnonzero(asked):
            free = BITS - int(level[q])
            low = string[q] >> free << free
            part = slice(np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << free)))
            rough = squares[part] - 2 * (vectors[part] @ x[q])
            if not len(rough):
                continue
            near = np.arange(len(rough))
            if len(rough) > k and not shared:
                near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + np.abs(rough).max()))
            score = np.sqrt(((vectors[part][near] - x[q]) ** 2).sum(1))
            at = held[part][near]
            order = np.lexsort((entry[at], first[at], score))
            if shared:
                one = np.where(alone[at[order]], first[at[order]], -1 - np.arange(len(order)))
                named = alone[at[order]]
                keep = ~named
                keep[np.flatnonzero(named)[np.unique(one[named], return_index=True)[1]]] = True
                order = order[keep]
            best = order[:k]
            for o, v in zip(out, (np.full(len(best), entry[q]), entry[at[best]], score[best], first[at[best]], alone[at[best]]), strict=True):
                o.append(v)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query": cat(out[0], np.int64), "entry": cat(out[1], np.int64), "score": cat(out[2], np.float64), "first": cat(out[3], np.int64), "alone": cat(out[4], bool)})

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 24, share: float = 1.0, least: int = 64, part_rows: int = 16_384, ask_rows: int = 4_096, column: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = stored(usable(vectors, column), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).select("v", F.col("vec_id").alias("query_id")).distinct()
    index = stored(entries(rows, k + 1).join(asking.select("v").distinct().withColumn("query", F.lit(True)), "v", "left").withColumn("query", F.coalesce("query", F.lit(False))), "entries")
    sample = index.orderBy(F.xxhash64("v")).limit(2000).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)
    planes = np.random.default_rng(seed).normal(size=(trees * BITS, x.shape[1]))
    hashed = stored(index.select("entry", "query", "v").mapInArrow(blocks.released(_strings(planes, x.mean(0))), "entry long, query boolean, strings array<long>"), "strings")
    # Synchronous ascent: counts by prefix, from long to short; a query stops where the trees together reach the share.
    flat = hashed.select("entry", "query", F.posexplode("strings").alias("tree", "string"))
    prefix = lambda level: F.shiftright("string", BITS - level)
    counts = flat.groupBy("tree", prefix(_DEEPEST).alias("prefix")).agg(F.count("*").alias("n"))
    levels = counts.select("tree", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(_DEEPEST)), lambda x: F.call_function("shiftright", F.col("prefix"), (F.lit(_DEEPEST) - x).cast("int")))).alias("level", "prefix"))
    levels = levels.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))
    reached = flat.where("query").select("entry", "tree", F.posexplode(F.array(*(prefix(x) for x in range(_DEEPEST + 1)))).alias("level", "prefix"))
    total = index.count()
    need = min(max(share * total, trees * least), trees * (total - 1))
    stops = reached.join(levels, ["tree", "level", "prefix"]).groupBy("entry", "level").agg(F.sum(F.col("n") - 1).alias("n")).where(F.col("n") >= need)
    stops = stored(stops.groupBy("entry").agg(F.max("level").alias("level")), "levels")
    top = stops.agg(F.min("level")).first()[0] or 0
    # Parts: the entries of a tree with equal first bits; long runs are dealt out by entry, and many queries in blocks,
    # so that a task holds at most part_rows entries and ask_rows queries (about, as both go by hash).
    blocks_of = F.greatest(F.ceil(F.count(F.when(F.col("query"), 1)) / ask_rows), F.lit(1))
    cells = flat.groupBy("tree", prefix(top).alias("cell")).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), blocks_of.cast("int").alias("blocks"))
    placed = flat.withColumn("cell", prefix(top)).join(F.broadcast(cells), ["tree", "cell"])  # trees * 2**top cells
    held = placed.select("tree", "cell", F.pmod(F.xxhash64("entry"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "entry", "string", F.lit(-1).alias("level"))
    ask_block = F.pmod(F.xxhash64("entry", F.lit(3)), "blocks").cast("int")
    asks = placed.where("query").join(stops, "entry").select("tree", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), ask_block.alias("block"), "entry", "string", "level")
    met = held.unionByName(asks).join(index.select("entry", "first", "alone", F.col("v").cast(vectors.schema[column].dataType).alias("v")), "entry")
    found = met.groupBy("tree", "cell", "part", "block").applyInArrow(_ranked(k + 1), "query long, entry long, score double, first long, alone boolean")
    # Of an id's vectors that stand for it alone the nearest, of the others each.
    one = [F.when(F.col("alone"), F.col("first")).alias("id"), F.when(~F.col("alone"), F.col("entry")).alias("several")]
    best = found.groupBy("query", *one).agg(F.min(F.struct("score", "first", "entry")).alias("b")).select("query", "b.score", "b.first", "b.entry")
    near = Window.partitionBy("query").orderBy("score", "first", "entry")
    best = best.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    asked = index.where("query").select("v", F.col("entry").alias("query")).join(asking, "v").select("query", "query_id")
    pairs = best.join(asked, "query").join(index.select("entry", "ids"), "entry").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_prefix_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
