"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct shingles of ``width`` lower-cased words (the whole sequence as
one where there are fewer words). Each shingle's hash names a register and a place in it; a register
keeps, of the smallest place, the number of leading zeros and ten mantissa bits. An empty register takes
the value of the first one in use along an order of all registers that is its own, so that each agrees
with the same probability, however small the sets. Bands of five registers propose.

1. Equal sets (by two 64-bit sums over the set and its size) form a class; one member stands for it.
2. In every band, classes with equal registers share a bucket. Its leader is the member whose buckets
   are largest altogether. All members of a leader's buckets form its cluster, so two documents that
   share a bucket share a cluster; memberships, not pairs, are what is shuffled.
3. A cluster is dealt out in parts of bounded size, the leader's text being copied to each. Inside,
   members are linked to the leader; members still apart are compared with each other: the Jaccard
   similarity estimated from the registers, corrected for chance collisions, rules out pairs that lie
   five deviations below the bar, the deviation being that of the registers in use (for sets of up to
   about forty shingles it rules out little or nothing); full sets confirm the others.
4. Where a cluster has several parts, members that are still apart from its largest component meet
   the members of the other parts in blocks.
5. Components of the confirmed links give each document the smallest id reachable.

No bucket, cluster or part is capped: larger ones have more parts. Pairs inside one component are not
compared again, as they cannot change the result. A pair at exactly 0.8 shares no band with
probability (1 - 0.8**5)**32 = 3e-6, and less above; for sets of four or five shingles, of which two may
fall into one register, with 2e-5 (2 of 100,000 such pairs, measured). What the texts of a wide cluster take in step 4 grows with
(members) x (members apart) / ``part_rows``.

Defined cases: a null text counts as empty; empty sets link with nothing; rows with one doc_id count
as one document; rows with a null doc_id are kept, link with nothing and have a null component;
extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm import blocks
from junctura.llm.graph import components
from junctura.llm.scratch import free_name, small, stored

REGISTERS, BAND = 160, 5
BANDS = REGISTERS // BAND
_EMPTY = 0xFFFF
#: _PLACE[k, c]: the k-th register that register c takes its value from, if it is empty itself.
_PLACE = np.random.default_rng(7).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1).T.copy()
_STEP = np.random.default_rng(8).integers(1, 2**63, BAND + 1, dtype=np.uint64) | np.uint64(1)
#: Two unequal registers agree by chance where the leading zeros and all mantissa bits do.
CHANCE = 2.0**-10 / 3


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and the offsets of the texts' parts."""
    n = len(offsets) - 1
    data = blocks.LOWER[data]
    rows, starts, ends = blocks.words(data, offsets)
    h = blocks.hashes(data, starts, ends)
    base = np.uint64(0xD6E8FEB86659FD93)
    per_row = np.bincount(rows, minlength=n)
    full = np.zeros(0, np.uint64)
    owners = np.zeros(0, np.int64)
    if len(h) >= width:
        owners = rows[: len(h) - width + 1]
        same = owners == rows[width - 1 :]
        full = np.zeros(len(owners), np.uint64)
        for k in range(width):
            full = full * base + h[k : len(h) - width + 1 + k]
        full, owners = blocks.mix(full[same]), owners[same]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        first = np.searchsorted(rows, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = per_row[short] > k
            total[has] = total[has] * base + h[first[has] + k]
        full = np.concatenate([full, blocks.mix(total + per_row[short].astype(np.uint64) * _STEP[0])])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        full, owners = full[order], owners[order]
    part = blocks.counted(full, owners, n)
    for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
        full[a:b].sort()
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (owners[1:] != owners[:-1])
    return full[new], blocks.counted(full, owners[new], n)


def registers(sets: np.ndarray, part: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (5 bits of leading zeros, 10 of mantissa) of each set; all empty for an empty set."""
    n = len(part) - 1
    out = np.full((n, REGISTERS), _EMPTY, np.uint16)
    rows = np.repeat(np.arange(n), np.diff(part))
    spread = (sets >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket, place = (spread >> np.uint64(32)).astype(np.int64), (spread & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = (place & ~0xFF) | ((sets & np.uint64(0xFF)).astype(np.int64))
    first = np.ones(len(sets), bool)  # sets are sorted, so the first hash of a register is its smallest
    first[1:] = (rows[1:] != rows[:-1]) | (bucket[1:] != bucket[:-1])
    rows, bucket, place = rows[first], bucket[first], place[first]
    exponent = np.frexp(place.astype(np.float64))[1]  # bits in use: 0 to 32
    zeros = np.minimum(32 - exponent, 31)
    shift = np.maximum(exponent - 1, 0)
    mantissa = ((place - (np.int64(1) << shift)) << 10 >> shift) & 0x3FF
    out[rows, bucket] = (zeros << 10 | np.where(place > 0, mantissa, 0)).astype(np.uint16)
    filled, seen = out.copy(), np.diff(part) > 0
    r, c = np.nonzero((filled == _EMPTY) & seen[:, None])
    for k in range(REGISTERS):
        if not len(r):
            break
        value = out[r, _PLACE[k, c]]
        filled[r, c] = value
        still = value == _EMPTY
        r, c = r[still], c[still]
    return filled


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    parts = regs.reshape(len(regs), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP[BAND], parts.shape[:2]).copy()
    for k in range(BAND):
        key = key * _STEP[k] + parts[:, :, k]
    return blocks.mix(key)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities between the rows of two register tables, corrected for chance collisions."""
    equal = np.empty((len(a), len(b)))
    for k, row in enumerate(a):
        equal[k] = (b == row).sum(1)
    return np.maximum(0, (equal / REGISTERS - CHANCE) / (1 - CHANCE))


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                sets, part = shingles(*blocks.bytes_of(piece.column("text")), width)
                total = [np.concatenate([[0], np.cumsum(v, dtype=np.uint64)]).astype(np.uint64) for v in (blocks.mix(sets), blocks.mix(sets ^ _STEP[1]))]
                f1, f2 = ((t[part[1:]] - t[part[:-1]]).view(np.int64) for t in total)
                keys = band_keys(registers(sets, part)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(np.diff(part)), pa.array(f1), pa.array(f2), lists], ["doc_id", "n", "f1", "f2", "keys"])

    return run


class _Members:
    """The sets and registers of the documents of one part."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int) -> None:
        self.ids = np.array(ids, np.int64)
        column = pa.array(texts, pa.large_string())
        sets, regs = [], []
        for piece in blocks.pieces(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            s, part = shingles(*blocks.bytes_of(piece.column("text")), width)
            sets += [s[part[k] : part[k + 1]] for k in range(len(part) - 1)]
            regs.append(registers(s, part))
        self.sets, self.regs = sets, np.concatenate(regs)
        self.sizes = np.array([len(s) for s in sets], np.int64)


def _confirmed(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` have 100 * intersection >= percent * union with ``one``, by full sets."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    inside = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * inside >= percent * (sizes + len(one) - inside)


class _Links:
    """Union-find over the members of a part; collects the links that joined something."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.found: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root[a], self.root[b]
        if ra != rb:
            self.root[self.root == max(ra, rb)] = min(ra, rb)
            self.found.append((a, b))


def _compare(m: _Members, links: _Links, ones: np.ndarray, others: np.ndarray, percent: int) -> None:
    """Link each of ``ones`` with those of ``others`` that are similar and not yet in its component."""
    bar = percent / 100
    for a in ones:
        apart = others[links.root[others] != links.root[a]]
        lo, hi = m.sizes[a], m.sizes[apart]
        apart = apart[(100 * np.minimum(lo, hi) >= percent * np.maximum(lo, hi)) & (hi > 0) & (lo > 0)]
        if len(apart):
            used = REGISTERS * -np.expm1(-np.minimum(m.sizes[a], m.sizes[apart]) / REGISTERS)
            apart = apart[estimated(m.regs[a : a + 1], m.regs[apart])[0] >= bar - 5 * np.sqrt(bar * (1 - bar) / used)]
        if len(apart):
            for b in apart[_confirmed(m.sets[a], [m.sets[b] for b in apart], percent)]:
                links.join(a, b)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


#: Bits of the filter that keeps texts out of a join, whatever the number of ids.
FILTER_BITS = 1 << 25


def _spot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def _among(table: DataFrame, ids: DataFrame, inside: bool) -> DataFrame:
    """The rows of ``table`` whose doc_id may be among ``ids`` (id), or else those for which it is certain that it is not.

    A bit for each hashed id is set in a table of fixed size, which is broadcast; with far more ids
    than bits it tells fewer rows apart, but never puts one of the ids on the wrong side.
    """
    spot = _spot(F.col("id").cast("long"))
    word, bit = F.shiftright(spot, 5).cast("int"), (spot % 32).cast("int")
    set_ = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 5, np.uint32)
    bits[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint32)
    shared = table.sparkSession.sparkContext.broadcast(bits)
    names, spot_name = table.columns, free_name(table, "_spot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(spot_name).to_numpy()
            found = (shared.value[spots >> 5] >> (spots & 31).astype(np.uint32) & 1).astype(bool)
            yield batch.select(names).filter(pa.array(found if inside else ~found))

    return table.withColumn(spot_name, _spot(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))).mapInArrow(blocks.released(run), table.schema)


def only_members(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids`` (id), and a few others: what is worth taking to a join."""
    return _among(table, ids, True)


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids`` (id), null ones included; only rows in doubt are shuffled."""
    doubtful = only_members(table, ids)
    gone = ids.select("id").alias("gone")
    kept = doubtful.alias("table").join(gone, F.col("table.doc_id") == F.col("gone.id"), "left_anti")
    return _among(table, ids, False).unionByName(kept)


_EDGE = ["a", "b"]


def _edges(m: _Members, links: _Links) -> pa.RecordBatch:
    a, b = (m.ids[[p[k] for p in links.found]] if links.found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], _EDGE)


def _within(width: int, percent: int):
    """Links inside a part: with the leader, then between members still apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["leader", "part"]):
            m = _Members(table.column("id").to_pylist(), table.column("text").to_pylist(), width)
            links = _Links(len(m.ids))
            everyone = np.arange(len(m.ids))
            _compare(m, links, np.flatnonzero(m.ids == table.column("leader")[0].as_py()), everyone, percent)
            roots, sizes = np.unique(links.root, return_counts=True)
            if len(roots) > 1:
                _compare(m, links, everyone[links.root != roots[sizes.argmax()]], everyone, percent)
            yield _edges(m, links)

    return run


def _across(width: int, percent: int):
    """Links between the members marked apart and the other rows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["leader", "block", "part"]):
            m = _Members(table.column("id").to_pylist(), table.column("text").to_pylist(), width)
            links = _Links(len(m.ids))
            component, apart = table.column("component").to_numpy(), table.column("apart").to_numpy(zero_copy_only=False)
            for c in np.unique(component):
                links.root[component == c] = np.flatnonzero(component == c)[0]
            _compare(m, links, np.flatnonzero(apart), np.flatnonzero(~apart), percent)
            yield _edges(m, links)

    return run


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, part_rows: int = 512, part_shingles: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = documents.select("doc_id", "text")
    rows = stored(texts.mapInArrow(blocks.released(_sketched(width)), "doc_id long, n long, f1 long, f2 long, keys array<long>"), "sketches")
    listed = rows.where("doc_id is not null and n > 0")
    # Of a class of equal sets, the smallest id stands for all; its keys are those of any member.
    classes = stored(listed.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    heads = rows.join(classes.select("f1", "f2", "n", F.col("id").alias("doc_id")), ["doc_id", "f1", "f2", "n"], "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    banded = heads.select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(shared, "key"), "members")
    rank = members.groupBy("id").agg(F.sum("size").alias("weight"))
    ranked = members.join(rank, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    cluster = ranked.join(leaders, "key").groupBy("leader", "id").agg(F.max("n").alias("n"))
    cluster = stored(cluster, "clusters")
    parts = cluster.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("n") / part_shingles)).cast("int").alias("parts"))
    many = stored(parts.where("parts > 1"), "parts")
    placed = cluster.join(small(many), "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    lead = placed.where("leader = id")
    dealt = placed.where("leader != id").unionByName(lead.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = stored(dealt, "dealt")

    def with_texts(wanted: DataFrame) -> DataFrame:
        near = only_members(texts, wanted)
        return near.join(wanted, near.doc_id == wanted.id).drop("doc_id")

    def by_group(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, "id")

    found = by_group(with_texts(dealt).select("leader", "part", "id", "text"), "leader", "part").mapInArrow(blocks.released(_within(width, percent)), "a long, b long")
    edges = stored(found, "links")
    linked = components(edges)
    # Clusters of several parts: members outside the largest component meet the other parts.
    wide = placed.where("parts > 1")
    wide = wide.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    wide = stored(wide, "wide")
    if wide.limit(1).count():
        sizes = wide.groupBy("leader", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("leader").agg(F.max(F.struct("size", (-F.col("component")).alias("minus"))).alias("top"), F.sum("size").alias("total"))
        main = main.select("leader", (-F.col("top.minus")).alias("main"), (F.col("total") - F.col("top.size")).alias("n_apart"))
        wide = wide.join(small(stored(main.where("n_apart > 0"), "main")), "leader").withColumn("blocks", F.ceil(F.col("n_apart") / part_rows).cast("int"))
        wide = stored(wide, "wide")
        block = F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")
        ones = wide.where("component != main").select("leader", "id", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("apart"))
        others = wide.select("leader", "id", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(False).alias("apart"))
        meet = with_texts(ones.unionByName(others)).select("leader", "block", "part", "id", "component", "apart", "text")
        found = by_group(meet, "leader", "block", "part").mapInArrow(blocks.released(_across(width, percent)), "a long, b long")
        linked = components(edges.unionAll(found))
    of_class = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    # Rows with one doc_id are one document, so a document's class may be reached through any of them.
    found = rows.select("doc_id", "f1", "f2", "n").join(of_class, ["f1", "f2", "n"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


def reference_sql(width: int = 4, percent: int = 80) -> str:
    """The same rows in SQL: every pair that shares a shingle, then reachability."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
