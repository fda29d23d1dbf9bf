"""Ranked lexical search with block-max pruning.

Index: neighbouring documents form shards of about two megabytes of text, and inside a shard blocks of
``block_docs`` documents. A shard's row holds its terms once, their document frequencies, and for each block a
forward index (the terms of each document and how often they occur) and the largest impact of every term in the
block. All are compressed on their own, so a search reads maxima first and opens the forward index of a block only where it
must. Impacts are whole numbers, so sums and bounds are exact.

Search, for all queries at once:
1. Document frequencies of the queries' terms are summed over the shards, which gives the weights.
2. A query's bound on a block is the sum of weight times largest impact. Each query scores the few blocks with
   the highest bounds anywhere; its k-th best score there is its threshold.
3. All shards are scanned: a block is scored for those queries whose bound on it reaches their threshold, blocks with the
   highest bounds first, and the k best of a task raise its threshold as it goes. Blocks that reach the threshold just so
   are scored, as a tie may go to a smaller id. So the result is exact, whatever the pruning left out.

Broadcast are ``batch`` queries at a time with their terms and thresholds; tasks give up k rows a query at most.
Terms are looked up by a 64-bit hash and compared as strings.

Defined cases: a null or empty text has no terms and counts neither in N nor in the ranks; a query without known terms has
no rows; a term repeated in a query counts each time; equal scores go by ascending doc_id, a null id first, and repeated
rows are ranked one by one; of items that share an id each is a query of its own; very long texts are shards of their own; empty tables
give empty results; extra columns are not carried.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks
from junctura.llm.scratch import stored

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True

_INDEX = "shard long, ids array<long>, terms binary, df binary, forward array<binary>, maxima array<binary>, docs array<int>"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, row, start, end) of the maximal runs of letters, digits and anything beyond ASCII."""
    data, offsets = blocks.bytes_of(texts)
    starts, ends = blocks.runs(_TERM[data], offsets)
    return blocks.LOWER[data], blocks.row_of(starts, offsets), starts, ends


def totals(documents: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                data, offsets = blocks.bytes_of(piece.column("text"))
                starts, _ = blocks.runs(_TERM[data], offsets)
                n += np.count_nonzero(np.diff(np.searchsorted(starts, offsets)))
                length += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length])], ["n", "l"])

    row = documents.select("text").mapInArrow(blocks.released(count), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to its document's score for each unit of weight."""
    if 75 * n * int(length.max(initial=0)) < 2**62:
        m = 25 + 75 * n * length // max(total, 1)
    else:
        m = np.array([25 + 75 * n * int(x) // total for x in length], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _pack(press: zstandard.ZstdCompressor, *columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers: their lengths, then all of them, compressed."""
    head = np.array([len(columns), *map(len, columns)], np.int32)
    return press.compress(np.concatenate([head, *columns]).astype(np.int32).tobytes())


def _unpack(press: zstandard.ZstdDecompressor, blob: bytes) -> list[np.ndarray]:
    whole = np.frombuffer(press.decompress(blob), np.int32)
    cuts = 1 + whole[0] + np.concatenate([[0], np.cumsum(whole[1 : 1 + whole[0]])])
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def index(documents: DataFrame, block_docs: int = 64, shard_bytes: int = 2 << 20) -> tuple[DataFrame, int, int]:
    """The stored index and the totals N and L, by which its maxima hold."""
    n_docs, total = totals(documents)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in blocks.pieces(batch, "text", shard_bytes):
                data, rows, starts, ends = terms(piece.column("text"))
                if len(starts):
                    yield _shard(press, piece.column("doc_id").cast(pa.int64()), data, rows, starts, ends)

    def _shard(press, ids: pa.Array, data, rows, starts, ends) -> pa.RecordBatch:
        codes, kinds = pd.factorize(blocks.keys(data, starts, ends))
        order = np.argsort(kinds)
        place = np.empty(len(kinds), np.int64)
        place[order] = np.arange(len(kinds))
        codes = place[codes]
        first = np.empty(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        words = b"\n".join([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        length = np.bincount(rows, minlength=len(ids))
        pair, tf = np.unique(rows * len(kinds) + codes, return_counts=True)
        doc, term = np.divmod(pair, len(kinds))
        worth = impacts(tf.astype(np.int64), length[doc], n_docs, total)
        forward, maxima, docs = [], [], []
        for low in range(0, len(ids), block_docs):
            a, b = np.searchsorted(doc, [low, low + block_docs])
            forward.append(_pack(press, doc[a:b] - low, term[a:b], worth[a:b]))
            by_term = np.argsort(term[a:b], kind="stable")
            t = term[a:b][by_term]
            new = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(worth[a:b][by_term], new) if len(new) else worth[:0]
            maxima.append(_pack(press, t[new], top))
            docs.append(min(block_docs, len(ids) - low))
        whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
        df = press.compress(np.bincount(term, minlength=len(kinds)).astype(np.int32).tobytes())
        name = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), whole(ids, None), pa.array([press.compress(words)], pa.binary()), pa.array([df], pa.binary()), whole(forward, pa.binary()), whole(maxima, pa.binary()), whole(docs, pa.int32())],
            ["shard", "ids", "terms", "df", "forward", "maxima", "docs"],
        )

    return stored(documents.select("doc_id", "text").mapInArrow(blocks.released(build), _INDEX), "index"), n_docs, total


@dataclass
class Queries:
    """Terms of a batch of queries in the order of their hashes, and (query, term, repeats) of each."""

    words: np.ndarray
    keys: np.ndarray
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray
    n: int
    weight: np.ndarray | None = None

    def groups(self, most: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, its terms, a matrix terms x queries of weight times repeats) of every ``most`` queries."""
        order = np.argsort(self.query, kind="stable")
        query, term, times = self.query[order], self.term[order], self.times[order]
        for low in range(0, self.n, most):
            a, b = np.searchsorted(query, [low, low + most])
            used, at = np.unique(term[a:b], return_inverse=True)
            matrix = np.zeros((len(used), min(most, self.n - low)), np.int64)
            np.add.at(matrix, (at, query[a:b] - low), times[a:b] * self.weight[term[a:b]])
            # Sums below 2**53 are exact in doubles, whose products are faster.
            exact = 1e6 * matrix.sum(0).max(initial=0) < 2**53
            yield low, used, matrix.astype(np.float64) if exact else matrix


def queries_of(texts: list[str | None]) -> Queries:
    data, rows, starts, ends = terms(pa.array(texts, pa.string()))
    h, raw = blocks.keys(data, starts, ends), data.tobytes()
    words = np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object)
    kinds, at = np.unique(words, return_inverse=True) if len(words) else (words, np.zeros(0, np.int64))
    first = np.empty(len(kinds), np.int64)
    first[at] = np.arange(len(at))
    order = np.argsort(h[first], kind="stable")
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    pair, times = np.unique(rows * max(len(kinds), 1) + place[at], return_counts=True)
    query, term = np.divmod(pair, max(len(kinds), 1))
    return Queries(kinds[order], h[first][order], query, term, times, len(texts))


def _lookup(asked: Queries, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place among the shard's words, term of the queries) of the words that queries ask for."""
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    h = blocks.keys(data, np.concatenate([[0], ends[:-1] + 1]), ends)
    low, high = np.searchsorted(asked.keys, h), np.searchsorted(asked.keys, h, "right")
    found = [(k, t) for k in np.flatnonzero(high > low).tolist() for t in range(low[k], high[k]) if asked.words[t] == words[k]]
    at = np.array(found, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def _frequencies(built: DataFrame, asked) -> dict[int, int]:
    """Documents that hold each term of the queries, over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, total = zstandard.ZstdDecompressor(), np.zeros(len(asked.value.words), np.int64)
        for batch in batches:
            for blob, df in zip(batch.column("terms"), batch.column("df"), strict=True):
                at, term = _lookup(asked.value, press.decompress(blob.as_py()).split(b"\n"))
                total[term] += np.frombuffer(press.decompress(df.as_py()), np.int32)[at]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["term", "df"])

    found = built.select("terms", "df").mapInArrow(blocks.released(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


class _Shard:
    """A row of the index: bounds of its blocks, and scores of one block, for groups of queries."""

    def __init__(self, row: dict, asked: Queries) -> None:
        self.press, self.row = zstandard.ZstdDecompressor(), row
        words = self.press.decompress(row["terms"]).split(b"\n")
        at, term = _lookup(asked, words)
        self.term_of = np.full(len(words), -1)
        self.term_of[at] = term
        self.first = np.concatenate([[0], np.cumsum(row["docs"])])

    def _dense(self, blob: bytes, used: np.ndarray, kind) -> np.ndarray:
        """Rows of a block (documents; or the one row of maxima) x the group's terms."""
        *row, code, worth = _unpack(self.press, blob)
        term = self.term_of[code]
        keep = np.flatnonzero(term >= 0)
        place = np.minimum(np.searchsorted(used, term[keep]), max(len(used) - 1, 0))
        inside = np.flatnonzero(used[place] == term[keep]) if len(used) else place[:0]
        dense = np.zeros((int(row[0].max(initial=-1)) + 1 if row else 1, len(used)), kind)
        dense[row[0][keep[inside]] if row else 0, place[inside]] = worth[keep[inside]]
        return dense

    def bounds(self, used: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Blocks x queries of the group."""
        maxima = np.concatenate([self._dense(m, used, matrix.dtype) for m in self.row["maxima"]])
        return (maxima @ matrix).astype(np.int64)

    def scores(self, block: int, used: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Documents of the block (up to the last with a term) x queries."""
        return (self._dense(self.row["forward"][block], used, matrix.dtype) @ matrix).astype(np.int64)


class _Best:
    """The k best (query, score, id) so far; a query's threshold rises with them."""

    def __init__(self, k: int, threshold: np.ndarray) -> None:
        self.k, self.threshold = k, np.maximum(threshold, 1)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(query):
            self.held.append((query, score, ids, null))
            self.waiting += len(query)
            if self.waiting > 8 * self.k * len(self.threshold) + 4096:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        query, score, ids, null = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, ~null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.k - 1
        self.threshold[query[full]] = np.maximum(self.threshold[query[full]], score[order][full])
        kept = order[rank < self.k]
        self.held = [tuple(np.concatenate(c)[kept] for c in zip(*self.held, strict=True))]
        self.waiting = len(kept)
        return self.held[0]


def _top_bounds(built: DataFrame, asked, seeds: int) -> DataFrame:
    """(query, shard, block, bound): of each task the ``seeds`` blocks of the highest bounds for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        groups = list(queries.groups())
        best = np.zeros((seeds, queries.n), np.int64)
        where = np.zeros((seeds, queries.n, 2), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row, queries)
                for low, used, matrix in groups:
                    bound = shard.bounds(used, matrix)
                    part = slice(low, low + bound.shape[1])
                    both = np.concatenate([best[:, part], bound])
                    places = np.concatenate([where[:, part], np.stack(np.broadcast_arrays(row["shard"], np.arange(len(bound))[:, None] + np.zeros(bound.shape[1], np.int64)), -1)])
                    top = np.argsort(-both, 0, kind="stable")[:seeds]
                    best[:, part] = np.take_along_axis(both, top, 0)
                    where[:, part] = np.take_along_axis(places, top[..., None], 0)
        at, query = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(where[at, query, 0]), pa.array(where[at, query, 1]), pa.array(best[at, query])], ["query", "shard", "block", "bound"])

    found = built.select("shard", "terms", "maxima", "docs").mapInArrow(blocks.released(run), "query long, shard long, block long, bound long")
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "shard", "block")
    return found.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= seeds).drop("_at")


def _scored(built: DataFrame, asked, k: int, threshold: np.ndarray, only: dict | None = None) -> DataFrame:
    """(query, score, doc_id) of the k best of each task, over the blocks that reach the thresholds, or ``only`` those given."""
    shared = built.sparkSession.sparkContext.broadcast((threshold, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (least, chosen) = asked.value, shared.value
        groups, best = list(queries.groups()), _Best(k, least.copy())
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row, queries)
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                null = np.array([i is None for i in row["ids"]], bool)
                for low, used, matrix in groups:
                    bound = shard.bounds(used, matrix)
                    if chosen is not None:
                        wanted = np.zeros(bound.shape, bool)
                        for query, block in chosen.get(row["shard"], ()):
                            if low <= query < low + bound.shape[1]:
                                wanted[block, query - low] = True
                        bound = np.where(wanted, bound, 0)
                    for block in np.argsort(-bound.max(1, initial=0), kind="stable"):
                        floor = best.threshold[low : low + bound.shape[1]]
                        asking = np.flatnonzero(bound[block] >= floor)
                        if not len(asking):
                            continue
                        score = shard.scores(block, used, matrix[:, asking])
                        doc, column = np.nonzero(score >= floor[asking])
                        at = shard.first[block] + doc
                        best.add(low + asking[column], score[doc, column], ids[at], null[at])
        query, score, ids, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(ids, mask=null)], ["query", "score", "doc_id"])

    return built.mapInArrow(blocks.released(run), "query long, score long, doc_id long")


def search(built: DataFrame, n_docs: int, items: list[tuple], k: int = 10, seeds: int = 8) -> DataFrame:
    """(query, rank, doc_id, score) of the k best documents for each text of one batch of ``items``; ``query`` is the place in it."""
    spark = built.sparkSession
    queries = queries_of([text for _, text in items])
    df = _frequencies(built, spark.sparkContext.broadcast(queries))
    queries.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(queries.words))], np.int64)
    asked = spark.sparkContext.broadcast(queries)
    chosen: dict[int, list] = {}
    for r in _top_bounds(built, asked, seeds).collect():  # seeds rows a query
        chosen.setdefault(r["shard"], []).append((r["query"], r["block"]))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    threshold = np.zeros(queries.n, np.int64)
    if chosen:
        shards = spark.createDataFrame([(s,) for s in chosen], "shard long")
        first = _scored(built.join(F.broadcast(shards), "shard", "left_semi"), asked, k, threshold, chosen)
        for r in first.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == k).collect():  # a row a query
            threshold[r["query"]] = r["score"]
    found = _scored(built, asked, k, threshold)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10, batch: int = 4096, **options) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all ``documents`` for each item, ``batch`` items in one pass over the index."""
    spark = documents.sparkSession
    built, n_docs, _ = index(documents, **options)
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    held: list[tuple] = []

    def answer(rows: list[tuple]) -> DataFrame:
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)]))
        return search(built, n_docs, rows, k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")

    for row in items.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == batch:
            out, held = out.unionAll(answer(held)), []
    return out.unionAll(answer(held)) if held else out


def op11_block_max(spark, sf_dir: str) -> DataFrame:
    return rank_documents(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def reference_sql() -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    with docs as (select row_number() over () as d, doc_id, {words} as terms from documents),
    sized as (select d, doc_id, len(terms) as n from docs where len(terms) > 0),
    total as (select count(*) as n_docs, sum(n)::hugeint as l from sized),
    counts as (select d, term, count(*) as tf from (select d, unnest(terms) as term from docs) group by d, term),
    asked as (select item_id, term, count(*) as times from (select item_id, unnest({words}) as term from benchmark) group by item_id, term),
    weights as (
        select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::hugeint as w
        from counts, total where term in (select term from asked) group by term
    ),
    scores as (
        select item_id, doc_id, d, sum(times * w * ((1000000000::hugeint * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs::hugeint) // l)))) as score
        from asked join weights using (term) join counts using (term) join sized using (d), total group by item_id, doc_id, d
    ),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first, d) as rank, doc_id, score from scores where score > 0)
    select item_id, rank::int as rank, doc_id, score::bigint as score from ranked where rank <= 10"""
