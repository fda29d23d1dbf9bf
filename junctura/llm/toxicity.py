"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased letter runs and their first four bytes. A bounded sample of labelled rows are
the examples, and the vocabulary holds every term of theirs; inverse document frequencies come from
all documents. A query's terms that no example has take no part: they leave the order of the examples
as it is, and only its length is that of its known terms. Examples that are nearest to the same one of some
pivots share blocks, so that a block mostly has one language. Of the most frequent terms of a block the index has
a matrix and the largest weight of each, of all its others postings. Many queries are searched at once: the postings'
part of every similarity is summed, and a query's upper bound for a block is the largest such part in it and
the sum, over the block's frequent terms, of its weight times the largest in the block. Only blocks whose bound
reaches the k-th best similarity found get their matrix part, and rows that may be nearest are summed in
double precision, so the nearest examples are exact. Their votes, weighted by nearness and by how
thinly their class was sampled, go through an isotonic fit of leave-one-out votes to become
calibrated scores; the nearest examples are returned as evidence.

Defined cases: a null text counts as empty; a text without any term of the examples has no neighbours and
gets the base rate of such examples; ties in similarity go to the smaller example id; without
labelled rows every score is 0.5; repeated rows are scored one by one; extra columns pass through
unless they bear an output's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks
from junctura.llm.scratch import stored
from junctura.llm.training import held_out, sample_labels, sampled_texts

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STEM = np.uint64(0xA5A5A5A5DEADBEEF)
#: Postings that one search of many rows looks at.
_POSTINGS = 1 << 22
#: Postings that are summed at once.
_SUMMED = 1 << 16
#: Rows whose dense terms' parts are summed at once, and rows of which only the largest similarity is looked at first.
_ADDED, _GROUP = 256, 16
#: Texts that one search takes at most.
_QUERIES = 128
#: Bytes of texts scored together: the more of them, the more alike are those that share a search.
_SCORED_BYTES = 1 << 21
#: More than the error of a similarity of unit vectors summed in single precision over a block's dense terms.
_ROUGH = 1e-4
#: The most frequent terms, by which rows find the pivot that they are nearest to.
_PIVOT_TERMS = 768


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and of the first four bytes of every longer one."""
    data = blocks.LOWER[data]
    starts, ends = blocks.runs(_LETTER[data], offsets)
    long = ends - starts > 4
    rows = blocks.row_of(starts, offsets)
    words, stems = blocks.hashes(data, starts, ends), blocks.hashes(data, starts[long], starts[long] + 4) ^ _STEM
    return np.concatenate([rows, rows[long]]), np.concatenate([words, stems])


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the sorted vocabulary, count) of the known terms, ordered by row and place."""
    rows, found = terms(data, offsets)
    if not len(found) or not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    codes, kinds = pd.factorize(found)
    at = np.minimum(np.searchsorted(vocabulary, kinds), len(vocabulary) - 1)
    at = np.where(vocabulary[at] == kinds, at, -1)[codes]
    known = at >= 0
    pairs, counts = np.unique(rows[known] * len(vocabulary) + at[known], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), counts


def term_counts_in_parts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of more texts than are cut into terms at once."""
    out, at, n = [(np.zeros(0, np.int64),) * 3], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + blocks.PIECE_BYTES, "right")) - 1)
        rows, found, counts = term_counts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], vocabulary)
        out.append((rows + at, found, counts))
        at = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges end to end, and the length of each range."""
    lengths = ends - starts
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()), lengths


@dataclass
class BlockMaxIndex:
    """Unit vectors in blocks of rows that are alike: of each block a matrix of its ``dense`` most frequent terms and the largest weight of each, postings of all its others.

    ``rows`` ascend. ``weights`` may be a function that works out those at given places, so that not all need to be in memory while the index is made.
    """

    rows: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | Callable[[np.ndarray], np.ndarray]
    n_rows: int
    n_terms: int
    block: int = 1024
    dense: int = 1024
    place: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        weigh = self.weights if callable(self.weights) else self.weights.__getitem__
        sizes = np.bincount(self.terms, minlength=self.n_terms)
        head = np.argsort(-sizes, kind="stable")[:_PIVOT_TERMS]
        self.place = np.full(self.n_terms, -1, np.int32)
        self.place[head] = np.arange(len(head))
        part = np.searchsorted(self.rows, np.arange(self.n_rows + 1))
        self.own = self._arranged(len(head), weigh, part)
        self._blocks = -(-self.n_rows // self.block)
        n = len(self.terms)
        heads, self._matrices = [], []
        these = rows = terms = weights = at = inside = outside = None
        # Room for all of them in each: pages that are never written take no memory.
        self._head_at, self._head_weights, in_rows, n_in = np.empty(n, np.int32), np.empty(n), np.zeros(self.n_rows, np.int64), 0
        rows_out, places_out, n_out = np.empty(n, np.int32), np.empty(n, np.int32), 0
        for b in range(self._blocks):
            own = self.own[b * self.block : (b + 1) * self.block]
            these, lengths = _expanded(part[own], part[own + 1])
            rows, terms, weights = np.repeat(np.arange(len(own), dtype=np.int32), lengths) + np.int32(b * self.block), self.terms[these], weigh(these)
            sizes = np.bincount(terms, minlength=self.n_terms)
            head = np.argpartition(-sizes, self.dense)[: self.dense] if self.dense < self.n_terms else np.arange(self.n_terms)
            head = np.sort(head[sizes[head] > 0])
            at = np.full(self.n_terms, -1, np.int32)
            at[head] = np.arange(len(head))
            at = at[terms]
            inside, outside = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            matrix = np.zeros((len(head), self.block), np.float32)
            matrix[at[inside], rows[inside] - b * self.block] = weights[inside]
            heads.append(head)
            self._matrices.append(matrix)
            span = slice(n_in, n_in := n_in + len(inside))
            self._head_at[span], self._head_weights[span] = terms[inside], weights[inside]
            in_rows += np.bincount(rows[inside], minlength=self.n_rows)
            span = slice(n_out, n_out := n_out + len(outside))
            rows_out[span], places_out[span] = rows[outside], these[outside]
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *heads]))
        self._held = np.full(self.n_terms, -1, np.int32)
        self._held[held] = np.arange(len(held))
        self._heads = [self._held[h] for h in heads]
        self.most = np.zeros((len(held), self._blocks), np.float32)
        for b, (h, matrix) in enumerate(zip(self._heads, self._matrices, strict=True)):
            self.most[h, b] = matrix.max(1)
        self._head_at, self._head_weights = self._held[self._head_at[:n_in]], self._head_weights[:n_in]
        self._head_part = np.concatenate([[0], np.cumsum(in_rows)])
        del self.rows, these, rows, terms, weights, at, inside, outside
        terms = self.terms[places_out[:n_out]]
        order = np.argsort(terms, kind="stable").astype(np.int32)
        self._starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=self.n_terms))])
        del terms
        self.rows, self.terms = rows_out[order], None
        del rows_out
        places_out = places_out[order]
        del order
        # Weights are worked out anew in their final order, some at a time: kept in the first order too, they would be in memory twice.
        self.weights = np.empty(n_out)
        for start in range(0, n_out, 1 << 18):
            self.weights[start : start + (1 << 18)] = weigh(places_out[start : start + (1 << 18)])

    def _arranged(self, n_head: int, weigh: Callable[[np.ndarray], np.ndarray], part: np.ndarray) -> np.ndarray:
        """The number of the row at each new place: those nearest to one of some pivots share blocks, which makes bounds tighter."""
        if not self.n_rows:
            self._pivots = np.zeros((n_head, 1), np.float32)
            return np.zeros(0, np.int64)

        def vectors(rows: np.ndarray) -> np.ndarray:
            these, lengths = _expanded(part[rows], part[rows + 1])
            at, which = self.place[self.terms[these]], np.repeat(np.arange(len(rows)), lengths)
            known = np.flatnonzero(at >= 0)
            dense = np.zeros((len(rows), n_head), np.float32)
            dense[which[known], at[known]] = weigh(these[known])
            return dense

        columns = vectors(np.arange(0, self.n_rows, max(1, self.n_rows // 96))).T.copy()
        nearest = np.concatenate([(vectors(np.arange(start, min(start + 1024, self.n_rows))) @ columns).argmax(1) for start in range(0, self.n_rows, 1024)])
        # Pivots follow each other by likeness, so that neighbouring blocks are alike too.
        alike, chain = columns.T @ columns, [0]
        while len(chain) < columns.shape[1]:
            alike[:, chain[-1]] = -1
            chain.append(int(alike[chain[-1]].argmax()))
        place = np.empty(len(chain), np.int64)
        place[chain] = np.arange(len(chain))
        nearest, self._pivots = place[nearest], columns[:, chain]
        return np.argsort(nearest, kind="stable")

    def kin(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """The place of the pivot that each of ``n`` queries is nearest to: queries that are alike have near ones."""
        known = self.place[terms] >= 0
        dense = np.zeros((n, len(self._pivots)), np.float32)
        dense[rows[known], self.place[terms[known]]] = weights[known]
        return (dense @ self._pivots).argmax(1)

    def _add_heads(self, queries: np.ndarray, rows: np.ndarray, dense: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The dense terms' part of the similarity of each query and row, in double precision."""
        out = np.zeros(len(rows))
        for start in range(0, len(rows), _ADDED):
            q, row = queries[start : start + _ADDED], rows[start : start + _ADDED]
            at, lengths = _expanded(self._head_part[row], self._head_part[row + 1])
            cell = np.repeat(q * dense.shape[1], lengths)
            cell += spot.take(self._head_at.take(at))
            part = dense.reshape(-1).take(cell)
            part *= self._head_weights.take(at)
            out[start : start + _ADDED] = np.bincount(np.repeat(np.arange(len(row)), lengths), part, len(row))
        return out

    def nearest_of(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the k nearest of each of ``n`` queries with any term in common, nearest first.

        ``leave_out`` has the row that each query is, if queries are rows of the index themselves.
        """
        if not self.n_rows or not n or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held, width = self._held[terms], self._blocks * self.block
        known = np.flatnonzero(held >= 0)
        used = np.flatnonzero(np.bincount(held[known], minlength=len(self.most)))  # queries that are alike use few of them
        spot = np.full(len(self.most), len(used))  # terms that no query has share a last column without weight
        spot[used] = np.arange(len(used))
        dense = np.zeros((n, len(used) + 1))
        dense[rows[known], spot[held[known]]] = weights[known]
        single = dense.astype(np.float32)
        tail, bound = np.empty((n, self._blocks, self.block)), single[:, :-1] @ self.most[used] + _ROUGH
        by_row = np.argsort(rows, kind="stable")
        part = blocks.counted(terms, rows, n)
        work = np.concatenate([[0], np.cumsum(self.spread(terms[by_row]))])[part]
        start = 0
        while start < n:  # a few queries at a time, whose sums fit the processor's cache
            end = min(max(start + 1, int(np.searchsorted(work, work[start] + _SUMMED, "right")) - 1), n)
            these = by_row[part[start] : part[end]]
            at, lengths = _expanded(self._starts[terms[these]], self._starts[terms[these] + 1])
            cell, weight = np.repeat((rows[these] - start) * width, lengths), np.repeat(weights[these], lengths)
            cell += self.rows.take(at, mode="clip")
            weight *= self.weights.take(at, mode="clip")
            tail[start:end] = np.bincount(cell, weight, (end - start) * width).reshape(-1, self._blocks, self.block)
            bound[start:end] += tail[start:end].max(2)
            start = end
        rough = np.zeros((n, self._blocks, self.block), np.float32)  # the dense terms' part, off by less than _ROUGH; put right at the end
        scored = np.zeros((n, self._blocks), bool)
        own = None
        if leave_out is not None:
            now = np.empty(self.n_rows, np.int64)
            now[self.own] = np.arange(self.n_rows)
            own = now[leave_out]

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                which, columns, matrix = np.flatnonzero(wanted[:, b]), spot[self._heads[b]], self._matrices[b]
                some = np.flatnonzero(columns < len(used))
                if 4 * len(some) < 3 * len(columns):  # a copy of most of the matrix costs more than the products that it saves
                    columns, matrix = columns[some], matrix[some]
                rough[which, b] = single[which[:, None], columns] @ matrix
            scored[wanted] = True

        def rated(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The wanted cells (query, block) and the similarities of their rows."""
            cells = np.flatnonzero(wanted)
            total = rough.reshape(-1, self.block)[cells] + tail.reshape(-1, self.block)[cells]
            if own is not None:
                mine = own[cells // self._blocks]
                hit = np.flatnonzero(cells % self._blocks == mine // self.block)
                total[hit, mine[hit] % self.block] = 0
            return cells, total

        wanted = np.zeros(scored.shape, bool)
        wanted[np.arange(n), bound.argmax(1)] = True
        score(wanted)
        # The k-th best of the blocks scored so far is never above the k-th best of all.
        _, total = rated(scored)
        floor = (np.partition(total, -k, axis=1)[:, -k] if k <= self.block else np.zeros(n)) - 2 * _ROUGH
        score(~scored & (bound > _ROUGH) & (bound >= floor[:, None]))
        cells, total = rated(scored)
        # The same of all blocks: the k-th best of the largest of some groups of rows is never above it either.
        groups = self.block // _GROUP or 1
        if self.block % groups == 0 and k <= self._blocks * groups:
            largest = np.zeros((n * self._blocks, groups))
            largest[cells] = total.reshape(len(cells), -1, groups).max(1)
            floor = np.maximum(floor, np.partition(largest.reshape(n, -1), -k, axis=1)[:, -k] - 2 * _ROUGH)
        found, inside = np.nonzero(total >= np.maximum(floor, np.finfo(float).tiny)[cells // self._blocks, None])
        q, at, values = cells[found] // self._blocks, cells[found] % self._blocks * self.block + inside, total[found, inside]
        order = np.lexsort((-values, q))
        q, at, values = q[order], at[order], values[order]
        # Of each query, only rows that may be among its k nearest: not below its k-th by more than the roughness.
        start = np.searchsorted(q, q)
        least = np.where(start + k <= np.searchsorted(q, q, "right"), values[np.minimum(start + k, len(q)) - 1], 0)
        may = values >= least - 2 * _ROUGH
        q, at = q[may], at[may]
        near = np.round(tail.reshape(n, width)[q, at] + self._add_heads(q, at, dense, spot), 12)
        old = self.own[at]
        order = np.lexsort((old, -near, q))
        order = order[near[order] > 0]
        q, at, near = q[order], old[order], near[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[few], at[few], near[few]

    def spread(self, terms: np.ndarray) -> np.ndarray:
        """The number of postings that each term brings to a search."""
        return self._starts[terms + 1] - self._starts[terms]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weighted non-decreasing fit (pool adjacent violators), pulled a little to the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    mean = float(np.average(y, weights=weight))
    for v, t, w in zip(x[order], y[order], weight[order], strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += w * t
            pools[-1][2] += w
        else:
            pools.append([v, w * t, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    at = np.array([p[0] for p in pools])
    return at, np.array([(p[1] + mean) / (p[2] + 1) for p in pools])


@dataclass
class Neighbours:
    """The fitted model: small arrays, bounded by the number of examples and of terms."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    part: np.ndarray
    k: int
    at: np.ndarray = field(default_factory=lambda: np.array([1.0]))
    value: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    without: float = 0.5

    def index(self) -> BlockMaxIndex:
        """The examples' index, made once in a process."""
        if not hasattr(self, "_index"):
            n = len(self.ids)
            rows, norm = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), np.diff(self.part)), np.zeros(n)
            for start in range(0, n, 1024):
                end = min(start + 1024, n)
                span = slice(self.part[start], self.part[end])
                norm[start:end] = self.norms(self.rows(start, end), self.weighed(self.terms[span], self.counts[span]), end - start)
            weights = lambda at: self.weighed(self.terms[at], self.counts[at]) / norm[rows[at]]
            self._index = BlockMaxIndex(rows, self.terms, weights, n, len(self.vocabulary))
            del rows, weights
            blocks.give_back()
        return self._index

    def searched(self) -> Neighbours:
        """The model with its index and without what only the index and the examples' own votes are made from, for a process that scores."""
        self.index()
        self.terms = self.counts = None
        return self

    def rows(self, start: int, end: int) -> np.ndarray:
        return np.repeat(np.arange(end - start, dtype=np.int32), np.diff(self.part[start : end + 1]))

    def vectors(self, rows: np.ndarray, found: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights to unit length, and the offsets of each row's part."""
        weights = self.weighed(found, counts)
        return weights / self.norms(rows, weights, n)[rows] if len(rows) else weights, blocks.counted(found, rows, n)

    def weighed(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts, dtype=float)) * self.idf[found]

    def norms(self, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        return np.sqrt(np.bincount(rows, weights**2, n))

    def vote(self, queries: np.ndarray, at: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries that have neighbours, and the share of toxic ones among these, by nearness and class."""
        weight = self.class_weight[self.labels[at]] / (1.05 - near)
        which, place = np.unique(queries, return_inverse=True)
        return which, np.bincount(place, weight * self.labels[at]) / np.bincount(place, weight)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.at, self.value)

    def neighbours(self, rows: np.ndarray, found: np.ndarray, counts: np.ndarray, n: int, leave_out: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, nearest, similarity), searched for many rows at once; ``leave_out`` is the example that row 0 is, if rows are examples."""
        index = self.index()
        weights, _ = self.vectors(rows, found, counts, n)
        # Texts that are alike are searched together.
        order = np.argsort(index.kin(rows, found, weights, n), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        rows = place[rows]
        by_row = np.argsort(rows, kind="stable")
        rows, found, weights = rows[by_row], found[by_row], weights[by_row]
        part = blocks.counted(found, rows, n)
        # Runs of rows whose terms have so many postings in all; one row with more is a run of its own.
        work = np.concatenate([[0], np.cumsum(index.spread(found))])[part]
        out, start = [], 0
        while start < n:
            end = min(max(start + 1, int(np.searchsorted(work, work[start] + _POSTINGS, "right")) - 1), start + _QUERIES, n)
            span = slice(part[start], part[end])
            q, at, near = index.nearest_of(rows[span] - start, found[span], weights[span], end - start, self.k, None if leave_out is None else leave_out + order[start:end])
            out.append((order[q + start], at, near))
            start = end
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, at, near = (np.concatenate(c) for c in zip(*out, strict=True))
        by_row = np.argsort(q, kind="stable")
        return q[by_row], at[by_row], near[by_row]

    def judge(self, data: np.ndarray, offsets: np.ndarray, evidence: int) -> tuple[np.ndarray, pa.Array]:
        """Scores, and of each text its ``evidence`` nearest examples."""
        n = len(offsets) - 1
        q, at, near = self.neighbours(*term_counts_in_parts(data, offsets, self.vocabulary), n)
        scores = np.full(n, self.without)
        which, votes = self.vote(q, at, near)
        scores[which] = self.calibrated(votes)
        few = np.arange(len(q)) - np.searchsorted(q, q) < evidence
        q, at, near = q[few], at[few], near[few]
        shown = pa.StructArray.from_arrays([pa.array(self.ids[at]), pa.array(near), pa.array(self.labels[at].astype(np.int32))], ["example", "similarity", "label"])
        return scores, pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(n + 1)).astype(np.int32)), shown)

    def votes(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the examples from ``start`` to ``end``: those with neighbours beside themselves, and their votes."""
        own = slice(self.part[start], self.part[end])
        which, votes = self.vote(*self.neighbours(self.rows(start, end), self.terms[own], self.counts[own], end - start, start))
        return which + start, votes


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in blocks.pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms(*blocks.bytes_of(piece.column("text")))[1]).view(np.int64))], ["term"])


def _vocabulary(texts: DataFrame) -> np.ndarray:
    """Every term of the bounded set of texts, in order."""
    kinds = texts.mapInArrow(blocks.released(_distinct_terms), "term long").distinct()
    return np.sort(kinds.toArrow().column("term").to_numpy().view(np.uint64))


def _frequencies(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number."""

    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for piece in blocks.pieces(batch, "text"):
                _, found, _ = term_counts(*blocks.bytes_of(piece.column("text")), vocabulary)
                total += np.bincount(found, minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    rows = documents.select("text").mapInArrow(blocks.released(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (rows.column(c).to_numpy() for c in ("term", "n"))
    out = np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _votes(model: Neighbours, spark) -> tuple[np.ndarray, np.ndarray]:
    """The leave-one-out votes of the examples, worked out in tasks of 256."""
    n, size = len(model.ids), 256
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([*map(pa.array, shared.value.votes(start, min(start + size, n)))], ["row", "vote"])

    found = spark.range(0, n, size, max(-(-n // size), 1)).mapInArrow(blocks.released(vote), "row long, vote double").toArrow().sort_by("row")
    shared.unpersist()
    return found.column("row").to_numpy(), found.column("vote").to_numpy()


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", most_per_class: int = 6000, k: int = 15) -> Neighbours:
    """Examples and vocabulary from at most ``most_per_class`` labelled rows of each class, frequencies from all documents."""
    sample = stored(sampled_texts(documents, sample_labels(labels, label, most_per_class)), "examples")
    vocabulary = _vocabulary(sample)
    frequency, n_all = _frequencies(documents, vocabulary)
    idf = np.log((1 + n_all) / (1 + frequency)) + 1
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                rows, found, counts = term_counts(*blocks.bytes_of(piece.column("text")), shared.value)
                part = blocks.counted(found, rows, piece.num_rows)
                lists = [pa.ListArray.from_arrays(pa.array(part, pa.int32()), pa.array(v.astype(np.int32))) for v in (found, counts)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("label"), *lists], ["doc_id", "label", "terms", "counts"])

    schema = "doc_id long, label int, terms array<int>, counts array<int>"
    examples = sample.mapInArrow(blocks.released(vectors), schema).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    n = examples.num_rows
    ids, y = examples.column("doc_id").to_numpy(), examples.column("label").to_numpy().astype(np.int64)
    part = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(examples.column("terms")).to_numpy())]).astype(np.int64)
    found, counts = (pa.compute.list_flatten(examples.column(c)).to_numpy() for c in ("terms", "counts"))
    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    real = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    weight = np.array([real.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)])
    weight = np.where(weight > 0, weight / max(weight.max(), 1e-9), 1.0)
    model = Neighbours(vocabulary, idf, ids, y, weight, found, counts, part, k)
    voters, votes = _votes(model, documents.sparkSession)
    if len(votes):
        model.at, model.value = isotonic(votes, y[voters].astype(float), weight[y[voters]])
    none = np.setdiff1d(np.arange(n), voters)
    if n:
        w = weight[y]
        model.without = float((w[none] @ y[none] + w @ y / w.sum()) / (w[none].sum() + 1)) if len(none) else float(w @ y / w.sum())
    return model


EVIDENCE = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def with_score(documents: DataFrame, model: Neighbours, name: str = "score", evidence: str | None = None, shown: int = 3) -> DataFrame:
    """``documents`` with ``name`` (0 to 1, higher is likelier toxic) and, if a name is given, the nearest examples."""
    kept = documents.select([c for c in documents.columns if c not in (name, evidence)])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType()), *([T.StructField(evidence, EVIDENCE)] if evidence else [])])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text", _SCORED_BYTES):
                scores, near = shared.value.searched().judge(*blocks.bytes_of(piece.column("text")), shown if evidence else 0)
                more = [(evidence, near)] if evidence else []
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores), *(v for _, v in more)], [*piece.schema.names, name, *(n for n, _ in more)])

    return kept.mapInArrow(blocks.released(scored), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(documents.select("doc_id", "text"), fit(documents, labels), evidence="evidence")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
