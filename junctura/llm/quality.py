"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of each whole text are computed from its bytes, many texts at a time. The trees are
grown on a bounded sample of labelled rows (``most_per_class``) from histograms of binned features,
with Newton steps on the logistic loss, and are kept as complete binary trees in flat arrays, so
scoring walks all rows of a batch one level at a time.

Defined cases: a null text counts as empty; empty texts get a score like any other; extra columns
pass through `with_score` untouched unless one bears the output's name, in which case the output
replaces it; without any labelled row every score is 0.5; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks
from junctura.llm.training import held_out, sample_labels, sampled_texts

FEATURES = (
    "log_bytes log_words word_bytes longest_word space upper digit symbol bar bang stop comma newline wide "
    "distinct_words top_word distinct_lines line_bytes short_words symbol_words upper_words distinct_runs stop_per_word"
).split()


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_CLASSES = {
    "space": blocks.SPACE,
    "upper": _table(bytes(range(65, 91))),
    "digit": _table(b"0123456789"),
    "symbol": _table(b"#$%&*+/<=>@[]\\^_`{}~"),
    "bar": _table(b"|"),
    "bang": _table(b"!?"),
    "stop": _table(b"."),
    "comma": _table(b",;:"),
    "newline": _table(b"\n"),
    "wide": np.arange(256) >= 128,
}


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: the number of distinct values, and how often the most frequent occurs."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(values)))
    top = np.zeros(n)
    np.maximum.at(top, rows[first], often)
    return np.bincount(rows[first], minlength=n), top


def _inside(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of marked bytes of each row."""
    out = np.zeros(len(offsets) - 1)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(marked, offsets[filled], dtype=np.int64)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    rows, starts, ends = blocks.words(data, offsets)
    n_words = np.bincount(rows, minlength=n)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n_words)}
    for name, table in _CLASSES.items():
        out[name] = _inside(table[data], offsets) * per_byte
    length = ends - starts
    out["word_bytes"] = np.bincount(rows, length, n) * per_word
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    out["longest_word"] = longest
    out["short_words"] = np.bincount(rows[length <= 3], minlength=n) * per_word
    for name, table, least in (("symbol_words", _CLASSES["symbol"] | _CLASSES["bar"] | _CLASSES["bang"], 1), ("upper_words", _CLASSES["upper"], 2)):
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        out[name] = np.bincount(rows[total[ends] - total[starts] >= least], minlength=n) * per_word
    h = blocks.hashes(data, starts, ends)
    kinds, top = _distinct(h, rows, n)
    out["distinct_words"], out["top_word"] = kinds * per_word, top * per_word
    run = np.zeros(n)
    total_runs = np.zeros(n)
    if len(h) > 3:
        same = rows[3:] == rows[:-3]
        fours = (blocks.mix(h[:-3] * np.uint64(3) + h[1:-2]) + blocks.mix(h[2:-1] * np.uint64(5) + h[3:]) * np.uint64(7))[same]
        run, _ = _distinct(fours, rows[:-3][same], n)
        total_runs = np.bincount(rows[:-3][same], minlength=n)
    out["distinct_runs"] = np.where(total_runs > 0, run / np.maximum(total_runs, 1), 1.0)
    ls, le = blocks.runs(data != 10, offsets)
    lrows = blocks.row_of(ls, offsets)
    n_lines = np.bincount(lrows, minlength=n)
    kinds, _ = _distinct(blocks.hashes(data, ls, le), lrows, n)
    out["distinct_lines"] = np.where(n_lines > 0, kinds / np.maximum(n_lines, 1), 1.0)
    out["line_bytes"] = size / np.maximum(n_lines, 1)
    out["stop_per_word"] = out["stop"] * size * per_word
    return np.column_stack([out[f] for f in FEATURES]).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2, the leaves follow the inner nodes."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for labels ``y`` in {0, 1}; ``weight`` undoes unequal sampling of the classes."""
    inner, none = 2**depth - 1, np.zeros((0, 2**depth - 1), int)
    if not len(y):
        return Trees(0.0, none, none.astype(float), np.zeros((0, inner + 1)))
    rate_of = (np.sum(weight * y) + 1) / (np.sum(weight) + 2)
    base = float(np.log(rate_of / (1 - rate_of)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    n_features, total = x.shape[1], np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    flat = binned + np.arange(n_features) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = (((at - first) * n_features * bins)[:, None] + flat).ravel()
            shape = (nodes, n_features, bins)
            hist = [np.bincount(key, np.repeat(v, n_features), nodes * n_features * bins).reshape(shape).cumsum(2) for v in (g, h, weight)]
            (gl, hl, wl), (gt, ht, wt) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(wl < least) | (wt - wl < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // bins, best % bins
            for k in range(nodes):
                if gain[k, f[k], b[k]] > 1e-9 and b[k] < len(cuts[f[k]]):
                    feat[first + k], thr[first + k] = f[k], cuts[f[k]][b[k]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feat[at]] > thr[at])
        out = at - inner
        value = rate * np.bincount(out, g, inner + 1) / (np.bincount(out, h, inner + 1) + ridge)
        total += value[out]
        feature.append(feat)
        threshold.append(thr)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in blocks.pieces(batch, "text"):
            x = statistics(*blocks.bytes_of(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most_per_class: int = 10_000) -> Trees:
    """Trees learnt from at most ``most_per_class`` rows of each class, outside the held-out fold."""
    sample = sample_labels(labels, label, most_per_class)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sampled_texts(documents, sample).mapInArrow(blocks.released(_measured), schema).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    sizes = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    weight = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            weight[y == k] = sizes.get(k, 0) / (y == k).sum()
    return grow(x, y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def with_score(documents: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``documents`` with ``name`` (0 to 1, higher is better) beside its columns."""
    kept = documents.select([c for c in documents.columns if c != name])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                s = shared.value.score(statistics(*blocks.bytes_of(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s)], [*piece.schema.names, name])

    return kept.mapInArrow(blocks.released(scored), schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
