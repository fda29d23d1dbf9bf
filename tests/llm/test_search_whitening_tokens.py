"""Ranked search, whitening and token files against brute force, dense algebra and round trips."""

import math
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from junctura.llm import blocks, bpe, lexical, tokenfile, whitening

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " .,;", "one", "One one TWO", "one one two", "one one two", "é ü ß straße", "x" * 100_000, "word " * 30_000, "a\x00b", "<|endoftext|> it's", "T̈ ẗ", "日本語 テキスト"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, ties, repeated rows, null ids, and columns whose names clash with outputs."""
    rows = [(i, t, 1, 2.5, "q", 0) for i, t in enumerate(ODD)] + [(5, ODD[5], 1, 2.5, "q", 0), (5, "two one", 1, None, "q", 0), (None, "one of none", None, None, None, 0), (None, None, 1, 1.0, "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, score double, shard string, n int")


# 11 ranked search


def brute_ranks(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    texts = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    out = []
    for item, text in items:
        scored = []
        for i, words in texts:
            score = 0
            for term in split(text):
                tf, df = words.count(term), sum(term in set(w) for _, w in texts)
                if tf:
                    m = 25 + 75 * len(words) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block_docs": 2, "shard_bytes": 64}])
def test_search_of_odd_rows_equals_brute_force(spark, odd, options):
    items = [(1, "one Two one"), (2, None), (3, ""), (4, "no such words"), (5, "straße é"), (5, "two"), (None, "word テキスト")]
    found = lexical.rank_documents(odd, spark.createDataFrame(items, "item_id long, text string"), k=3, batch=4, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranks(odd.select("doc_id", "text").collect(), items, 3)


def test_search_prunes_and_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(1200)]
    docs += [(2000 + i, "w1 w2 w3 rare passage") for i in range(40)]  # copies tie
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), [(0, "w1 w2 w3 rare passage"), (1, "w7"), (2, "w9 w9 w10")]
    found = lexical.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), block_docs=8, shard_bytes=4096)
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranks(docs, items)
    # The first query's threshold leaves most blocks unopened.
    built, n, _ = lexical.index(frame, block_docs=8, shard_bytes=4096)
    queries = lexical.queries_of([items[0][1]])
    queries.weight = np.full(len(queries.words), 1000)
    ((low, used, matrix),) = queries.groups()
    bounds = np.concatenate([lexical._Shard(r.asDict(), queries).bounds(used, matrix)[:, 0] for r in built.collect()])
    scores = np.concatenate([lexical._Shard(r.asDict(), queries).scores(b, used, matrix).max(0, initial=0) for r in built.collect() for b in range(len(r["docs"]))])
    assert (bounds >= scores).all() and (bounds >= np.sort(scores)[-5]).mean() < 0.2


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.rank_documents(odd.limit(0), items).count() == 0
    assert lexical.rank_documents(odd, items.limit(0)).count() == 0


def test_impacts_do_not_overflow():
    big = np.array([10**12])
    assert lexical.impacts(np.array([3]), big, 10**10, 10**13).tolist() == [3 * 10**9 // (3000 + 8 * (25 + 75 * 10**12 * 10**10 // 10**13))]


@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
def test_keys_depend_on_the_bytes_alone(parts):
    data = np.frombuffer(b"".join(parts) + b"tail", np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    h = blocks.keys(data, ends - [len(p) for p in parts], ends)
    assert len(set(h.tolist())) == len(set(parts))
    assert all(blocks.keys(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] == v for p, v in zip(parts, h, strict=True))


# 12 whitening


def dense(x, k):
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    return e[::-1][:k], u[:, ::-1][:, :k]


def test_whitening_equals_dense_algebra(spark):
    found = whitening.whiten(spark.read.parquet(f"{SMALL}/embeddings.parquet")).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack(rows.embedding).astype(float)) + 100_000
    e, u = dense(x, 8)
    table = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(np.abs(table), np.abs((x - x.mean(0)) @ u / np.sqrt(e)), atol=1e-8)
    assert np.allclose(found.groupby("component").explained.first(), e / np.trace(np.cov(x.T, bias=True)), rtol=1e-12)
    assert found.identity_error.nunique() == 1 and 0 < found.identity_error[0] < 1e-10 and set(found.n) == {len(x)}
    n, whole = len(x), x.astype(int)
    exact = dict(zip(rows.vec_id, ((n * whole - whole.sum(0)) ** 2).sum(1), strict=True))
    assert dict(zip(found.vec_id, found.deviation, strict=True)) == exact


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.5, 0.25]), (2, [1.0, 0.5, 0.25]), (None, [0.3, -0.2, 0.1]), (4, [0.3, -0.4, 0.1])]
    odd = [(5, None), (6, [1.0, None, 0.0]), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0]), (10, [])]
    frame = spark.createDataFrame([(i, v, 9, "n") for i, v in fine + odd], "vec_id long, embedding array<float>, n int, whitened string")
    found = whitening.whiten(frame).toPandas()
    x = np.floor(1024 * np.array([v for _, v in fine], np.float32).astype(float)) + 100_000
    e, _ = dense(x, 3)
    assert len(found) == 5 * (e > 1e-9).sum() and found.vec_id.isna().sum() == (e > 1e-9).sum() and set(found.n) == {5}
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 2")).count() == 0  # equal vectors have no components


def test_deviation_beyond_a_long():
    far = whitening.Centre(10**9, np.array([0, 0]), 10**13)
    assert far.squared(np.array([[10**6, 0], [1, 2]])) == [None, 5 * 10**18]


@pytest.mark.parametrize("d, k", [(3, 8), (40, 8), (200, 5)])
def test_lobpcg_certifies(d, k):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(4 * d, d)) * np.linspace(1, 3, d)
    v = a.T @ a / len(a)
    found = whitening.lobpcg(lambda b: v @ b, d, min(k, d), np.trace(v), guard=4)
    e, u = np.linalg.eigh(v)
    k = min(k, d)
    assert np.allclose(found.values, e[::-1][:k], rtol=1e-12) and (found.residuals < 1e-10 * e[-1]).all()
    assert np.allclose(np.abs((found.vectors * u[:, ::-1][:, :k]).sum(0)), 1, atol=1e-12)


# 13 token files


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(values, kind):
    ids = np.array(values, np.uint32)
    assert tokenfile.ids_of(tokenfile.planes_of(ids, kind), len(ids), kind).tolist() == values


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=50), max_size=20), st.sampled_from(["bit", "byte"]), st.integers(1, 64))
def test_file_round_trip(tmp_path_factory, documents, kind, block_ids):
    uri = str(tmp_path_factory.mktemp("planes") / "x" / "a.planes")
    writer = tokenfile.Writer(uri, block_ids, kind)
    for d in documents:
        writer.add(np.array(d, np.uint32))
    writer.close()
    reader, at = tokenfile.Reader("file:" + uri), 0
    for d in documents:
        assert [i for part in reader.span(at, len(d)) for i in part.tolist()] == d
        at += len(d)


def test_damaged_files_are_refused(tmp_path):
    uri = str(tmp_path / "a.planes")
    writer = tokenfile.Writer(uri, 16, "byte")
    writer.add(np.arange(100, dtype=np.uint32))
    writer.close()
    raw = bytearray(open(uri, "rb").read())
    raw[len(raw) // 4] ^= 255
    open(uri, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017 - zstandard or the checksum
        list(tokenfile.Reader(uri).span(0, 100))
    open(uri, "wb").write(raw[:-3])
    with pytest.raises(ValueError):
        tokenfile.Reader(uri)


def library_rows(rows):
    encoder = bpe._tokenizer(open(bpe.default_path(), encoding="utf-8").read())
    out = []
    for i, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
    return out


@pytest.mark.parametrize("options", [{}, {"block_ids": 64, "kind": "byte", "part_bytes": 40_000}])
def test_tokens_of_odd_rows_equal_the_library(spark, odd, options):
    places = tokenfile.placed(tokenfile.write_tokens(odd, bpe.default_path(), **options))
    found = tokenfile.read_tokens(places).orderBy("start").collect()
    assert sorted((r["doc_id"], r["n"], r["ids_crc32"], r["ids"]) for r in found if r["doc_id"] is not None) == sorted(r for r in library_rows(odd.select("doc_id", "text").collect()) if r[0] is not None)
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n"] for r in found])[:-1]]).tolist()
    assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in found), key=lambda i: -1 if i is None else i)
    assert tokenfile.placed(tokenfile.write_tokens(odd.limit(0), bpe.default_path())).count() == 0


def test_tokens_of_whole_table_equal_the_library(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = tokenfile.op13_bit_planes(spark, SMALL)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    expected, at = [], 0
    for i, n, crc, _ in library_rows(documents.select("doc_id", "text").orderBy("doc_id").collect()):
        expected.append((i, at, n, crc))
        at += n
    assert sorted(map(tuple, found.collect())) == expected


def test_a_hot_id_is_spread_over_files(spark):
    rows = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    places = tokenfile.placed(tokenfile.write_tokens(rows, bpe.default_path(), part_bytes=2000))
    assert places.select("file").distinct().count() > 3
    assert tokenfile.read_tokens(places).select("ids_crc32").distinct().count() == 1
