"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import struct
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.llm import ann, blocks, bpe, graph, media, mixing, neardup, quality, sharding, toxicity, urls, warc
from junctura.llm.registry import oracle_sql, queries
from oracle import connection, rows

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "one", "one two three", "Same text here now", "same TEXT here now", "x" * 200_000, "word " * 30_000, "é ü ß", "tab\tline\nend", "idiot moron idiot"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, ties, repeated rows, a null id, and columns whose names clash with outputs."""
    data = [(i, t, None, 0.5, 7, "q") for i, t in enumerate(ODD)] + [(5, ODD[5], "src0", None, 7, "q"), (None, "no id at all here", "src1", 1.0, 8, None)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, score double, shard int, slot string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def none(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert rows(queries()[name](spark, SMALL).toPandas()) == rows(connection(SMALL).sql(oracle_sql()[name]).df())


# blocks


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc abc  abd", np.uint8)
    rows_, starts, ends = blocks.words(data, np.array([0, 3, 12]))
    h = blocks.hashes(data, starts, ends)
    assert h[0] == h[1] != h[2] and rows_.tolist() == [0, 1, 1]


# 1 sharding


def brute_shards(points, n):
    """The same tree, by sorting: points are (coordinates by axis, size)."""
    axes = sharding.AXES
    spread = [max(1, max(p[0][k] for p in points) - min(p[0][k] for p in points)) for k in range(5)]
    out = {}

    def split(node, k, first):
        if k == 1 or not node:
            for p in node:
                out[p[2]] = first
            return
        extent = [(max(p[0][a] for p in node) - min(p[0][a] for p in node)) / spread[a] for a in range(5)]
        axis = extent.index(max(extent))
        order = [axis, *(axes.index(t) for t in ("id", "crc") if axes.index(t) != axis)]
        node = sorted(node, key=lambda p: [p[0][a] for a in order])
        target, run = sum(p[1] for p in node) * (k // 2) / k, 0
        for at, p in enumerate(node):
            if run + p[1] >= target or at == len(node) - 1:
                break
            run += p[1]
        at += target - run > node[at][1] / 2
        split(node[:at], k // 2, first)
        split(node[at:], k - k // 2, first + k // 2)

    split(points, n, 0)
    return out


def test_shards_equal_brute_force(spark, documents):
    meta = sharding.metadata(documents).collect()
    want = brute_shards([(tuple(r[a] for a in sharding.AXES), r["size"], r.doc_id) for r in meta], 24)
    got = sharding.shards(documents).collect()
    assert {r.doc_id: r.shard for r in got} == want
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    totals = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(totals) - min(totals) < 2 * max(r["size"] for r in got)
    text = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in got)


@pytest.mark.parametrize("far", [False, True])
def test_shards_of_skewed_ids(spark, far):
    """One far id, and a third of the rows without id and with one text: still even shards and bounded buckets."""
    data = [(i, f"text {i % 17} " * (1 + i % 5)) for i in range(600)] + [(None, "the same")] * 300 + ([(1 << 60, "far")] if far else [])
    got = sharding.shards(spark.createDataFrame(data, "doc_id long, text string"), 6, bucket_rows=20).collect()
    assert len(got) == len(data)
    for shard in range(6):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    totals = [sum(r["size"] for r in got if r.shard == s) for s in range(6)]
    assert max(totals) - min(totals) < 2 * max(r["size"] for r in got)


def test_ranks_are_gapless_and_in_order(spark):
    from junctura.llm.ranking import order_key, ranked

    rows_ = spark.createDataFrame([("a", i % 40 if i % 3 else None, i % 5) for i in range(900)] + [("b", i, 0) for i in range(50)], "g string, id long, crc long")
    keyed = rows_.withColumn("n", F.monotonically_increasing_id()).withColumn("_key", order_key(F.col("id"), F.col("crc"), F.col("n"))).withColumn("k", F.col("_key"))
    for bucket_rows in (4, 1000):
        for g in "ab":
            got = sorted((r["rank"], r.k) for r in ranked(keyed, "g", "rank", bucket_rows).collect() if r.g == g)
            assert [k for k, _ in got] == list(range(len(got))) and [k for _, k in got] == sorted(k for _, k in got)


def test_shards_of_odd_rows(odd):
    got = sharding.shards(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.shard < 24 for r in got)
    assert sharding.shards(none(odd)).count() == 0
    small = sharding.shards(odd, 3).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(small) >= 2


# 2 near duplicates


def brute_components(docs, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = (t or "").translate(lower).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    docs = [(i, edited(base, rng, rng.randrange(7))) for i in range(120)]
    docs += [(200 + i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    docs += [(400 + i, docs[i][1]) for i in range(20)] + [(500, None), (501, " "), (502, "a b"), (503, "A  b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 4)
    for part in (512, 16):  # small parts: links across the parts of a cluster
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 4, part_rows=part).collect()}
        assert got == want


def test_near_duplicates_of_odd_rows(odd):
    got = neardup.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == 0 and by[0].kept and by[1].component_id == 1 and by[None].component_id is None and by[None].kept
    assert by[6].component_id == 5 and not by[6].kept
    assert neardup.near_duplicates(none(odd)).count() == 0


def test_no_links_of_tiny_texts_are_lost():
    """20,000 pairs of 4 to 20 shingles at 0.8 to 0.85: every one shares a band and is confirmed."""
    rng, lost = random.Random(11), 0
    for at in range(0, 20_000, 1000):
        texts = []
        for _ in range(1000):
            n = rng.randrange(4, 18)
            words_ = [f"w{rng.randrange(10**7)}" for _ in range(n + 3)]
            more = [f"w{rng.randrange(10**7)}" for _ in range(max(1, n // 4 - (n % 4 == 0 and n > 8 and rng.random() < 0.5)))]
            texts += [" ".join(words_), " ".join(words_ + more)]
        m = neardup._Members(list(range(2000)), texts, 4)
        keys = neardup.band_keys(m.regs)
        for a in range(0, 2000, 2):
            assert 100 * m.sizes[a] >= 80 * m.sizes[a + 1]
            links = neardup._Links(2000)
            neardup._compare(m, links, np.array([a]), np.array([a + 1]), 80)
            lost += not links.found or not (keys[a] == keys[a + 1]).any()
    assert lost == 0


def test_tiny_texts_link_through_the_operator(spark):
    rng = random.Random(12)
    docs = [(0, "w3611917 w658991 w583130 w4471226 w5685933 w5043618 w3898531"), (1, "w3611917 w658991 w583130 w4471226 w5685933 w5043618 w3898531 w9273783")]
    for k in range(400):
        words_ = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice((7, 7, 8, 11)))]
        docs += [(10 + 2 * k, " ".join(words_)), (11 + 2 * k, " ".join([*words_, f"x{k}"]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert all(got[i] == i - i % 2 for i, _ in docs)


def test_jaccard_estimates():
    rng = np.random.default_rng(1)
    tokens = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (2000,)]
    for keep in (0.9, 0.5):
        other = np.sort(np.concatenate([tokens[0][: int(2000 * keep)], rng.integers(0, 2**64, 2000 - int(2000 * keep), dtype=np.uint64)]))
        sets, part = np.concatenate([tokens[0], other]), np.array([0, 2000, 4000])
        regs = neardup.registers(sets, part)
        true = keep / (2 - keep)
        assert abs(neardup.estimated(regs[:1], regs[1:])[0, 0] - true) < 5 * math.sqrt(true * (1 - true) / neardup.REGISTERS)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


HARD = ["it's o'clock we'll DON'T", "foo<|endoftext|>bar <|ENDOFTEXT|>", "é École …,—   x y", "1234 5.5% a1b2", "İstanbul ŁÓDŹ", "日本語 テスト", "\x00\x01 a\x1cb \x7f", "\U0001f469‍\U0001f467 ok!!", "×÷ßÿ Été", "ﬁ ™ ½", "<| |> <|", "a" * 3000]


@pytest.mark.parametrize("most", [400_000, 40])
def test_bpe_equals_library(spark, odd, documents, most):
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(HARD, 1000)), "doc_id long, text string")).unionByName(documents.select(F.col("doc_id") + 5000, "text").toDF("doc_id", "text"))
    tokenizer, want = library(), []
    for r in df.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.encode_documents(df, bpe.default_path(), most).collect()]
    assert sorted(got) == sorted(want)


def test_bpe_of_nothing(odd):
    assert bpe.encode_documents(none(odd), bpe.default_path()).count() == 0


def test_decode_joins_pieces(spark):
    tokenizer = library()
    ids = tokenizer.encode("the quick brown fox", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, bpe.vocabulary(spark, bpe.default_path())).collect()}
    assert got == {1: tokenizer.decode(ids, skip_special_tokens=False), 2: ""}


def test_word_table_decodes_by_the_join(spark):
    """A piece changed in the id-to-piece table shows in the word's decoded text, so nothing else decodes."""
    with open(bpe.default_path(), encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    words = bpe.word_table(spark.createDataFrame([("quick", 3), ("zzxqyw", 1), ("\u3000", 1)], "word string, n long"), content)
    changed = bpe.vocabulary(spark, bpe.default_path()).withColumn("piece", F.concat(F.lit("*"), "piece"))
    got = {r.word: r for r in bpe.decoded_words(words, changed).collect()}
    assert got["\u3000"].size == 0 and got["\u3000"].decoded == "" and got["zzxqyw"].size > 1
    for r in got.values():
        assert len(r.ids.split()) == r.size and sum(p.startswith("*") for p in r.decoded.split()) == r.size


# 4 urls


def test_url_filter(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net": ("example.net", "", None, "allow"), "https://x.example.net/de": ("x.example.net", "/de", "net/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://q.org/fr/a#b": ("q.org", "/fr/a", "org/fr/", "allow"), "http://a.com/casino": ("a.com", "/casino", None, "block"),
        "http://a.com/casinos": ("a.com", "/casinos", None, "allow"), "http://a.com/free": ("a.com", "/free", None, "allow"), "http://a.com/free-bonus": ("a.com", "/free-bonus", None, "block"), "http://a.com/free-free": ("a.com", "/free-free", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == cases
    assert urls.filter_urls(none(df)).count() == 0


def test_url_weights_boundaries_and_long_urls(spark):
    terms = (("bad", 1, "strict"), ("poker", 1, "soft"), ("free", 0.5, "soft"), ("win", 0.5, "soft"), ("freewin", 1, "soft"))
    far = "http://a.com/" + "x/" * 100_000
    cases = {"http://a.com/poker/free": (0, 1.5, "allow"), "http://a.com/POKER/free-win": (0, 2.0, "block"), "http://a.com/badly": (0, 0.0, "allow"), far + "bad": (1, 0.0, "block"), far: (0, 0.0, "allow"), "http://a.com/freewin": (0, 1.0, "allow"), "http://a.com/win/win/win": (0, 0.5, "allow")}
    df = spark.createDataFrame([(i, u, 7, "x") for i, u in enumerate([*cases, "http://a.com/badly"])], "page_id long, url string, _hits int, Verdict string")
    got = urls.filter_urls(df, terms=terms).collect()
    assert len(got) == len(cases) + 1 and "_hits" in got[0].asDict() and "Verdict" not in got[0].asDict()
    assert {r.url: (r.strict_terms, r.soft_weight, r.verdict) for r in got} == cases
    assert {r.verdict for r in urls.filter_urls(df, terms=()).collect()} == {"allow"}
    for bad in ((("a", 2, "soft"),), (("a", 1, "soft"), ("A", 1, "strict")), (("", 1, "soft"),)):
        with pytest.raises(ValueError):
            urls.checked(bad)


# 5 nearest neighbours


def brute_nearest(data, k):
    out = {}
    for q, v in data:
        if q % 100 == 0:
            out[q] = sorted((math.dist(v, w), i) for i, w in data if i != q)[:k]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    data = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    data += [(5000 + i, data[0][1]) for i in range(200)]  # one frequent vector
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), part_rows=700, ask_rows=9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = brute_nearest(data, 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q].values()}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = dict(data)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11)) and list(found.values()) == [found[k] for k in sorted(found)]
        assert all(abs(math.dist(exact[q], exact[i]) - s) < 1e-9 for s, i in found.values())
    assert [i for _, i in (got[0][k] for k in range(1, 11))] == list(range(5000, 5010))


def test_nearest_of_ids_with_several_vectors(spark):
    """Every id is one candidate at its nearest vector; scores are those of the vectors."""
    near, far = [1.0, 0.0], [9.0, 1.0]
    frame = spark.createDataFrame([(1, near), (1, far), (100, near), (7, far)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.nearest(frame).collect()}
    assert got == {1: 0.0, 7: math.dist(near, far)}
    rng = np.random.default_rng(8)
    data = [(int(i), rng.normal(size=6).tolist()) for i in [*range(0, 420), *rng.integers(0, 420, 500), *([33] * 300)]]
    want = {}
    for q, v in data:
        if q % 100 == 0:
            for i, w in data:
                if i != q:
                    want.setdefault(q, {})[i] = min(math.dist(v, w), want.get(q, {}).get(i, math.inf))
    found = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), part_rows=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(want[r.query_id][r.vec_id] - r.score) < 1e-9
    assert {q: len(set(ids)) for q, ids in found.items()} == dict.fromkeys(want, 10)
    best = {q: sorted(c, key=lambda i: (c[i], i))[:10] for q, c in want.items()}
    assert sum(len(set(best[q]) & set(found[q])) for q in want) >= 0.9 * 10 * len(want)


def test_nearest_of_odd_vectors(spark):
    data = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, 1.0], 1), (6, [1.0, 1.0], 1), (7, [1.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect()] == [(0, 1, 6, 1.0)]
    assert ann.nearest(none(df)).count() == 0


# 6 toxicity and 9 quality


def accuracy(scored, labels, column, at):
    both = scored.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    return sum((r.score >= at) == (r[column] == 1) for r in both) / len(both)


def test_toxicity_on_the_held_out_fold(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels), evidence="evidence")
    assert accuracy(scored, labels, "toxic", 0.5) >= 0.95
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((300, 40)) < 0.15, rng.random((300, 40)), 0)
    dense[5] = dense[6] = dense[7]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-9)[:, None]
    r, t = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(r, t, dense[r, t], 300, 40, block=16)
    for q in range(0, 300, 7):
        terms = np.flatnonzero(dense[q])
        _, at, near = index.nearest_of(np.zeros(len(terms), np.int64), terms, dense[q][terms], 1, 9, np.array([q]))
        sims = dense @ dense[q]
        sims[q] = 0
        want = [k for k in np.lexsort((np.arange(300), -np.round(sims, 12))) if sims[k] > 0][:9]
        assert at.tolist() == want and np.allclose(near, sims[want])


def test_nearest_examples_with_few_dense_terms_equal_brute_force():
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((300, 120)) < rng.random(120) * 0.3, rng.random((300, 120)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-9)[:, None]
    r, t = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(r, t, dense[r, t], 300, 120, block=8, dense=6)
    for q in range(0, 300, 7):
        terms = np.flatnonzero(dense[q])
        _, at, near = index.nearest_of(np.zeros(len(terms), np.int64), terms, dense[q][terms], 1, 9, np.array([q]))
        sims = dense @ dense[q]
        sims[q] = 0
        want = [k for k in np.lexsort((np.arange(300), -np.round(sims, 12))) if sims[k] > 0][:9]
        assert at.tolist() == want and np.allclose(near, sims[want])


def test_each_block_has_dense_terms_of_its_own():
    """Rows of four languages: none of their terms is left to postings, though a quarter of the terms is dense in a block, and searches stay exact."""
    rng = np.random.default_rng(3)
    dense = np.zeros((160, 80))
    for g in range(4):
        dense[g::4, 20 * g : 20 * g + 20] = 0.1 + rng.random((40, 20))
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    r, t = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(r, t, lambda at: dense[r[at], t[at]], 160, 80, block=40, dense=20)
    assert index.spread(np.arange(80)).sum() == 0
    queries = np.where(rng.random((50, 80)) < 0.3, rng.random((50, 80)), 0)
    q, at, near = index.nearest_of(*np.nonzero(queries), queries[np.nonzero(queries)], 50, 7)
    sims = np.round(queries @ dense.T, 12)
    want = np.argsort(-sims, axis=1, kind="stable")[:, :7]
    assert q.tolist() == np.repeat(np.arange(50), 7).tolist()
    assert np.allclose(near.reshape(50, 7), np.take_along_axis(sims, want, 1)) and at.reshape(50, 7).tolist() == want.tolist()


def test_memory_of_scoring_many_texts_is_bounded():
    """Texts that share a search are cut into terms a part at a time."""
    vocabulary = np.sort(toxicity.terms(*blocks.bytes_of(pa.array(["plain words"])))[1])
    one = np.zeros(1, np.int64)
    model = toxicity.Neighbours(vocabulary, np.ones(len(vocabulary)), one, one, np.ones(2), np.arange(len(vocabulary), dtype=np.int32), np.ones(len(vocabulary), np.int32), np.array([0, len(vocabulary)]), 15)
    data, offsets = blocks.bytes_of(pa.array([" ".join(f"word{chr(97 + (i + k) % 26)}" for k in range(300)) + " plain" for i in range(1160)]))
    model.index()
    tracemalloc.start()
    scores, _ = model.judge(data, offsets, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 2_000_000 and len(scores) == 1160 and peak < 60e6


def test_terms_of_a_single_example_count(spark):
    """Each example has words of its own only; a copy of it must find it, though no word tells the classes apart."""
    words = ["zarn", "quib", "molt", "frez", "dwul", "hibb", "yost", "pelk", "vunt", "grax"]
    docs = spark.createDataFrame([(i, f"{words[i % 10]}a {words[i % 10]}b {words[i % 10]}c") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    learnt = {r.doc_id for r in marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).collect()}
    model = toxicity.fit(docs, marks)
    assert len(learnt) >= 5 and len(model.vocabulary) == 4 * len(learnt)
    for r in toxicity.with_score(docs, model, evidence="evidence").collect():
        found = [(e.example, e.label, round(e.similarity, 9)) for e in r.evidence]
        assert found == ([(r.doc_id % 10, r.doc_id % 2, 1.0)] if r.doc_id % 10 in learnt else [])


def test_toxicity_equals_dense_cosine(spark, labels):
    """Evidence and scores of whole documents against TF-IDF vectors kept as dicts."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, labels)

    def vector(text):
        low = (text or "").encode()
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in low)
        found = {}
        for word in re.findall(rb"[a-z\x80-\xff]+", low):
            for term in (word, (b"stem", word[:4])) if len(word) > 4 else (word,):
                found[term] = found.get(term, 0) + 1
        return found

    texts = {r.doc_id: vector(r.text) for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    learnt = [i for i in sorted(texts) if marks.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    assert model.ids.tolist() == learnt
    known = {t for i in learnt for t in texts[i]}
    frequency = {}
    for v in texts.values():
        for t in v:
            frequency[t] = frequency.get(t, 0) + 1
    idf = {t: math.log((1 + len(texts)) / (1 + frequency[t])) + 1 for t in known}

    def unit(v):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in v.items() if t in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    examples = {i: unit(texts[i]) for i in learnt}
    scored = {r.doc_id: r for r in toxicity.with_score(docs, model, evidence="evidence", shown=15).collect()}
    for i in sorted(texts)[::40]:
        q = unit(texts[i])
        near = sorted(((-round(sum(x * e.get(t, 0) for t, x in q.items()), 9), j) for j, e in examples.items()))[:15]
        near = [(j, -s) for s, j in near if s < 0]
        got = scored[i]
        assert [round(e.similarity, 9) for e in got.evidence] == [s for _, s in near]
        assert len({e.example for e in got.evidence} & {j for j, _ in near}) >= len(near) - 1  # the last may tie
        assert [e.label for e in got.evidence] == [marks[e.example] for e in got.evidence]
        if near:
            weight = [model.class_weight[e.label] / (1.05 - e.similarity) for e in got.evidence]
            vote = sum(w * e.label for w, e in zip(weight, got.evidence, strict=True)) / sum(weight)
            assert abs(got.score - np.interp(vote, model.at, model.value)) < 1e-9


def test_repeated_ids_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three four")] * 50 + [(2, "five six")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    first, again = (toxicity.fit(d, marks) for d in (docs, docs.orderBy(F.desc("text"))))
    assert first.ids.tolist() == again.ids.tolist() and len(set(first.ids)) == len(first.ids)
    assert (first.vocabulary == again.vocabulary).all()


def test_isotonic():
    at, value = toxicity.isotonic(np.array([0.0, 0.5, 0.5, 1.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()


def test_quality_on_the_held_out_fold(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert accuracy(quality.with_score(docs, quality.fit(docs, labels)), labels, "quality", 0.3) >= 0.95


def test_trees_in_arrays_equal_a_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    trees = quality.grow(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float), np.ones(500), rounds=12)
    inner = trees.feature.shape[1]
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            k = 0
            while k < inner:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - inner]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, odd, labels, module):
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for m in (marks, none(marks)):
        scored = module.with_score(odd, module.fit(odd, m))
        assert scored.columns.count("score") == 1 and scored.count() == odd.count()
        assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert module.with_score(none(odd), module.fit(none(odd), marks)).count() == 0


# 7 WARC


def test_warc_links(spark):
    html = '<html><head><title>T &amp; x</title><script>var t="</p>";</script></head><body><p>One<br>two</p><a href="/x">link</a><!-- c --></body></html>'
    df = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    made = {r.page_id: r for r in warc.derivatives(warc.responses(df)).collect()}
    r = made[1]
    assert r.text == "One\ntwo\nlink" and r.title == "T & x" and r.n_links == 1
    assert r.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    head, _, block = r.conversion_record.partition("\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert fields["WARC-Refers-To"] == r.record_id and fields["WARC-Type"] == "conversion" and int(fields["Content-Length"]) == len(r.text.encode())
    assert block[: len(r.text)] == r.text and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.text.encode()).hexdigest()
    assert made[2].text == "" and len({x.record_id for x in made.values()}) == 3
    assert warc.derivatives(warc.responses(none(df))).count() == 0


def parsed(html):
    """Words and title of a page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.words, self.title, self.links = [], [], "", 0

        def handle_starttag(self, tag, attrs):
            self.links += tag == "a" and "href" in dict(attrs)
            if tag in ("script", "style", "head", "title"):
                self.inside.append(tag)

        def handle_endtag(self, tag):
            if tag in self.inside:
                self.inside.remove(tag)

        def handle_data(self, data):
            if "title" in self.inside:
                self.title += data
            if not self.inside:
                self.words += data.replace("\xa0", " ").split()

    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.words, " ".join(reader.title.split()), reader.links


BROKEN = [
    "<head><script>x()</script><title>T\none</title></head><p>after", "<style>a</script>b{}</style>text", "<script>if (a < b) { '</p>' }</script><p>x</p>", "<!-- <script> --> shown <!-- --> too",
    '<a title="a>b" href=\'/x\'>link</a> <a href=/y data-x=1>two</a> <a name=z>no</a>', "1 < 2 and 3 > 2 &lt;b&gt; &amp;lt; &#233;&#xE9;&eacute;&copy;&nbsp;x &unknown; &#0; AT&T &", "<p it's>quote</p> 'after'>",
    "<b>unclosed <i>tags<br>and<hr/>breaks", "<header>kept</header><div data-href='n'>no link</div>", "plain text only", "<SCRIPT>x</SCRIPT >y<STYLE>z</STYLE>w",
]


def test_plain_text_equals_a_parser(spark):
    pages = [(i, h) for i, h in enumerate(BROKEN)] + [(100 + r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, "u", h, "clash", "clash") for i, h in pages], "page_id long, url string, html string, text string, page string")
    for r in warc.derivatives(warc.responses(df)).collect():
        words_, title, links = parsed(dict(pages)[r.page_id])
        if r.page_id != 5:  # a parser makes U+FFFD of &#0;
            assert (r.text.split(), r.title, r.n_links) == (words_, title, links), r.page_id
        else:
            assert r.text == "1 < 2 and 3 > 2 <b> &lt; ééé© x &unknown; &#0; AT&T &"


def test_warc_of_long_and_hostile_pages(spark):
    long = "<p " + "a='1' " * 20_000 + ">" + "<b>word " * 50_000 + "<script>" * 3
    df = spark.createDataFrame([(1, "http://a/\r\nX: y", long, "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", "2020-01-02T03:04:05Z"), (1, None, "<" * 50_000, None, None)], "page_id long, url string, html string, http_header string, warc_date string")
    made = sorted(warc.derivatives(warc.responses(df)).collect(), key=lambda r: r.target)
    assert made[1].text.split() == ["word"] * 50_000 and made[0].text == "<" * 50_000
    head = made[1].conversion_record.split("\r\n\r\n")[0].split("\r\n")
    assert "WARC-Date: 2020-01-02T03:04:05Z" in head and "WARC-Target-URI: http://a/%0D%0AX: y" in head and "Server: s\r\n" in made[1].metadata_record
    assert "WARC-Date" not in made[0].conversion_record


@pytest.mark.parametrize("piece", ["<a", "<a ", "<br ", "<title>", "<head>", "<script ", "<a href='", "<p x=\"", "</script ", "<!--", "&#", "<a b='<a c=\"", "= <"])
def test_warc_reads_a_page_once(piece):
    """A megabyte of anything that never ends takes seconds, where going back would take hours."""
    began = time.process_time()
    warc.scanned(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 5


def test_warc_counts_links_of_any_length():
    for n in (1, 499, 501, 20_000):
        assert warc.scanned("<a " + " ".join(f"d{k}=1" for k in range(n)) + " href='u'>x</a>") == ("  x ".replace("  ", " "), "", 1)
    assert warc.scanned("before <a href='u' never ends")[::2] == ("before  ", 0)


def test_warc_of_random_pages_equals_a_parser():
    rng = random.Random(7)
    quoted = lambda: rng.choice(["'", '"'])

    def tag():
        name, out = rng.choice(["a", "p", "div", "span", "b", "A"]), []
        for _ in range(rng.choice([0, 1, 3, 600])):
            q = quoted()
            out.append(rng.choice([f" x={q}a>b{q}", " data-y=1", f" title = {q}<i>{q}", " checked", f" z{rng.randint(0, 9)}={q}{q}"]))
        if rng.random() < 0.5:
            out.insert(rng.randint(0, len(out)), f" {rng.choice(['href', 'HREF', 'data-href'])}='/u'")
        return f"<{name}{''.join(out)}>"

    for _ in range(60):
        page = "".join(rng.choice([tag(), "word ", "1 < 2 ", "</p>", "<!-- <a href=x> -->", "<script>if (a<b) '<a href=x>'</script>", "<br>"]) for _ in range(40))
        words_, _, links = parsed(page)
        text, _, found = warc.scanned(page)
        assert (text.split(), found) == (words_, links), page[:300]


# 8 mixing


def test_pattern_deviates_by_less_than_one():
    weights = {"a": 7, "b": 3, "c": 1, "d": 5}
    seen = dict.fromkeys(weights, 0)
    for slot, name in enumerate(mixing.pattern(weights), 1):
        seen[name] += 1
        assert all(abs(seen[k] - slot * w / 16) < 1 for k, w in weights.items())
    assert seen == weights


def holds_bound(got, weights, block):
    """Every prefix of each epoch: each source with rows left differs from its share by less than one block."""
    got = sorted(got, key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    assert sorted({r.slot for r in got}) == list(range(1 + max(r.slot for r in got)))
    assert [(r.epoch, r.slot) for r in got] == sorted((r.epoch, r.slot) for r in got)
    left = {}
    for r in got:
        left[r.mix_group] = left.get(r.mix_group, 0) + 1
    for epoch in sorted({r.epoch for r in got}):
        live = {g: weights[g] for g in left if left[g]}
        inside, seen = [r for r in got if r.epoch == epoch], dict.fromkeys(live, 0)
        for n, r in enumerate(inside, 1):
            assert r.in_mix == (epoch == 0)
            seen[r.mix_group] += 1
            left[r.mix_group] -= 1
            for g, w in live.items():
                assert abs(seen[g] - n * w / sum(live.values())) < block
        assert sum(not left[g] for g in live) == 1  # an epoch ends where one source runs out
    assert not any(left.values())


def test_mix_of_hot_sources(spark):
    """A hot source, repeated null ids, a weight without rows, sources that run out at different times, columns with clashing names."""
    data = [(i, "t", "hot" if i % 3 else f"s{i % 7}", i) for i in range(2000)] + [(None, None, None, 1)] * 60
    df = spark.createDataFrame(data, "doc_id long, text string, source string, position int")
    weights = {"hot": 2, "s0": 1, "none": 5, "s3": 3, "rest": 1}
    got = mixing.mix(df, weights, 10, 8).collect()
    assert len(got) == len(data)
    holds_bound(got, weights, 10)
    ordered = mixing.ordered(df, weights, 10, 8, part_rows=300)
    of = {(r.doc_id, r.mix_group): r.position for r in got}
    assert ordered.dtypes == df.dtypes and ordered.rdd.getNumPartitions() == 7
    ordered = ordered.collect()
    assert sorted(map(str, ordered)) == sorted(map(str, df.collect()))
    places = [(k, of[r.doc_id, r.source if r.source in weights else "rest"]) for k, r in enumerate(ordered) if r.doc_id is not None]
    assert all(k == place for k, place in places)
    assert mixing.mix(none(df), weights).count() == 0 and mixing.ordered(none(df), weights).count() == 0
    for bad in ({"hot": 1}, {"hot": 0, "rest": 1}):
        with pytest.raises(ValueError):
            mixing.mix(df, bad)


def test_mix_of_the_documents_holds_the_bound(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), mixing.WEIGHTS, 4).collect()
    holds_bound(got, mixing.WEIGHTS, 4)
    assert sum(r.in_mix for r in got) > 300


# 10 media


def wave_file(samples, width, channels=1):
    """A file by the standard library."""
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(8000)
        file.writeframes(samples)
    return out.getvalue()


def test_right_declared_types_stay(spark):
    import io
    import zipfile

    class Pipe(io.BytesIO):
        def seekable(self):
            return False

        def tell(self):
            raise OSError

    streamed = Pipe()  # entries get their sizes in descriptors after the data
    with zipfile.ZipFile(streamed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text " * 100)
        z.writestr("b.txt", b"PK\5\6 within")
    many = "".join(f"# line {k}\n" for k in range(20))
    cases = [
        ("audio/wav", wave_file(b"\0\1" * 50, 2, 1)), ("audio/wav", wave_file(b"\0\1\2" * 50, 3, 2)), ("application/zip", streamed.getvalue()),
        ("image/x-portable-graymap", f"P5\n{many}2 2\n# depth\n255\n".encode() + b"\0\1\2\3"), ("image/x-portable-graymap", b"P5 2 1 65535\n" + b"\0\1\2\3"),
        ("image/jpeg", b"\xff\xd8\xff\xe0\0\x10JFIF\0"), ("video/mp4", b"\0\0\0\x18ftypmp42"), ("text/plain", b"plain"),
    ]
    frame = spark.createDataFrame([(k, b, t) for k, (t, b) in enumerate(cases)], "id int, media binary, said string")
    for r in media.sniff_media(frame, declared="said").collect():
        assert (r.media_type, r.corrected) == (cases[r.id][0], False), r.id
    wrong = spark.createDataFrame([(0, cases[0][1], "image/jpeg"), (1, b"no sound", "audio/wav")], "id int, media binary, said string")
    assert [(r.media_type, r.corrected) for r in media.sniff_media(wrong, declared="said").orderBy("id").collect()] == [("audio/wav", True), (None, True)]
    for kind, blob in cases[:5]:
        assert (7, len(blob), kind) in media.sniff(b"before " + blob, media.automaton())


def test_media_round_trip(odd):
    made = media.read_samples(media.text_media(odd.select("doc_id", "text"))).collect()
    assert len(made) == odd.count()
    for r in made:
        if r.doc_id is None:
            continue
        raw = (ODD[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(wave_file(payload, 1)).hexdigest()
    assert media.read_samples(media.text_media(none(odd))).count() == 0


def test_sniffing_corrects_and_carves(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav, pgm = media.wav_of(b"\1" * 64), b"P5\n2 2\n255\n\0\1\2\3"
    rows_ = [(1, wav, "image/png"), (2, b"junk" + png + b"P5\n9 9\n255\nshort", None), (3, pgm + png, "image/x-portable-graymap"), (4, None, "audio/wav"), (5, b"", None), (6, png[:-3] + b"bad", "image/png")]
    got = {r.id: r for r in media.sniff_media(spark.createDataFrame(rows_, "id int, media binary, said string"), declared="said").collect()}
    assert (got[1].media_type, got[1].corrected) == ("audio/wav", True)
    assert got[2].media_type is None and [(e.offset, e.type, bytes(e.content)) for e in got[2].embedded] == [(4, "image/png", png)]
    assert (got[3].media_type, got[3].corrected, got[3].embedded[0].offset) == ("image/x-portable-graymap", False, len(pgm))
    assert got[4].media_type is None and got[4].corrected and got[5].embedded == [] and got[6].media_type is None


def test_other_containers():
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
    for blob, kind in ((held.getvalue(), "application/zip"), (gzip.compress(b"x" * 1000), "application/gzip"), (gif, "image/gif")):
        assert (0, len(blob), kind) in media.sniff(blob + b"tail", media.automaton())
