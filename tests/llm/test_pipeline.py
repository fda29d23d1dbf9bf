"""The pipeline's stages, each judged on its own input."""

import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from junctura.llm import blocks, bpe, mixing, toxicity
from test_operators import brute_components

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][1].columns == ["doc_id", "position", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_filters_remove_the_marked_and_keep_the_clean(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for (before, after), bad in zip(stages[:2], ("quality = 0", "toxic = 1"), strict=True):
        marked = before.join(labels, "doc_id")
        left = after.join(labels, "doc_id")
        n_bad, n_good = marked.where(bad).count(), marked.where(f"not ({bad})").count()
        assert left.where(bad).count() <= 0.3 * n_bad
        assert left.where(f"not ({bad})").count() >= 0.98 * n_good


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
    assert ids(after) == sorted(i for i, (_, c) in want.items() if i == c)


def test_mixing_and_encoding_keep_all(stages):
    for before, after in stages[3:]:
        assert ids(after) == ids(before)


def test_positions_outlive_writing_and_encoding(spark):
    """In several files, which Spark reads in another order, every document has the place that the mix gave it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id: r.position for r in mixing.mix(docs, mixing.WEIGHTS).collect()}
    written = corpus_pipeline.stored(mixing.ordered(docs, part_rows=150), "several")
    assert len(written.inputFiles()) == 7
    assert {r.doc_id: r.position for r in mixing.positions(written).collect()} == want
    assert {r.doc_id: r.position for r in corpus_pipeline.encoding_stage(spark, written, FOLDER).collect()} == want


def test_pipeline_positions_are_gapless(stages):
    before, after = stages[3:][0][0], stages[-1][1]
    assert sorted(r.position for r in after.select("position").collect()) == list(range(before.count()))


def test_copies_of_a_row_are_spread(spark):
    """Rows equal in all columns are told apart by where they stand, so none of the tasks gets all of them."""
    rows = spark.range(3000).selectExpr("7L as doc_id", "'same' as text", "'src0' as source")
    docs = corpus_pipeline.stored(rows.repartition(4), "copies")
    written = corpus_pipeline.stored(mixing.ordered(docs, bucket_rows=50, part_rows=500), "mixed")
    assert written.count() == 3000 and sorted(r.position for r in mixing.positions(written).collect()) == list(range(3000))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, an empty table and columns named like internal ones pass through every stage."""
    data = [(i, t, None, s, 3, "x", 1.0, 7, "k") for i, (t, s) in enumerate([("one two three four five six", "src0"), (None, None), ("", "src1"), ("One two three four five six", "src0"), ("é", None)])]
    data += [(None, "no id here", None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _spot string, _score double, position int, id string"
    spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "odd")
            if k < 4:
                assert after.dtypes == docs.dtypes
            if k >= 3:
                assert after.count() == docs.count()
            docs = after


def test_words_are_counted_in_little_memory():
    """Several megabytes of texts are counted in small pieces, whose counts are put together."""
    texts = [" ".join(f"Word{(i * k) % 977} né{k % 50}" for i in range(6000)) for k in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    assert 4 << 20 < batch.nbytes < 8 << 20
    tracemalloc.start()
    found = list(bpe._distinct_words(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert len(found) == 2  # four megabytes each
    counts = Counter()
    for part in found:
        assert len(set(part.column("word").to_pylist())) == part.num_rows
        counts.update(dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True)))
    want = Counter()
    for text in texts:
        for word in re.findall(r"[a-zé]+|\d+", (text or "").lower()):
            want[word] += 1
    assert counts == want


def test_a_task_takes_one_python_worker(spark):
    """Blocks are packed and finished in different stages: executors keep every worker that they ever started, with all that it holds."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    encoded = bpe.encode_documents(docs, bpe.default_path())
    assert len(encoded.collect()) == docs.count()
    final = encoded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.split(r"Exchange \w", final)[0].count("MapInArrow") == 1
    for table in (bpe.vocabulary(spark, bpe.default_path()), mixing.mix(docs, mixing.WEIGHTS)):  # nor do small tables take workers of another kind
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()


def test_a_model_that_scores_holds_less(spark):
    """Without its examples' terms a model gives the same scores."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    data, offsets = blocks.bytes_of(docs.limit(50).toArrow().column("text"))
    scores, near = model.judge(data, offsets, 3)
    slim = model.searched()
    assert slim.terms is None and slim.counts is None
    again, shown = slim.judge(data, offsets, 3)
    assert (scores == again).all() and near.equals(shown)
