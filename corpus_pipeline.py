"""The corpus pipeline: quality, toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read back as the
next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import blocks, bpe, mixing, neardup, quality, toxicity
from junctura.llm.scratch import free, free_name, free_since, mark, stored
from junctura.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage after which the driver, where models and word tables were made, hands its free memory back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        try:
            return stage(spark, docs, sf_dir)
        finally:
            blocks.give_back()

    return run


@_tidied
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go; null and empty texts are scored too, repeated rows alike, and without labels all stay."""
    trees, name = quality.fit(docs, _labels(ship(spark), sf_dir)), free_name(docs, "_score")
    return quality.with_score(docs, trees, name).where(f"{name} >= 0.3").drop(name)


@_tidied
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts are scored too, repeated rows alike; without labels all stay."""
    model, name = toxicity.fit(docs, _labels(ship(spark), sf_dir)), free_name(docs, "_score")
    return toxicity.with_score(docs, model, name).where(f"{name} < 0.5").drop(name)


@_tidied
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document with the smallest id stays; texts without words are linked with nothing."""
    ship(spark)
    gone = neardup.near_duplicates(docs, width=5).where("not kept").selectExpr("doc_id as id").distinct()
    return neardup.without(docs, stored(gone, "gone"))


@_tidied
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, in the order of the mix: of the files' numbers and of the rows in them; a null source is among the rest."""
    ship(spark)
    return mixing.ordered(docs)


@_tidied
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its position in the mix as it was written, n_tokens and the digests of ids and decoded text; null texts are empty, an empty table stays so."""
    ship(spark)
    placed = mixing.positions(docs, "_position").select(F.struct("doc_id", F.col("_position").alias("position")).alias("doc_id"), "text")
    encoded = bpe.encode_documents(placed, bpe.default_path())
    return encoded.select("doc_id.doc_id", "doc_id.position", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Learnt models and tokenising are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        start, before = mark(), docs
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        free_since(start, docs)
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
