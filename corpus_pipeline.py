"""The corpus pipeline: toxicity, near-dedup, substring dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
Texts go to Python in Arrow batches of 8 MB at most, which each stage sets for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsward.llm import mixing, near_dup, packing, substrings, toxicity
from newsward.llm.common import bound_batches, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    bound_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = docs.select(F.struct(*docs.columns).alias("own_row"), "text")
    return toxicity.score(rows, model).where("predicted = 0").select("own_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    bound_batches(spark)
    return near_dup.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that recur; a text that loses nothing stays as it is."""
    bound_batches(spark)
    judged = substrings.judged(docs)
    kept = F.when(F.col("removal.n_removed") > 0, F.col("removal.kept")).otherwise(F.col("own_row.text"))
    return mixing.with_text(judged, kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    bound_batches(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]
# SQL has no tokenizer and no classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
