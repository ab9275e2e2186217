"""Stored responses of a news API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The envelope of a response.
ENVELOPE = (
    "status string, totalResults bigint, articles array<struct<"
    "source:struct<id:string,name:string>, author:string, title:string, "
    "description:string, url:string, publishedAt:string>>"
)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON files, one response per line, each with its ``request_id``: a
    field of that name, else the file's name without ``.json`` and what follows."""
    files = spark.read.schema(f"request_id string, {ENVELOPE}").json(path)
    stem = F.regexp_replace(F.url_decode("_metadata.file_name"), "[.]json([.].*)?$", "")
    return files.withColumn("request_id", F.coalesce("request_id", stem))


def parse_envelope(text: Column) -> Column:
    return F.from_json(text, ENVELOPE)


def flatten_news(envelopes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per article of each response that is ``ok`` and not empty."""
    answered = envelopes.where((F.col("status") == "ok") & (F.col("totalResults") > 0))
    rows = answered.select(*keep, F.posexplode("articles").alias("pos", "article"))
    return rows.select(
        *keep,
        "pos",
        F.col("article.source.name").alias("source"),
        F.coalesce("article.author", F.lit("")).alias("author"),
        "article.title",
        "article.description",
        "article.url",
        "article.publishedAt",
    )
