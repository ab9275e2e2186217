"""Requests against the company dimension, and the keyword fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.lexicons import DEFAULT
from newsward.operators.skew import dimension_join

# Requests may name one company very often; see ``dimension_join`` for both ways.


def _match(requests: DataFrame, companies: DataFrame, how: str) -> DataFrame:
    ids = companies.select(F.trim("company_id").alias("known_id")).distinct()
    flagged = ids.withColumn("is_known", F.lit(True)) if how == "left" else ids
    keyed = requests.withColumn("known_id", F.trim("company_id"))
    return dimension_join(keyed, flagged, "known_id", how, requests.columns).drop("known_id")


def known_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    return _match(requests, companies, "left_semi")


def unknown_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """The complement of ``known_companies``; a null id is unknown."""
    return _match(requests, companies, "left_anti")


def flag_known(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Add ``is_known``: one pass where a job needs both halves."""
    joined = _match(requests, companies, "left")
    return joined.withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def fan_out_keywords(
    companies: DataFrame, lexicon: DataFrame, on_unknown: str = "default"
) -> DataFrame:
    """One row per company and keyword of its industry.

    A company whose industry has no list gets the default one, or fails the job
    with ``on_unknown='fail'``.
    """
    columns = companies.columns
    labels = lexicon.select("industry", F.col("industry").alias("list_name")).distinct()
    marked = dimension_join(companies, labels, "industry", "left", columns)
    if on_unknown == "default":
        chosen = F.coalesce("list_name", F.lit(DEFAULT))
    elif on_unknown == "fail":
        text = F.concat(F.lit("no keyword list for industry "), F.coalesce("industry", F.lit("null")))
        chosen = F.coalesce("list_name", F.raise_error(text))
    else:
        raise ValueError(f"unknown choice: {on_unknown}")
    keywords = lexicon.select(
        F.col("industry").alias("list_name"), "pos", F.col("keyword").alias("search_query")
    )
    listed = marked.withColumn("list_name", chosen)
    return dimension_join(listed, keywords, "list_name", "inner", columns).select(
        *columns, "pos", "search_query"
    )
