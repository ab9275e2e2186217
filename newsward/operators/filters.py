"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsward.functions import reply as R
from newsward.functions.once import compute_once


def is_pdf(link: Column, content_type: Column | None = None) -> Column:
    by_name = F.lower(link).endswith(".pdf")
    if content_type is None:
        return by_name
    return by_name | F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf")


def drop_pdf(links: DataFrame) -> DataFrame:
    """Drop PDF links. Comes after ``cap_links``: a PDF uses up a place under the cap."""
    kind = F.col("content_type") if "content_type" in links.columns else None
    return links.where(~F.coalesce(is_pdf(F.col("link"), kind), F.lit(False)))


def filled(*columns: str) -> Column:
    """True where no column is null or empty."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull() & (F.col(name) != "")
    return condition


def required_fields(requests: DataFrame, columns: list[str]) -> DataFrame:
    return requests.where(filled(*columns))


def missing_fields(requests: DataFrame, columns: list[str]) -> DataFrame:
    return requests.where(~filled(*columns))


def has_keys(json_text: Column, keys: list[str]) -> Column:
    """Whether an object has all keys; a null value counts as present."""
    present = F.json_object_keys(json_text)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.array_contains(present, key)
    return F.coalesce(condition, F.lit(False))


def esg_replies(replies: DataFrame, mode: str = "web") -> DataFrame:
    """Keep the rows whose ``reply`` text names an ESG category."""
    parsed = compute_once(replies, "parsed", R.parse_reply(F.col("reply")))
    return parsed.where(R.esg_gate(F.col("parsed"), mode)).drop("parsed")


def valid_replies(replies: DataFrame) -> DataFrame:
    return replies.where(R.valid_reply(R.parse_reply(F.col("reply"))))


def bad_replies(replies: DataFrame) -> DataFrame:
    """The complement of ``valid_replies``, for a look at what the classifier returned."""
    return replies.where(~R.valid_reply(R.parse_reply(F.col("reply"))))


# What becomes of a reply.
VERDICTS = ["accepted", "gated", "malformed"]


def judged_replies(replies: DataFrame, mode: str = "web", counts: Observation | None = None) -> DataFrame:
    """Every row with a ``verdict``: ``accepted`` names an ESG category, ``gated`` is
    well formed and does not, ``malformed`` is neither; a null reply is malformed.

    A reply is parsed once for both questions, and what is accepted and what is to be looked at
    are two filters of this result. ``counts`` gathers how many there are of each as the rows pass by,
    without another job; it can be asked once an action has run.
    """
    parsed = compute_once(replies, "parsed", R.parse_reply(F.col("reply")))
    valid, gate = (F.coalesce(c, F.lit(False)) for c in (R.valid_reply(F.col("parsed")), R.esg_gate(F.col("parsed"), mode)))
    verdict = F.when(~valid, "malformed").when(gate, "accepted").otherwise("gated")
    rows = parsed.withColumn("verdict", verdict).drop("parsed")
    if counts is None:
        return rows
    return rows.observe(counts, *[F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS])
