"""From articles and classifier replies to the rows of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward.functions import reply as R
from newsward.functions.once import compute_once
from newsward.functions.text import published_date

# The twelve columns of the fact table, in order.
RECORD_COLUMNS = [
    "company_id", "data_provider", "Sentiment", "Summary", "Category", "Incident",
    "Published_dt", "link", "Keywords_phrases", "Themes", "country", "proc_ts",
]
# Provider name -> where its publication date comes from and which gate it uses.
PROVIDERS = {"News": "web", "NewsAPI": "api"}


def to_records(
    articles: DataFrame,
    provider: str,
    proc_ts: Column | None = None,
    keep: tuple[str, ...] = (),
    ascii: bool = True,
) -> DataFrame:
    """Gate the replies and shape the fact rows.

    ``articles`` has company_id, search_query, link and reply, and published_at for
    the news API. ``keep`` names further columns to carry along.
    """
    mode = PROVIDERS[provider]
    parsed = compute_once(articles, "parsed", R.parse_reply(F.col("reply")))
    passed = parsed.where(R.esg_gate(F.col("parsed"), mode))
    reply = F.col("parsed")
    published = R.field_text(reply, "date") if mode == "web" else F.col("published_at")
    now = F.current_timestamp() if proc_ts is None else proc_ts
    return passed.select(
        *keep,
        F.col("company_id").cast("string").alias("company_id"),
        F.lit(provider).alias("data_provider"),
        R.field_text(reply, "sentiment").alias("Sentiment"),
        R.field_text(reply, "summary").alias("Summary"),
        R.field_json(reply, "categories", ascii).alias("Category"),
        R.field_json(reply, "incidents", ascii).alias("Incident"),
        published.alias("Published_dt"),
        "link",
        F.col("search_query").alias("Keywords_phrases"),
        R.field_json(reply, "themes", ascii).alias("Themes"),
        R.field_text(reply, "country").alias("country"),
        F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("proc_ts"),
    )


def with_published_date(records: DataFrame) -> DataFrame:
    return records.withColumn("published_date", published_date(F.col("Published_dt")))
