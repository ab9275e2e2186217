"""What became of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_outcome(requests: DataFrame, records: DataFrame, success: str, failure: str) -> DataFrame:
    """Requests with at least one kept record succeed."""
    kept = records.groupBy("request_id").agg(F.count("*").alias("n_records"))
    joined = requests.join(kept, "request_id", "left")
    found = F.coalesce("n_records", F.lit(0)) > 0
    return joined.withColumn("n_records", F.coalesce("n_records", F.lit(0))).withColumn(
        "status", F.when(found, success).otherwise(failure)
    )


def results_list(statuses: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per request. The response list is this dataset: it is written
    in parallel as JSON lines instead of being gathered into one array."""
    return statuses.select(F.to_json(F.struct(*columns)).alias("result"))


def coalesce_status(*cases: tuple[Column, str | Column], otherwise: str) -> Column:
    """The text of the first case that holds."""
    chosen = None
    for condition, text in cases:
        chosen = F.when(condition, text) if chosen is None else chosen.when(condition, text)
    return chosen.otherwise(otherwise)
