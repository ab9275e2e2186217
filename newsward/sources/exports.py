"""File exports of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": True, "quoteAll": True, "escape": '"'}


def export_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with the batch as CSV, one file per partition."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def export_links_by_company(
    links: DataFrame, path: str, rows_per_file: int = 1_000_000
) -> None:
    """One folder of CSV files per company.

    Range partitioning keeps a small company in one file and splits a company with
    very many links over several tasks. Their number is given, as files cost more
    than bytes here and Spark would join partitions of few bytes.
    """
    parts = 4 * links.sparkSession.sparkContext.defaultParallelism
    ranged = links.repartitionByRange(parts, "company_name", "link")
    writer = ranged.withColumn("company", F.col("company_name")).write
    writer = writer.mode("overwrite").partitionBy("company")
    writer.options(**CSV, maxRecordsPerFile=rows_per_file).csv(path)


def read_links_by_company(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The rows of ``export_links_by_company``, whose ``columns`` are all strings, and their folder's ``company``.

    With the schema given, the folders are listed once; to find it out, Spark would list every
    file a second time and read some."""
    schema = ", ".join(f"{name.strip()} string" for name in [*columns.split(","), "company"])
    return spark.read.schema(schema).options(**CSV).csv(path)
