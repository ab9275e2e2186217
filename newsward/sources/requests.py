"""Monitoring requests from CSV and JSON files, and the keyword files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsward.lexicons import FILE_LABELS

REQUEST_FIELDS = ["company_id", "company_name", "search_query"]


def _named(requests: DataFrame) -> DataFrame:
    """The news API's name for the search query is ``keyword``."""
    if "keyword" in requests.columns and "search_query" not in requests.columns:
        return requests.withColumnRenamed("keyword", "search_query")
    return requests


def read_requests_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte order mark is dropped, an empty cell is null."""
    options = {"header": True, "multiLine": True, "inferSchema": False, "escape": '"'}
    return _named(spark.read.options(**options).csv(path))


def read_requests_json(
    spark: SparkSession, path: str, fields: list[str] | None = None, json_lines: bool = False
) -> DataFrame:
    """An object or an array of objects per file; numbers become strings.

    JSON lines split over tasks within a file, so prefer them for large inputs.
    """
    wanted = fields or [*REQUEST_FIELDS, "industry"]
    schema = ", ".join(f"{name} string" for name in wanted)
    return _named(spark.read.schema(schema).json(path, multiLine=not json_lines))


def read_request_objects(spark: SparkSession, path: str) -> DataFrame:
    """(request) as JSON text per object, for tests on which keys are present."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.try_parse_json("value")
    items = F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed)
    )
    return whole.select(F.explode(items).alias("item")).select(F.to_json("item").alias("request"))


def read_lexicons(spark: SparkSession, path: str) -> DataFrame:
    """(industry, pos, keyword) from ``<stem>_keywords.json`` files, each an array of
    strings. A stem without a label of its own is the industry's name."""
    files = spark.read.text(f"{path.rstrip('/')}/*_keywords.json", wholetext=True)
    # Spark gives file names with their blanks escaped; a plus sign stands for itself.
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    stem = F.regexp_extract(name, "^(.*)_keywords[.]json$", 1)
    labels = F.create_map(*[F.lit(v) for pair in FILE_LABELS.items() for v in pair])
    words = F.from_json("value", "array<string>")
    return files.select(
        F.coalesce(labels[stem], stem).alias("industry"), F.posexplode(words).alias("pos", "keyword")
    )


def read_dimension(
    spark: SparkSession, path: str | None = None, table: str | None = None, **jdbc_options: str
) -> DataFrame:
    """A company or country dimension from parquet, or from a database table whose
    connection options the caller's job supplies."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc_options, dbtable=table).load()
