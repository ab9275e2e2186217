"""Stored web pages: articles, search result pages and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsward.functions.html import drop_hidden, fragment_text, href
from newsward.functions.once import compute_once
from newsward.functions.tables import rows_of_batches

# Fixed value: the class of a search result block.
RESULT_CLASS = "algo-sr"
# The columns of a report table; all but the link come from text cells.
TABLE_COLUMNS = ["Event Date", "Link_text", "Location", "Themes", "Sectors", "Regulator Name"]
FIRST_ANCHOR = r"""(?is)^(.*?)(<a\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>)(.*?)(?:</a\s*>|\z)"""


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(link, html) from a parquet table with link or url, or from one file per page."""
    if format == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.col("_metadata.file_path").alias("link"), F.col("value").alias("html")
        )
    pages = spark.read.format(format).load(path)
    link = "link" if "link" in pages.columns else "url"
    return pages.select(F.col(link).alias("link"), "html")


def read_result_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(request_id, page_no, html) from a table, or from files ``<request_id>-<page_no>.html``."""
    if format != "text":
        return spark.read.format(format).load(path).select("request_id", "page_no", "html")
    files = spark.read.text(path, wholetext=True)
    name = F.url_decode("_metadata.file_name")
    parts = r"^(.*)-(\d+)[.]html?$"
    return files.select(
        F.regexp_extract(name, parts, 1).alias("request_id"),
        F.regexp_extract(name, parts, 2).cast("int").alias("page_no"),
        F.col("value").alias("html"),
    )


def result_links(source: Column, result_class: str = RESULT_CLASS, on_missing: str = "skip") -> Column:
    """``array<struct<link,headline>>``: the first anchor of each result block.

    A block reaches up to the closing tag of its ``div``, inner ``div`` elements
    included. A block without an anchor is left out, or ends the list
    with ``on_missing='stop'``.
    """
    opening = (
        rf"""(?i)<div\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{result_class}(?:\s[^"']*)?["'][^>]*>"""
    )
    pieces = F.split(drop_hidden(source), opening)

    def first_anchor(piece: Column) -> Column:
        before = F.regexp_extract(piece, FIRST_ANCHOR, 1)
        steps = F.transform(
            F.regexp_extract_all(before, F.lit(r"(?i)(</?)div\b"), F.lit(1)),
            lambda tag: F.when(tag == "<", 1).otherwise(-1),
        )
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))
        depth = F.aggregate(
            steps,
            start,
            lambda acc, step: F.struct(
                (acc["depth"] + step).alias("depth"),
                F.least(acc["lowest"], acc["depth"] + step).alias("lowest"),
            ),
        )
        text = fragment_text(F.regexp_extract(piece, FIRST_ANCHOR, 3))
        link = F.struct(
            href(F.regexp_extract(piece, FIRST_ANCHOR, 2)).alias("link"),
            F.when(text != "", text).alias("headline"),
        )
        return F.when(piece.rlike(r"(?i)<a\b") & (depth["lowest"] >= 0), link)

    found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), first_anchor)
    if on_missing == "skip":
        return F.filter(found, lambda block: block.isNotNull())
    if on_missing == "stop":
        linked = F.transform(found, lambda block: block.isNotNull())
        gap = F.array_position(linked, False).cast("int")
        return F.when(gap > 0, F.slice(found, F.lit(1), gap - 1)).otherwise(found)
    raise ValueError(f"unknown choice: {on_missing}")


def extract_search_links(result_pages: DataFrame, on_missing: str = "skip") -> DataFrame:
    """(request_id, pos, link, headline) from one result page per request."""
    links = result_pages.select(
        "request_id", F.posexplode(result_links(F.col("html"), on_missing=on_missing))
    )
    return links.select("request_id", "pos", "col.link", "col.headline")


def extract_paged_links(
    result_pages: DataFrame, page_limit: int = 3, on_missing: str = "skip"
) -> DataFrame:
    """The same over pages 1 to ``page_limit``, up to a request's first empty page.

    Only the link lists are shuffled, not the pages.
    """
    opened = result_pages.where(F.col("page_no") <= page_limit).select(
        "request_id", "page_no", result_links(F.col("html"), on_missing=on_missing).alias("found")
    )
    earlier = Window.partitionBy("request_id").orderBy("page_no")
    so_far = earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    counted = opened.select(
        "request_id",
        "page_no",
        "found",
        F.min(F.size("found")).over(so_far).alias("fewest"),
        F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)).alias("offset"),
    )
    rows = counted.where(F.col("fewest") > 0).select(
        "request_id", "page_no", "offset", F.posexplode("found").alias("place", "item")
    )
    return rows.select(
        "request_id",
        "page_no",
        (F.col("offset") + F.col("place")).cast("int").alias("pos"),
        "item.link",
        "item.headline",
    )


def extract_table_rows(pages: DataFrame, on_short_row: str = "null", key: str = "page_id") -> DataFrame:
    """Rows of every table on a page, its first row left out.

    A table has all rows inside it and a row all cells inside it, those of nested tables
    included; a nested table is also one of its own. A cell that holds an anchor gives a link, any
    other a text; the columns are filled by position. ``index`` counts the rows of a table from 0,
    ``table_no`` the tables as they open. One pass over a page's tags in plain Python: as nested
    column functions, which Spark interprets, it took some ten times as long.
    """
    own = compute_once(pages.select(F.col(key), "html"), "source", drop_hidden(F.col("html")))
    holding = own.where(F.col("source").rlike(r"(?i)<table[\s/>]")).select(key, "source")
    key_type = holding.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, table_no int, index int, links array<string>, texts array<string>"
    split_up = holding.mapInArrow(rows_of_batches, schema)

    def at(column: str, place: int) -> Column:
        value = F.get(column, F.lit(place))
        if on_short_row == "null":
            return value
        short = F.raise_error(F.lit(f"a table row has too few {column}"))
        return F.when(F.size(column) > place, value).otherwise(short)

    sources = [("texts", 0), ("links", 0), ("texts", 1), ("texts", 2), ("texts", 3), ("texts", 4)]
    return split_up.select(
        key,
        "table_no",
        "index",
        *[at(column, place).alias(name) for name, (column, place) in zip(TABLE_COLUMNS, sources)],
    )
