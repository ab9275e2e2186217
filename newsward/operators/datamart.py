"""Lookups, surrogate keys and the load of the star-shaped datamart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward.functions import reply as R
from newsward.functions.text import strip_quotes, title_case
from newsward.operators.ids import with_ids
from newsward.operators.skew import dimension_join

# The theme table.
THEME_IDS = {"Environmental": 1, "Social": 2, "Governance": 3}


def theme_id(category: Column) -> Column:
    """The theme of a category name, exact after its quotes are stripped; else null."""
    name = strip_quotes(category)
    chosen = F.lit(None).cast("int")
    for label, number in THEME_IDS.items():
        chosen = F.when(name == label, F.lit(number)).otherwise(chosen)
    return chosen


def theme_ids(categories: Column) -> Column:
    """The themes of a list of category names; names without a theme drop out."""
    return F.filter(F.transform(categories, theme_id), lambda t: t.isNotNull())


def country_key(country: Column) -> Column:
    return F.lower(F.coalesce(country, F.lit("")))


def lookup_country(records: DataFrame, countries: DataFrame, salt_by: list[str]) -> DataFrame:
    """Add ``country_id``, null for an unknown country.

    The dimension grows with every new spelling, so its size is checked, and many
    records may share one country.
    """
    known = countries.groupBy(country_key(F.col("country")).alias("country_key")).agg(
        F.min("id").alias("country_id")
    )
    keyed = records.withColumn("country_key", country_key(F.col("country")))
    return dimension_join(keyed, known, "country_key", "left", salt_by).drop("country_key")


def new_countries(records: DataFrame, countries: DataFrame, seq: str) -> DataFrame:
    """The countries not yet known, one row each: the first spelling by ``seq``."""
    first = (
        records.groupBy(country_key(F.col("country")).alias("country_key"))
        .agg(
            F.min(seq).alias("first_seq"),
            F.min_by(F.coalesce("country", F.lit("")), seq).alias("country"),
        )
    )
    known = countries.select(country_key(F.col("country")).alias("country_key"))
    return first.join(known, "country_key", "left_anti").select("first_seq", "country")


def max_id(table: DataFrame) -> int:
    """The highest id in use; a single number."""
    return table.agg(F.max("id")).first()[0] or 0


def get_or_create_countries(
    records: DataFrame, countries: DataFrame, seq: str, start: int | None = None
) -> DataFrame:
    """The rows to add to the country dimension, in first-seen order."""
    fresh = new_countries(records, countries, seq)
    first = max_id(countries) if start is None else start
    numbered = with_ids(fresh, ["first_seq", "country"], first)
    return numbered.select("id", title_case(F.col("country")).alias("country"))


def incident_themes(details: DataFrame) -> DataFrame:
    """(incident_id, theme_id) for the categories of each detail row."""
    themes = theme_ids(R.category_list_of_json(F.col("Category")))
    return details.select(
        F.col("id").alias("incident_id"), F.explode(themes).alias("theme_id")
    )


def incident_countries(details: DataFrame, countries: DataFrame) -> DataFrame:
    """(incident_id, country_id), exactly one row per detail row."""
    found = lookup_country(details.select("id", "country"), countries, ["id"])
    return found.select(F.col("id").alias("incident_id"), "country_id")


@dataclass
class Load:
    """The rows one load adds to each table."""

    details: DataFrame
    countries: DataFrame | None
    incident_themes: DataFrame | None
    incident_countries: DataFrame | None


def build_load(
    records: DataFrame,
    countries: DataFrame,
    order_by: list[str],
    last_detail_id: int = 0,
    bridges: bool = True,
) -> Load:
    """Give the records their ids and derive the dimension and bridge rows.

    The numbered records are staged once; the country ids, the bridges and the fact
    rows all read that one copy. The news API path fills the fact table only
    (``bridges=False``).
    """
    details = with_ids(records, order_by, last_detail_id)
    if not bridges:
        return Load(details, None, None, None)
    added = get_or_create_countries(details, countries, "id")
    every = countries.select("id", "country").unionByName(added)
    return Load(details, added, incident_themes(details), incident_countries(details, every))
