"""Column functions over plain text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode text, some of which Java's \s leaves out.
OTHER_WS = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[ {OTHER_WS}]"
# A run that is not a single blank already: most blanks of a text need no change.
WS_RUN = f" *[{OTHER_WS}]{WS}*| {{2,}}"
# Fixed value: a URL up to the first character outside the class; `$-_` is a range.
URL = r"https?://[a-zA-Z0-9$-_@.&+!*\\(),]+"


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_ws(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    """Make each run of white space one blank, and drop it at both ends."""
    return F.trim(F.regexp_replace(text, WS_RUN, " "))


def clean_text(text: Column) -> Column:
    """URLs go first: white space ends a URL."""
    return collapse_ws(strip_urls(text))


def compose_text(title: Column, description: Column, null_as_none: bool = True) -> Column:
    """Title and description on two lines; a null reads ``None`` unless turned off."""
    if null_as_none:
        title, description = (F.coalesce(c, F.lit("None")) for c in (title, description))
    return F.concat_ws("\n", title, description)


def search_phrase(company: Column, keyword: Column, style: str = "web") -> Column:
    """The phrase typed into a search: ``web``, ``plain`` (no suffix) or ``api``."""
    if style == "web":
        return F.concat_ws(" ", company, keyword, F.lit("news"))
    if style == "plain":
        return F.concat_ws(" ", company, keyword)
    if style == "api":
        return F.concat_ws(" ", keyword, company)
    raise ValueError(f"unknown search style: {style}")


def title_case(text: Column) -> Column:
    """A capital after every character that is not a letter, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))
    )
    return F.array_join(capital, "")


def strip_quotes(text: Column) -> Column:
    """Drop double quotes at both ends, then single quotes."""
    return F.btrim(F.btrim(text, F.lit('"')), F.lit("'"))


def published_date(text: Column) -> Column:
    """The three date notations seen in replies, else null. A time part is dropped."""
    day = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T.*)?$", 1)
    return F.coalesce(
        F.try_to_date(day, "yyyy-MM-dd"),
        F.try_to_date(text, "dd/MM/yyyy"),
        F.try_to_date(text, "dd-MM-yyyy"),
    )


def fold(text: Column) -> Column:
    """Lower case words with single blanks between; the form keywords are matched in."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]+", " "))


def words(text: Column) -> Column:
    return F.split(fold(text), " ")


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space; empty parts are dropped."""
    parts = F.split(strip_ws(text), rf"(?<=[.!?]){WS}+")
    return F.filter(parts, lambda s: s != "")
