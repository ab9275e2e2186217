"""Column functions over classifier replies (JSON text).

A reply is parsed once to a variant, which keeps apart what a typed struct
merges: a field that is absent, one that is null, and one that is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a reply.
FIELDS = ["categories", "sentiment", "incidents", "themes", "summary", "country", "date"]


def parse_reply(text: Column) -> Column:
    """A variant, or null where the text is not JSON."""
    return F.try_parse_json(text)


def field(reply: Column, name: str) -> Column:
    return F.try_variant_get(reply, f"$.{name}", "variant")


def field_type(reply: Column, name: str) -> Column:
    """``STRING``, ``ARRAY<...>``, ``OBJECT<...>``, ``VOID`` for null; null if absent."""
    return F.schema_of_variant(field(reply, name))


def valid_reply(reply: Column) -> Column:
    return F.coalesce(F.schema_of_variant(reply).startswith("OBJECT<"), F.lit(False))


def esg_gate(reply: Column, mode: str = "web") -> Column:
    """Whether a reply names an ESG category.

    ``web`` keeps every value but the empty string, so null and empty lists stay;
    ``api`` keeps what is true: no null, empty string, list or object, zero or false.
    """
    kind = field_type(reply, "categories")
    text = F.try_variant_get(reply, "$.categories", "string")
    if mode == "web":
        kept = (kind != "STRING") | (text != "")
    elif mode == "api":
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        kept = (
            (kind != "VOID")
            & ~text.isin("", "[]", "{}", "false")
            & ~(number & (text.try_cast("double") == 0))
        ) | ((kind == "STRING") & (text != ""))
    else:
        raise ValueError(f"unknown gate mode: {mode}")
    return valid_reply(reply) & F.coalesce(kept, F.lit(False))


def _escape(text: Column, plain: str) -> Column:
    """Write the characters outside ``plain`` as ``\\uXXXX``, in two halves beyond U+FFFF."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(char: Column) -> Column:
        code = F.ascii(char).cast("bigint")
        above = code - 0x10000
        pair = F.concat(
            unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        )
        return (
            F.when(char.rlike(f"^{plain}$"), char)
            .when(code > 0xFFFF, pair)
            .otherwise(unit(code))
        )

    spelled = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.when(text.rlike(f"[^{plain[1:-1]}]"), spelled).otherwise(text)


def json_string(text: Column, ascii: bool = True) -> Column:
    """A JSON string literal; characters beyond ASCII become escapes unless turned off."""
    body = text
    # The short escapes of JSON; the backslash goes first.
    for char, short in [
        ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
        ("\b", "\\b"), ("\f", "\\f"),
    ]:
        body = F.replace(body, F.lit(char), F.lit(short))
    body = _escape(body, "[ -~]" if ascii else r"[^\x00-\x1f]")
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_dumps(value: Column, ascii: bool = True) -> Column:
    """A variant as JSON text with a blank after each comma and colon."""
    compact = F.to_json(value)
    # A mark after every token tells separators from commas inside strings.
    token = r'("(?:[^"\\]|\\.)*+"|[^",:]++)?([,:]?)'
    marked = F.regexp_replace(compact, token, "$1$2\u0001")
    spaced = F.regexp_replace(marked, "([,:])\u0001+", "$1 ")
    text = F.replace(spaced, F.lit("\u0001"), F.lit(""))
    return _escape(text, "[ -~]") if ascii else text


def field_json(reply: Column, name: str, ascii: bool = True) -> Column:
    """A field as JSON text; an absent field is the empty string, a null one ``null``."""
    return F.coalesce(json_dumps(field(reply, name), ascii), F.lit('""'))


def field_text(reply: Column, name: str) -> Column:
    """A field as text; absent gives the empty string, null stays null."""
    kind = field_type(reply, name)
    text = F.try_variant_get(reply, f"$.{name}", "string")
    return F.when(kind.isNull(), "").otherwise(text)


def category_list(reply: Column) -> Column:
    """The categories as an array, whether the reply holds one string or a list."""
    kind = field_type(reply, "categories")
    text = F.try_variant_get(reply, "$.categories", "string")
    many = F.try_variant_get(reply, "$.categories", "array<string>")
    return F.when(kind == "STRING", F.array(text)).otherwise(
        F.coalesce(many, F.array().cast("array<string>"))
    )


def category_list_of_json(category: Column) -> Column:
    """The same from the stored JSON text of a record."""
    value = F.try_parse_json(category)
    kind = F.schema_of_variant(value)
    return F.when(
        kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))
    ).otherwise(
        F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>"))
    )
