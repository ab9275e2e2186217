"""Pieces of oracle SQL (DuckDB dialect) for the text functions."""

from __future__ import annotations

from collections.abc import Iterable

from newsward import lexicons

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG = r"""</?[a-zA-Z](?:[^''">]|"[^"]*"|''[^'']*'')*>|<[!?][^>]*>"""


def quoted_list(values: Iterable[str]) -> str:
    return "[" + ", ".join(lexicons.quoted(v) for v in values) + "]"


def sub(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def strip_ws(text: str) -> str:
    return sub(text, f"^{WS}+|{WS}+$")


def strip_urls(text: str) -> str:
    return sub(text, r"https?://[a-zA-Z0-9$-_@.&+!*\\(),]+")


def collapse_ws(text: str) -> str:
    return f"trim({sub(text, WS + '+', ' ')})"


def drop_hidden(html: str) -> str:
    hidden = [rf"<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "template")]
    return sub(html, r"(?is)<!--.*?(?:-->|\z)|" + "|".join(hidden))


def unescape(text: str) -> str:
    for name, char in [("copy", "©"), ("middot", "·"), ("quot", '"')]:
        text = f"replace({text}, '&{name};', '{char}')"
    return sub(text, r"&amp(;|\b)", "&")


def fragment_text(html: str) -> str:
    return unescape(sub(html, TAG))


def html_text(html: str) -> str:
    return fragment_text(drop_hidden(html))


def fold(text: str) -> str:
    return "trim(" + sub(f"lower({text})", r"[^\p{L}0-9]+", " ") + ")"


def sentences(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        f"lambda s: {strip_ws('s')}), lambda s: s <> '')"
    )


def holding(folded: str, terms: Iterable[str]) -> str:
    """The terms that a folded text holds as whole words."""
    return (
        f"list_filter({quoted_list(terms)}, "
        f"lambda t: contains(' ' || {folded} || ' ', ' ' || t || ' '))"
    )


def title_case(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || r[2:]), '')"


def strip_quotes(text: str) -> str:
    return f"""trim(trim({text}, '"'), '''')"""


def published_date(text: str) -> str:
    return (
        f"coalesce(CAST(try_strptime(nullif(regexp_extract({text}, "
        f"'^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:T.*)?$', 1), ''), '%Y-%m-%d') AS DATE), "
        f"CAST(try_strptime(nullif(regexp_extract({text}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$'), ''), '%d/%m/%Y') AS DATE), "
        f"CAST(try_strptime(nullif(regexp_extract({text}, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$'), ''), '%d-%m-%Y') AS DATE))"
    )


def safe(reply: str) -> str:
    """The reply where it is a JSON object, else an object without fields."""
    return f"CASE WHEN json_valid({reply}) AND json_type(CASE WHEN json_valid({reply}) THEN {reply} ELSE '0' END) = 'OBJECT' THEN {reply} ELSE '{{}}' END"


def json_string(text: str) -> str:
    body = text
    for char, short in [("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"),
                        ("chr(10)", "chr(92) || 'n'"), ("chr(9)", "chr(92) || 't'")]:
        body = f"replace({body}, {char}, {short})"
    spelled = (
        f"array_to_string(list_transform(string_split({body}, ''), lambda c: CASE WHEN "
        f"regexp_matches(c, '^[ -~]?$') THEN c ELSE printf('\\u%04x', unicode(c)) END), '')"
    )
    return f"""('"' || {spelled} || '"')"""


def field_json(reply: str, name: str) -> str:
    kind = f"json_type({reply}, '$.{name}')"
    items = f"json_extract_string({reply}, '$.{name}[*]')"
    return (
        f"CASE WHEN {kind} IS NULL THEN '\"\"' WHEN {kind} = 'NULL' THEN 'null' "
        f"WHEN {kind} = 'ARRAY' THEN '[' || array_to_string(list_transform({items}, "
        f"lambda x: {json_string('x')}), ', ') || ']' "
        f"ELSE {json_string(f'json_extract_string({reply}, chr(36) || chr(46) || {lexicons.quoted(name)})')} END"
    )


def field_text(reply: str, name: str) -> str:
    return (
        f"CASE WHEN json_type({reply}, '$.{name}') IS NULL THEN '' "
        f"ELSE json_extract_string({reply}, '$.{name}') END"
    )


def gate(reply: str, mode: str) -> str:
    kind = f"coalesce(json_type({reply}, '$.categories'), 'ABSENT')"
    text = f"coalesce(json_extract_string({reply}, '$.categories'), '')"
    if mode == "web":
        return f"({kind} <> 'ABSENT' AND NOT ({kind} = 'VARCHAR' AND {text} = ''))"
    return f"({kind} NOT IN ('ABSENT', 'NULL') AND {text} NOT IN ('', '[]', '{{}}'))"


def theme_id(category: str) -> str:
    return (
        f"CASE {strip_quotes(category)} WHEN 'Environmental' THEN 1 WHEN 'Social' THEN 2 "
        "WHEN 'Governance' THEN 3 END"
    )
