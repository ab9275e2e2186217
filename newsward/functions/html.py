"""Column functions over HTML source. All stay inside the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsward.functions.text import collapse_ws, strip_ws

# Elements whose content is not text; an unclosed one runs to the end of the page.
# Comments stand in the same pattern, so that whichever starts first is cut: a script may
# hold `<!--`, and a comment a script.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
# A tag may hold `>` inside quotes. Possessive loops keep long tags off the Java stack.
TAG = r"""</?[a-zA-Z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>"""
ATTRIBUTE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
PARAGRAPH_END = r"(?i)</p\s*>|<p\b|</(?:article|body|div|footer|header|html|li|main|nav|section|td|ul|ol|table)\s*>"

# The character references met most often; `amp` stays last.
COMMON = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "middot": "·", "amp": "&"}


def _reference_names() -> Column:
    """Every named character reference, from the standard library's table: most need
    their semicolon, the old ones do without."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _windows_page() -> str:
    """What the references 128-159 stand for: the Windows code page, as in browsers."""
    page = bytes(range(128, 160)).decode("cp1252", errors="replace")
    return "".join(chr(128 + i) if c == "\ufffd" else c for i, c in enumerate(page))


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; an impossible number gives U+FFFD."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = F.when(valid, number).otherwise(F.lit(0xFFFD))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.lit(_windows_page()).substr((number - 127).cast("int"), F.lit(1))
    return F.when(number.between(128, 159), windows).otherwise(char)


def _decoded(name: Column) -> Column:
    decimal = F.regexp_extract(name, "^#([0-9]{1,9});?$", 1)
    hexadecimal = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,7});?$", 1)
    return (
        F.when(name.isin("amp;", "amp"), "&")
        .when(name.isin("nbsp;", "nbsp"), "\u00a0")
        .when(name.isin("lt;", "lt"), "<")
        .when(name.isin("gt;", "gt"), ">")
        .when(name.isin("quot;", "quot"), '"')
        .when(decimal != "", _code_point(decimal.try_cast("bigint")))
        .when(hexadecimal != "", _code_point(F.conv(hexadecimal, 16, 10).try_cast("bigint")))
        .otherwise(F.element_at(_reference_names(), name))
    )


def unescape(text: Column) -> Column:
    """Decode character references. Each one starts a piece of its own, so that a
    decoded ``&`` is never read again as the start of another reference."""
    pieces = F.split(text, "(?=&)")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?)", 1)
        rest = piece.substr(F.length(name) + 2, F.length(piece))
        return F.when(name == "", piece).otherwise(
            F.coalesce(F.concat(_decoded(name), rest), piece)
        )

    decoded = F.array_join(F.transform(pieces, decode), "")
    # Most texts hold only the common references: plain replacing, `&` itself last.
    common = text
    for name, char in COMMON.items():
        common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
    rare = text.rlike("&(?!(?:" + "|".join(COMMON) + ");)")
    return F.when(~text.contains("&"), text).when(~rare, common).otherwise(decoded)


def drop_hidden(source: Column) -> Column:
    """Cut scripts, styles, templates and comments."""
    return F.regexp_replace(source, HIDDEN, "")


def fragment_text(fragment: Column) -> Column:
    """The text nodes of a piece of HTML that holds no hidden element."""
    return unescape(F.regexp_replace(fragment, TAG, ""))


def html_text(source: Column) -> Column:
    """All text nodes of a page, title included, joined without a separator."""
    return fragment_text(drop_hidden(source))


def stripped_text(fragment: Column) -> Column:
    """Each text node stripped, then joined without a separator."""
    nodes = F.split(F.regexp_replace(fragment, TAG, "\u0001"), "\u0001")
    return F.array_join(F.transform(nodes, lambda n: strip_ws(unescape(n))), "")


def page_title_keyword(source: Column) -> Column:
    """The text of ``<title>`` with white space collapsed; null without a title."""
    title = F.regexp_extract_all(source, F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), F.lit(1))
    return collapse_ws(unescape(F.get(title, F.lit(0))))


def headlines(source: Column) -> Column:
    """The stripped texts of all ``<h1>``, in page order."""
    found = F.regexp_extract_all(
        drop_hidden(source), F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), F.lit(1)
    )
    return F.transform(found, lambda h: strip_ws(fragment_text(h)))


def headline(source: Column) -> Column:
    """The first ``<h1>``, else null."""
    return F.get(headlines(source), F.lit(0))


def paragraphs(source: Column) -> Column:
    """The stripped texts of all ``<p>``. A paragraph ends at ``</p>``, at the next
    ``<p>`` or where its container closes, so unclosed ones do not repeat text."""
    opened = F.split(drop_hidden(source), r"(?i)<p(?=[\s>])[^>]*>")
    bodies = F.transform(
        F.slice(opened, F.lit(2), F.size(opened)),
        lambda part: F.get(F.split(part, PARAGRAPH_END, 2), F.lit(0)),
    )
    return F.transform(bodies, lambda body: strip_ws(fragment_text(body)))


def paragraph_text(source: Column) -> Column:
    return F.array_join(paragraphs(source), "\n")


def href(anchor: Column) -> Column:
    """The ``href`` of an opening tag, else null."""
    pattern = r"(?is)\bhref" + ATTRIBUTE
    parts = [F.regexp_extract(anchor, pattern, i) for i in (1, 2, 3)]
    return unescape(F.when(anchor.rlike(pattern), F.concat(*parts)))


def anchors(source: Column) -> Column:
    """The ``href`` of every ``<a>`` that has one, in page order."""
    tags = F.regexp_extract_all(
        drop_hidden(source), F.lit(r"""(?is)<a\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0)
    )
    return F.filter(F.transform(tags, href), lambda link: link.isNotNull())
