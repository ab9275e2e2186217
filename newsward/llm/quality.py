"""Line-first cleaning: lines are judged one by one, then what is left of the document.

Built-in functions only: a document is one row from reading to verdict, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.functions.once import compute_once

BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
SYMBOLS = list("#*$%&|<>")
# Marks between the entries of a menu or a path.
SEPARATORS = list("|»›•·→")
# Phrases of notices, not of prose; compared in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie", "javascript", "lorem ipsum", "click here", "sign up", "log in", "subscribe to", "share this",
)
# What may follow a line's last mark.
AFTER_MARK = " \t\x0b\x0c\r\"\u0027”’»)]"
MARKS = list(".!?…")
SHORT = 20  # characters of a line too short to be prose without a last mark
FEWEST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
MOST_LOST = 40  # percent of the words' characters
WINDOW = 3


def _any(text: str, values, joint: str = "or") -> str:
    return "(" + f" {joint} ".join(f"contains({text}, {_quoted(v)})" for v in values) + ")"


def _quoted(value: str) -> str:
    return "'" + "".join(c if c.isalnum() or c == " " else f"\\u{ord(c):04X}" for c in value) + "'"


def _count(text: str, characters) -> str:
    """How many of these characters there are; each is looked for on the bytes, which is
    far cheaper than a pattern."""
    return "(" + " + ".join(f"length({text}) - length(replace({text}, {_quoted(c)}, ''))" for c in characters) + ")"


def line_rules() -> list[tuple[str, str]]:
    """Rules as (name, condition that fails the line ``x``); the first that applies names it.

    The columns ``has_phrase``, ``has_separator``, ``n_symbols`` and ``has_shout`` of the document
    spare most lines a closer look.
    """
    ended = f"right(trim(trailing {_quoted(AFTER_MARK)} from x), 1) in ({', '.join(map(_quoted, MARKS))})"
    return [
        ("boilerplate", f"has_phrase and {_any('lower(x)', BOILERPLATE)}"),
        ("navigation", f"has_separator and 24 * {_count('x', SEPARATORS)} >= greatest(length(x), 48)"),
        ("navigation", f"length(x) < {SHORT} and not {ended}"),
        ("symbols", f"n_symbols > 0 and 10 * {_count('x', SYMBOLS)} > length(x)"),
        ("shouting", f"length(x) >= {SHORT} and has_shout and 12 * {_count('x', '!')} > length(x)"),
        ("shouting", f"length(x) >= {SHORT} and not {_any('x', 'aeiou')} and {_any('x', 'AEIOU')}"),
        ("punctuation", f"not {_any('x', MARKS)}"),
    ]


def judged_lines(lines: str = "unique_lines") -> str:
    """SQL of an array of ``line, reason`` structs; the reason is null for a line that stays."""
    cases = " ".join(f"when {condition} then '{name}'" for name, condition in line_rules())
    return f"transform({lines}, x -> struct(x as line, case {cases} end as reason))"


def clean(docs: DataFrame, text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """``docs`` with a struct column ``quality``, whatever the other columns are called.

    It holds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the flags
    ``base_failed`` and ``kept``, the ``cleaned`` text, its ``lost_chars`` and the number
    of lines each rule ``removed``.

    Lines end at \\n. Lines without words are left out, a line equal to an earlier one of
    its document is removed, the rest is judged by ``line_rules``. A document that passes the
    base rules is kept unless its lines lose more than ``most_lost`` percent of the
    characters in words. A null or empty text has no words and fails. Rows stay rows:
    repeated and null ids change nothing. Windows are sorted, not compared pair by pair,
    so a very long text costs little more than its length.
    """
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own_row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Columns that lambdas look into are made once per row, before the lambdas.
    split = compute_once(own, "w", F.expr(r"filter(split(t, r'[\x20\x09-\x0D]+'), x -> x <> '')"))
    split = compute_once(split, "lines", F.expr(r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
    # A number holds a window's hash above and its place below, so sorting brings windows
    # that may be equal side by side; those few are then compared word by word.
    mask = "(shiftleft(1L, cast(ceil(log2(size(w))) as int)) - 1)"
    numbers = f"case when size(w) > {WINDOW} then sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> (xxhash64(x, w[i + 1], w[i + 2]) & ~mask) | i)) end"
    sized = split.withColumn("n_words", F.size("w")).withColumn("mask", F.expr(f"case when size(w) > 0 then {mask} end"))
    sorted_ = compute_once(sized, "s", F.expr(numbers))
    near = compute_once(sorted_, "near", F.expr("filter(sequence(0, size(s) - 2), k -> (s[k] ^ s[k + 1]) between 0 and mask)"))
    places = "array_distinct(concat(transform(near, k -> s[k] & mask), transform(near, k -> s[k + 1] & mask)))"
    window = "struct(w[cast(i as int)] as a, w[cast(i as int) + 1] as b, w[cast(i as int) + 2] as c, cast(i as int) as i)"
    alike = compute_once(near, "alike", F.expr(f"sort_array(transform({places}, i -> {window}))")).drop("s", "near", "w", "mask")
    beside = " or ".join(f"(get(alike, k {step}).a = x.a and get(alike, k {step}).b = x.b and get(alike, k {step}).c = x.c)" for step in ("- 1", "+ 1"))
    found = compute_once(alike, "starts", F.expr(f"sort_array(transform(filter(alike, (x, k) -> {beside}), x -> x.i))")).drop("alike")
    found = compute_once(found, "unique_lines", F.array_distinct("lines")).withColumn("n_dup_lines", F.size("lines") - F.size("unique_lines"))
    measured = found.selectExpr(
        "own_row", "cast(n_words as bigint) as n_words", "cast(n_dup_lines as bigint) as n_dup_lines",
        f"cast(length(t) - {_count('t', BLANKS)} as bigint) as word_chars",
        f"cast({_count('t', SYMBOLS)} as bigint) as n_symbols",
        f"{_any('lower(t)', BOILERPLATE)} as has_phrase", f"{_any('t', SEPARATORS)} as has_separator", "contains(t, '!') as has_shout",
        # Each window adds the words that the one before it doesn't hold.
        f"aggregate(coalesce(starts, array()), struct({-WINDOW} as last, 0L as total), (a, p) -> struct(p as last, a.total + least({WINDOW}, p - a.last) as total), a -> a.total) as n_repeat_words",
        "unique_lines",
    )
    measured = compute_once(measured, "judged", F.expr(judged_lines())).drop("unique_lines")
    verdicts = measured.selectExpr(
        "*", f"n_words < {FEWEST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed",
        "array_join(transform(filter(judged, x -> x.reason is null), x -> x.line), '\n') as cleaned",
    )
    names = sorted({name for name, _ in line_rules()})
    removed = ", ".join(f"size(filter(judged, x -> x.reason = '{name}')) as {name}" for name in names)
    lost = f"word_chars - length(cleaned) + {_count('cleaned', BLANKS)}"
    done = verdicts.selectExpr(
        "own_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned",
        f"{lost} as lost_chars", f"struct({removed}) as removed",
    )
    kept = f"not base_failed and 100 * lost_chars <= {int(most_lost)} * word_chars as kept"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "lost_chars", "removed"]
    row = done.selectExpr("own_row", "struct(*) as q", kept).selectExpr("own_row", "struct(" + ", ".join("kept" if n == "kept" else f"q.{n}" for n in names) + ") as quality")
    return row.select("own_row.*", "quality")
