"""Sentence boundaries learned from the corpus: abbreviations and frequent sentence starters.

No list of abbreviations is given. A word that nearly always carries a period, and is short,
is one; a word that follows a period far more often than chance starts sentences. Both are
log-likelihood ratios of counts over the whole corpus. Splitting then reads one row at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsward.functions.once import let, part
from newsward.functions.text import WS, strip_ws
from newsward.operators.skew import dimension_join
from newsward.session import stage

# A word with its inner marks and, if there is one, its final period.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.&’\x27-]*"
# Fixed values of the published method: an abbreviation has a period in 99 of 100 cases;
# the least score of one, and the least log-likelihood ratio of a sentence starter.
WITH_PERIOD = 0.99
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
# More learned words than this are joined instead of standing in the expression.
IN_ROW = 5000


@dataclass
class Boundaries:
    """``abbreviations(word, score)`` without the final period and ``starters(word, score)``, both staged."""

    abbreviations: DataFrame
    starters: DataFrame


def _without_period(token: Column) -> Column:
    return F.lower(F.when(token.endswith("."), token.substr(F.lit(1), F.length(token) - 1)).otherwise(token))


def token_counts(documents: DataFrame) -> DataFrame:
    """``word, period, before, n``: how often a word stands with a final period or
    without, after which word with a period (null after any other word).

    Words of a row are taken apart in the row; the counts are combined before the shuffle. They are
    staged, as every score reads them several times and a pass over the texts costs most.
    """
    tokens = documents.select(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    apart = tokens.select(F.posexplode("tokens").alias("place", "token"), "tokens")
    before = F.get("tokens", F.col("place") - 1)
    rows = apart.select(
        _without_period(F.col("token")).alias("word"),
        F.col("token").endswith(".").alias("period"),
        F.when(before.endswith("."), _without_period(before)).alias("before"),
    )
    return stage(rows.groupBy("word", "period", "before").agg(F.count("*").alias("n")))


def _sums(one_row: DataFrame) -> list[int]:
    return [int(value or 0) for value in one_row.first()]


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word, with_period, without, score`` of every word seen with a final period.

    The ratio of the likelihoods that its periods belong to it or fall there by chance,
    made smaller by each letter, larger by inner periods, and much smaller by each time
    it stands without a period.
    """
    by_word = counts.groupBy("word").agg(
        F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("with_period"),
        F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("without"),
    )
    tokens, periods = _sums(counts.agg(F.sum("n"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0))))
    p = repr(min(periods / max(tokens, 1), 0.999999)) + "D"
    chance = f"with_period * ln({p}) + without * ln(1 - {p})"
    own = f"with_period * ln({WITH_PERIOD}D) + without * ln(1 - {WITH_PERIOD}D)"
    letters = "length(replace(word, '.', ''))"
    shape = f"exp(-{letters}) * (length(word) - {letters} + 1) * power({letters}, -without)"
    score = F.expr(f"2 * (({own}) - ({chance})) * {shape}").alias("score")
    return by_word.where("with_period > 0").select("word", "with_period", "without", score)


def starter_scores(counts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``word, at_start, n, score`` of every word that follows a period which ends a
    sentence, that is one not of an abbreviation or a single letter."""
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    ends = counts.where(F.col("before").isNotNull() & ~F.col("before").rlike(r"^\p{L}$"))
    ends = ends.groupBy("before", "word").agg(F.sum("n").alias("n"))
    known = abbreviations.select(F.col("word").alias("before"), F.lit(True).alias("known"))
    after = dimension_join(ends, known, "before", "left", ["word"]).where("known is null")
    starts = after.groupBy("word").agg(F.sum("n").alias("at_start"))
    (tokens,), (breaks,) = _sums(totals.agg(F.sum("n"))), _sums(starts.agg(F.sum("at_start")))
    rows = totals.join(starts, "word")

    def likelihood(hits: str, of: str, p: str) -> str:
        """Log-likelihood of ``hits`` of ``of`` at rate ``p``; 0 * ln(0) is 0."""
        return f"(if({hits} = 0, 0D, ({hits}) * ln({p})) + if({of} = {hits}, 0D, (({of}) - ({hits})) * ln(1 - ({p}))))"

    inside, outside, rest = "at_start", "(n - at_start)", f"{tokens - breaks}L"
    all_tokens, all_breaks = f"{tokens}L", f"{breaks}L"
    same = f"{likelihood(inside, all_breaks, f'n / {all_tokens}')} + {likelihood(outside, rest, f'n / {all_tokens}')}"
    apart = f"{likelihood(inside, all_breaks, f'at_start / {all_breaks}')} + {likelihood(outside, rest, f'{outside} / {rest}')}"
    more = f"at_start / {all_breaks} > n / {all_tokens}"
    return rows.select("word", "at_start", "n", F.expr(f"if({more}, 2 * (({apart}) - ({same})), 0D)").alias("score"))


def learn(documents: DataFrame) -> Boundaries:
    """Learn from all texts of ``documents``. Null and empty texts add nothing."""
    counts = token_counts(documents)
    abbreviations = stage(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION_SCORE).select("word", "score"))
    starters = starter_scores(counts, abbreviations).where(F.col("score") >= STARTER_SCORE)
    return Boundaries(abbreviations, stage(starters.select("word", "score")))


def _pieces(text: Column) -> Column:
    """The text cut at every mark followed by white space, which stays before the next piece."""
    return F.split(strip_ws(text), rf"(?<=[.!?])(?={WS})")


def _last_word(piece: Column) -> Column:
    """The word before a final period, lower case; empty if the piece ends otherwise. No blank
    stands in a word, so only what follows the last one is searched."""
    return F.lower(F.regexp_extract(F.substring_index(piece, " ", -1), rf"({TOKEN}?)\.$", 1))


def _next_word(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"^{WS}+[^\p{{L}}\p{{N}}\s]*(\p{{L}}[\p{{L}}\p{{N}}&’\x27-]*)", 1)


def _open(last: Column, is_abbreviation: Column) -> Column:
    """Whether a sentence may go on after this word and its period."""
    return is_abbreviation | last.rlike(r"^\p{L}$")


def _opens(following: Column, is_starter: Column) -> Column:
    """Whether a word is a capitalised sentence starter."""
    return (F.substring(following, 1, 1) != F.lower(F.substring(following, 1, 1))) & is_starter


def _ends(last: Column, following: Column, is_abbreviation: Column, is_starter: Column) -> Column:
    """Whether a sentence ends here: always, but after an abbreviation or a single letter only
    before a capitalised sentence starter."""
    return ~_open(last, is_abbreviation) | _opens(following, is_starter)


def learned_sentences(text: Column, abbreviations: list[str], starters: list[str]) -> Column:
    """The sentences of a text, with the learned words as part of the expression."""

    def cut(pieces: Column) -> Column:
        def ends(i: Column) -> Column:
            def after(last: Column) -> Column:
                """Whether the piece ends a sentence; the next word is looked for only where it tells."""
                open_ = _open(last, last.isin(abbreviations or [""]) & (last != ""))
                opens = let(_next_word(F.get(pieces, i + 1)), lambda word: _opens(word, F.lower(word).isin(starters or [""])))
                return F.when(open_, opens).otherwise(True)

            plain = ~F.get(pieces, i).endswith(".") | (i == F.size(pieces) - 1)
            return F.when(plain, True).otherwise(let(_last_word(F.get(pieces, i)), after))

        places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), ends)

        def joined(places_: Column) -> Column:
            def sentence(end: Column, k: Column) -> Column:
                start = F.coalesce(F.get(places_, k - 1) + 1, F.lit(0))
                return strip_ws(F.array_join(part(pieces, start, end + 1), ""))

            return F.transform(places_, sentence)

        return let(places, joined)

    return F.filter(let(_pieces(text), cut), lambda s: s != "")


def _words_in_row(table: DataFrame) -> list[str] | None:
    rows = table.select("word").limit(IN_ROW + 1).collect()
    return sorted(r["word"] for r in rows) if len(rows) <= IN_ROW else None


def split_learned(documents: DataFrame, learned: Boundaries) -> DataFrame:
    """(doc_id, pos, sentence) in text order, by the learned boundaries.

    Up to ``IN_ROW`` learned words stand in the expression and no row moves. With more, the pieces between marks
    meet the learned words in a join and are put together again by document. doc_id must
    tell documents apart there; the sentences are the same.
    """
    abbreviations, starters = _words_in_row(learned.abbreviations), _words_in_row(learned.starters)
    if abbreviations is not None and starters is not None:
        found = learned_sentences(F.col("text"), abbreviations, starters)
        return documents.select("doc_id", F.posexplode(found).alias("pos", "sentence"))
    pieces = documents.select("doc_id", _pieces(F.col("text")).alias("pieces"))
    rows = pieces.select("doc_id", F.posexplode("pieces").alias("place", "piece"), "pieces")
    marked = rows.select(
        "doc_id", "place", "piece", _last_word(F.col("piece")).alias("last"),
        _next_word(F.get("pieces", F.col("place") + 1)).alias("following"),
        F.lower(_next_word(F.get("pieces", F.col("place") + 1))).alias("starter"),
    )
    known = learned.abbreviations.select(F.col("word").alias("last"), F.lit(True).alias("is_abbreviation"))
    opening = learned.starters.select(F.col("word").alias("starter"), F.lit(True).alias("is_starter"))
    joined = dimension_join(marked, known, "last", "left", ["doc_id", "place"])
    joined = dimension_join(joined, opening, "starter", "left", ["doc_id", "place"])
    flag = F.coalesce("is_abbreviation", F.lit(False)), F.coalesce("is_starter", F.lit(False))
    ends = joined.withColumn("ends", _ends(F.col("last"), F.col("following"), *flag).cast("int"))
    earlier = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("nth", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    parts = numbered.groupBy("doc_id", "nth").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    text = strip_ws(F.array_join("parts.piece", ""))
    whole = parts.select("doc_id", "nth", text.alias("sentence")).where("sentence <> ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")) - 1
    return whole.select("doc_id", pos.alias("pos"), "sentence")
