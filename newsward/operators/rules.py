"""Rule-based tagging of articles: a distributed stand-in for an external classifier.

Everything about an article is read from its own row, so tagging needs no shuffle.
A dictionary of at most ``DICTIONARY_LIMIT`` terms becomes part of the expression;
a larger one is joined on the first word of its terms instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsward import lexicons
from newsward.functions.once import compute_once, part
from newsward.functions.text import fold, published_date, sentences, words
from newsward.operators.skew import dimension_join
from newsward.session import stage

DICTIONARY_LIMIT = 5000
DATE = r"\b([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\b"
NO_INCIDENT = "No incidents found"
TAGS = [
    "category", "esg_check", "sentiment", "themes", "incidents", "country", "date", "summary",
]


def folded_terms(terms: DataFrame, column: str) -> DataFrame:
    """The distinct terms of a dictionary, folded as the texts are."""
    return terms.select(fold(F.col(column)).alias("term")).where("term <> ''").distinct()


def small_dictionary(terms: DataFrame, column: str) -> list[str] | None:
    """The folded terms if there are few enough to keep in the expression, else None."""
    rows = folded_terms(terms, column).limit(DICTIONARY_LIMIT + 1).collect()
    return sorted(r["term"] for r in rows) if len(rows) <= DICTIONARY_LIMIT else None


def term_hits(word_list: Column, terms: Iterable[str]) -> Column:
    """``array<struct<at,term>>``: where each folded term starts, as whole words.

    One pass marks the words that can start a term; only there are terms compared.
    """
    by_first: dict[str, list[list[str]]] = {}
    for term in sorted(set(terms)):
        parts = term.split(" ")
        by_first.setdefault(parts[0], []).append(parts)
    if not by_first:
        return F.array().cast("array<struct<at:int,term:string>>")
    table = lexicons.constant(by_first, "map<string,array<array<string>>>")
    firsts = list(by_first)
    marked = F.transform(word_list, lambda w, i: F.when(w.isin(firsts), i).otherwise(-1))
    starts = F.filter(marked, lambda i: i >= 0)

    def terms_at(i: Column) -> Column:
        options = F.element_at(table, F.get(word_list, i))
        fitting = F.filter(options, lambda p: F.slice(word_list, i + 1, F.size(p)) == p)
        return F.transform(
            fitting, lambda p: F.struct(i.alias("at"), F.array_join(p, " ").alias("term"))
        )

    return F.flatten(F.transform(starts, terms_at))


def found_terms(hits: Column) -> Column:
    """The distinct terms of the hits, sorted."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["term"])))


# The set of term hashes has this many places a term, one byte each, and at most 4 MB.
PLACES_A_TERM = 64
MOST_PLACES = 1 << 22


def _hashed_set(keys: DataFrame) -> Callable[[Column], Column]:
    """A test in the row that passes every string of ``keys(key)`` and few others.

    The set stands in the expression as bytes of bounded size. With more keys than it
    serves well it passes more, never fewer, and the join that follows is exact.
    """
    count = keys.count()
    size = min(MOST_PLACES, 1 << max(16, (PLACES_A_TERM * count).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(size))
    table = bytearray(size)
    for batch in keys.select(place.alias("place")).distinct().toArrow().to_batches():  # at most ``size`` numbers
        for at in batch.column(0).to_pylist():
            table[at] = 1
    held = F.lit(bytes(table))
    return lambda key: F.substring(held, (F.pmod(F.xxhash64(key), F.lit(size)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def term_places(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, at, term): word places where one of ``terms(term)`` may stand, and hardly any other.

    A word is looked at further if it can start a term; then the words from there on, as many as
    some term has, must be a whole term. Both are asked in the row, before any row arises.
    """
    parts = F.split("term", " ")
    lengths = [r["n"] for r in terms.select(F.size(parts).alias("n")).distinct().orderBy("n").collect()]  # one per length
    starts = terms.select(F.concat(F.lit("starts "), parts[0]).alias("key")).distinct()
    holds = _hashed_set(starts.union(terms.select(F.concat(F.lit("is "), F.col("term")).alias("key"))))
    spelled = compute_once(articles.select("doc_id", "text"), "word_list", words(F.col("text"))).drop("text")
    word_list = F.col("word_list")
    begins = F.filter(F.sequence(F.lit(0), F.size(word_list) - 1), lambda i: holds(F.concat(F.lit("starts "), F.get(word_list, i))))

    def at(i: Column) -> Column:
        spots = [F.when(i + n <= F.size(word_list), F.struct(i.alias("at"), F.array_join(part(word_list, i, i + n), " ").alias("term"))) for n in lengths]
        return F.filter(F.array(*spots), lambda s: s.isNotNull() & holds(F.concat(F.lit("is "), s["term"])))

    return spelled.select("doc_id", F.explode(F.flatten(F.transform(begins, at))).alias("spot")).select("doc_id", "spot.*")


def join_hits(articles: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """(doc_id, at, term) by a join on whole terms, for a dictionary of any size."""
    known = stage(folded_terms(terms, column))
    if known.isEmpty():
        return articles.select("doc_id", F.lit(0).alias("at"), F.lit("").alias("term")).where("false")
    return dimension_join(term_places(articles, known), known, "term", "inner", ["doc_id", "at"])


def match_keywords(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, keyword): each keyword found in the articles of a doc_id, once."""
    terms = small_dictionary(lexicon, "keyword")
    if terms is None:
        found = join_hits(articles, lexicon, "keyword")
        return found.select("doc_id", F.col("term").alias("keyword")).distinct()
    spelled = articles.select("doc_id", words(F.col("text")).alias("word_list"))
    hits = term_hits(F.col("word_list"), terms)
    return spelled.select("doc_id", F.explode(found_terms(hits)).alias("keyword")).distinct()


def _count_in(found: Column, terms: Iterable[str]) -> Column:
    return F.size(F.array_intersect(found, lexicons.text_array(sorted(terms))))


def pillar(found: Column, pillars: dict[str, list[str]]) -> Column:
    """The pillar with most terms found; the first named wins a tie; none gives ''."""
    counts = {name: _count_in(found, terms) for name, terms in pillars.items()}
    best = F.greatest(*counts.values())
    chosen = F.lit("")
    for name, count in reversed(list(counts.items())):
        chosen = F.when(count == best, F.lit(name)).otherwise(chosen)
    return F.when(best > 0, chosen).otherwise("")


def polarity(found: Column, weights: dict[int, list[str]]) -> Column:
    """Positive, Negative or Neutral by the sum of the weights of the terms found."""
    total = F.lit(0)
    for weight, terms in weights.items():
        total = total + F.lit(weight) * _count_in(found, terms)
    return F.when(total > 0, "Positive").when(total < 0, "Negative").otherwise("Neutral")


def incident_text(text: Column, terms: list[str]) -> Column:
    """The sentences that hold an incident term, joined by blanks; '' without any."""
    telling = F.filter(sentences(text), lambda s: F.size(term_hits(words(s), terms)) > 0)
    return F.array_join(telling, " ")


def first_date(text: Column) -> Column:
    """The first date in one of three notations, else null."""
    return published_date(F.regexp_extract(text, DATE, 1))


def tag_countries(articles: DataFrame, countries: DataFrame) -> DataFrame:
    """(doc_id, country) for each row of ``articles``: the earliest name of the country dimension in the text, the
    longest one if several start there, spelled as in the dimension; else ''."""
    names = countries.select("country", fold(F.col("country")).alias("term")).where("term <> ''")
    spelling = names.groupBy("term").agg(F.min("country").alias("country"))
    rows = spelling.limit(DICTIONARY_LIMIT + 1).collect()
    if len(rows) > DICTIONARY_LIMIT:
        marked = stage(articles.withColumn("row_mark", F.monotonically_increasing_id()))
        keyed = marked.select(F.col("row_mark").alias("doc_id"), "text")
        hits = join_hits(keyed, countries, "country")
        order = F.struct(F.col("at"), -F.length("term"))
        first = hits.groupBy("doc_id").agg(F.min_by("term", order).alias("term"))
        named = first.join(spelling, "term").select("doc_id", "country")
        named = named.withColumnRenamed("doc_id", "row_mark")
        every = marked.select("doc_id", "row_mark").join(named, "row_mark", "left")
        return every.select("doc_id", F.coalesce("country", F.lit("")).alias("country"))
    spelled = articles.select("doc_id", words(F.col("text")).alias("word_list"))
    hits = term_hits(F.col("word_list"), [r["term"] for r in rows])
    return spelled.select(
        "doc_id", first_country(hits, {r["term"]: r["country"] for r in rows}).alias("country")
    )


def first_country(hits: Column, names: dict[str, str]) -> Column:
    if not names:
        return F.lit("")
    ranked = F.transform(hits, lambda h: F.struct(h["at"], -F.length(h["term"]), h["term"].alias("term")))
    term = F.array_min(ranked)["term"]
    spelling = lexicons.constant(names, "map<string,string>")
    return F.coalesce(F.element_at(spelling, term), F.lit(""))


def tag_articles(
    articles: DataFrame,
    lexicon: DataFrame,
    countries: DataFrame,
    pillars: dict[str, list[str]] = lexicons.PILLAR_TERMS,
    weights: dict[int, list[str]] = lexicons.POLARITY_TERMS,
    incident_terms: list[str] = lexicons.INCIDENT_TERMS,
) -> DataFrame:
    """All tags of each article, beside its other columns; its words are read once.

    Keywords or country names beyond ``DICTIONARY_LIMIT`` are joined; the tags are the same.
    """
    keywords = small_dictionary(lexicon, "keyword")
    names = countries.select("country", fold(F.col("country")).alias("term")).where("term <> ''")
    spelling = names.groupBy("term").agg(F.min("country").alias("country"))
    rows = spelling.limit(DICTIONARY_LIMIT + 1).collect()
    if keywords is None or len(rows) > DICTIONARY_LIMIT:
        return _tag_by_join(articles, lexicon, countries, pillars, weights, incident_terms)
    country_names = {r["term"]: r["country"] for r in rows}
    pillar_terms = {name: sorted(terms) for name, terms in pillars.items()}
    plain = {t for terms in [*pillar_terms.values(), *weights.values(), incident_terms] for t in terms}
    dictionary = {*keywords, *plain, *country_names}

    keys = [c for c in articles.columns if c != "text"]
    spelled = articles.withColumn("word_list", words(F.col("text")))
    hit = compute_once(spelled, "hits", term_hits(F.col("word_list"), dictionary))
    found = hit.select("*", found_terms(F.col("hits")).alias("found"))
    is_country = lexicons.text_array(sorted(country_names) or [""])
    has_incident = F.arrays_overlap("found", lexicons.text_array(incident_terms))
    category = pillar(F.col("found"), pillar_terms)
    country_hits = F.filter("hits", lambda h: F.array_contains(is_country, h["term"]))
    return found.select(
        *keys,
        category.alias("category"),
        F.when(category == "", "No").otherwise("Yes").alias("esg_check"),
        polarity(F.col("found"), weights).alias("sentiment"),
        F.array_intersect("found", lexicons.text_array(keywords or [""])).alias("themes"),
        F.coalesce(
            F.when(has_incident, F.nullif(incident_text(F.col("text"), incident_terms), F.lit(""))),
            F.lit(NO_INCIDENT),
        ).alias("incidents"),
        first_country(country_hits, country_names).alias("country"),
        first_date(F.col("text")).alias("date"),
    )


def _tag_by_join(articles, lexicon, countries, pillars, weights, incident_terms) -> DataFrame:
    """``tag_articles`` with themes and countries from joins, row by row of ``articles``."""
    marked = stage(articles.withColumn("row_mark", F.monotonically_increasing_id()))
    base = tag_articles(marked, lexicon.limit(0), countries.limit(0), pillars, weights, incident_terms)
    keyed = marked.select(F.col("row_mark").alias("doc_id"), "text")
    hits = join_hits(keyed, lexicon, "keyword").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("joined_themes"))
    named = tag_countries(keyed, countries).withColumnRenamed("country", "joined_country")
    found = named.join(hits, "doc_id", "left").withColumnRenamed("doc_id", "row_mark")
    joined = base.join(found, "row_mark", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({"themes": F.coalesce("joined_themes", none), "country": F.col("joined_country")}).select(
        *[c for c in base.columns if c != "row_mark"]
    )


def rule_replies(tags: DataFrame) -> DataFrame:
    """The tags written as a classifier would reply, beside the key columns."""
    summary = F.col("summary") if "summary" in tags.columns else F.lit("")
    full = F.struct(
        F.col("category").alias("categories"),
        "sentiment",
        "incidents",
        "themes",
        summary.alias("summary"),
        "country",
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"),
    )
    none = F.to_json(F.struct(F.lit("No").alias("esg_check")))
    keys = [c for c in tags.columns if c not in TAGS]
    reply = F.when(F.col("esg_check") == "No", none).otherwise(F.to_json(full))
    return compute_once(tags, "reply", reply).select(*keys, "reply")


def classify(
    articles: DataFrame, classifier: Callable[[list[str]], list[str]], batch_bytes: int = 1 << 22
) -> DataFrame:
    """Add ``reply`` and ``error`` from a Python function over batches of texts.

    A batch that fails is cut in halves, each tried again, down to the texts that fail by
    themselves: one bad text among n costs some 2 log2 n calls, and an error marks its own row.
    A batch given to the function holds at most ``batch_bytes`` of text, or one text.
    """

    def answered(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = classifier(texts)
            if len(replies) != len(texts):
                raise ValueError("the classifier must return one reply per text")
            return [(reply, None) for reply in replies]
        except Exception as error:
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
        middle = len(texts) // 2
        return answered(texts[:middle]) + answered(texts[middle:])

    def bounded(texts: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for text in texts:
            own = len(text.encode("utf-8", "surrogatepass")) if text is not None else 0
            if held and size + own > batch_bytes:
                yield held
                held, size = [], 0
            held.append(text)
            size += own
        if held:
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [pair for texts in bounded(batch.pop("text").tolist()) for pair in answered(texts)]
            batch["reply"] = [reply for reply, _ in pairs]
            batch["error"] = [error for _, error in pairs]
            yield batch

    keys = [f for f in articles.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    ordered = articles.select(*[f.name for f in keys], "text")
    return ordered.mapInPandas(run, f"{schema}, reply string, error string")
