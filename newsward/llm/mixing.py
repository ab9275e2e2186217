"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import running_total, written
from newsward.llm.words import flat, word_starts, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2


def count_words(text: pa.Array) -> pa.Array:
    data, offsets = flat(text)
    return pa.array(np.diff(np.searchsorted(word_starts(data, offsets), offsets)), pa.int64())


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source_size`` and ``target`` words of every source.

    Sources in code-point order, null last, get the weights in turn. A target above
    ``most`` times its source is cut to it and the excess goes to the others by weight,
    until none is above. With full sources F and rate r for the rest, that is
    ``target = min(most * size, r * weight)``; sources fill up in the order of
    ``most * size / weight``, so one running total over that order finds r. These rows
    are one per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Java compares strings as UTF-8 bytes in Spark, which is the order of code points.
    ranked = running_total(by_source.withColumn("one", F.lit(1)).withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "one", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = ranked.select("source", "source_size", "place", weight.alias("weight"))
    # Whole numbers of milli-weights keep sums exact in any order.
    scaled = sources.withColumn("weight_units", F.round(F.col("weight") * 1000).cast("bigint"))
    limit = (F.lit(float(most)) * F.col("source_size")).alias("limit")
    rows = scaled.select("*", limit, (F.col("source_size") / F.col("weight_units")).alias("fills_at"))
    rows = running_total(rows, ["fills_at", "place"], "weight_units", "weight_before")
    rows = running_total(rows, ["fills_at", "place"], "source_size", "size_before")
    whole = rows.agg(F.sum("source_size"), F.sum("weight_units")).first()
    all_size, all_weight = (int(whole[0] or 0), int(whole[1] or 0))
    budget = F.lit(float(share)) * F.lit(float(all_size))
    # The rate if all sources before this one are full and none from here on is.
    rate = (budget - F.lit(float(most)) * F.col("size_before")) / (F.lit(all_weight) - F.col("weight_before"))
    rows = rows.withColumn("rate_here", rate)
    # The rate is that of the first source in this order that it doesn't fill.
    first = rows.where(F.col("rate_here") * F.col("weight_units") <= F.col("limit")).agg(
        F.min(F.struct("fills_at", "place", "rate_here")).alias("open_from")
    ).first()["open_from"]
    target = F.col("limit") if first is None else F.least(F.col("limit"), F.lit(first["rate_here"]) * F.col("weight_units"))
    return rows.select("source", "source_size", target.alias("target"))


def fair_queue(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``docs(doc_id, row_no, source, size)`` with ``source_size``, ``target``, ``taken``
    and ``parts``, the words taken in each epoch.

    Each source's documents are shuffled by a hash and stand in line, epoch after epoch;
    each document is one item per epoch. An item's virtual finish time is the words of its source
    up to its end, divided by the source's target. All items are sorted by that time over all sources and
    served in this order until the total budget is spent; the item being served then is cut.
    Equal times go by source, then by place in line. A source of no words has target 0
    and takes nothing. Null sources form a source of their own. Rows of equal ids are
    separate documents, told apart by ``row_no``. Whole numbers of words; the same input gives the same result.
    """
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")).cast("binary"))
    shuffled = docs.withColumn("turn", turn).withColumn("no_source", F.col("source").isNull())
    placed = running_total(shuffled, ["no_source", "source", "turn", "row_no"], "size", "words_before")
    per_source = targets(docs, weights, share, most)
    starts = placed.groupBy("source").agg(F.min("words_before").alias("source_start"))
    per_source = written(per_source.alias("t").join(starts.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "s.source_start"), "targets")
    lined = placed.alias("d").join(per_source.alias("t"), F.expr("d.source <=> t.source"))
    before = F.col("words_before") - F.col("source_start")
    lined = lined.select("d.row_no", "d.size", "d.no_source", F.col("d.source").alias("source"), before.alias("before"), "t.source_size", "t.target")
    epochs = F.sequence(F.lit(0), F.lit(int(most) - 1))
    items = lined.where("target > 0 AND size > 0").select("*", F.explode(epochs).alias("epoch"))
    end = F.col("before") + F.col("size") + F.col("epoch") * F.col("source_size")
    items = items.select("row_no", "epoch", "size", "no_source", "source", end.alias("end"), (end / F.col("target")).alias("finish_time"))
    queue = running_total(items, ["finish_time", "no_source", "source", "end"], "size", "served_before")
    budget = int(docs.agg(F.sum("size")).first()[0] or 0)
    budget = F.lit(int(min(share, most) * budget + 0.5))
    served = queue.withColumn("part", F.least(F.col("size"), F.greatest(budget - F.col("served_before"), F.lit(0))))
    taken = served.where("part > 0").groupBy("row_no").agg(F.sum("part").alias("taken"), F.collect_list("part").alias("parts"))
    whole = docs.alias("d").join(per_source.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.source_size", "t.target")
    joined = whole.join(taken, "row_no", "left")
    return joined.select(*docs.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("parts", F.array().cast("array<bigint>")).alias("parts"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    count = F.arrow_udf(count_words, "bigint")
    return docs.withColumn("size", count(F.coalesce(F.col(text), F.lit(""))))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    narrow = sized(docs.select("doc_id", "source", "text")).select("doc_id", F.col("source").cast("string").alias("source"), "size")
    numbered = written(narrow.withColumn("row_no", F.monotonically_increasing_id()), "mix")
    return fair_queue(numbered, seed).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: pa.Array, counts: pa.Array) -> pa.Array:
    """Each text up to the end of its first ``counts`` words."""
    _, _, ends, first, data = words(text)
    _, offsets = flat(text)
    out = []
    for k, count in enumerate(counts.to_numpy(zero_copy_only=False)):
        stop = ends[first[k] + count - 1] if count else offsets[k]
        out.append(data[offsets[k] : stop].tobytes().decode())
    return pa.array(out, pa.string())


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; the document being served
    when the budget ends is cut there. Rows of no words are not taken; ``n_chars``, if
    there is one, is that of the text."""
    own = docs.select(F.struct(*docs.columns).alias("own_row"))
    text = F.col("own_row.text")
    numbered = own.withColumn("size", F.arrow_udf(count_words, "bigint")(F.coalesce(text, F.lit(""))))
    numbered = written(numbered.withColumn("row_no", F.monotonically_increasing_id()), "mix")
    narrow = numbered.select("own_row.doc_id", "row_no", F.col("own_row.source").cast("string").alias("source"), "size")
    served = fair_queue(narrow, seed).where("taken > 0").select("row_no", F.explode("parts").alias("part")).where("part > 0")
    rows = numbered.join(served, "row_no")
    cut = F.arrow_udf(first_words, "string")
    part = F.when(F.col("part") < F.col("size"), cut(text, F.col("part"))).otherwise(text)
    return with_text(rows, part)


def with_text(rows: DataFrame, text) -> DataFrame:
    """The columns of ``own_row`` with another text, and ``n_chars``, if there is one, to match."""
    row = F.col("own_row").withField("text", text)
    if "n_chars" in rows.schema["own_row"].dataType.names:
        row = row.withField("n_chars", F.length(text).cast("bigint"))
    return rows.select(row.alias("own_row")).select("own_row.*")
