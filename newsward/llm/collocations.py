"""Collocations: phrases whose words occur together far more often than their parts allow.

Words get numbers, n-grams of numbers are counted in counting quotient filters, longer
n-grams only where all their parts are frequent.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsward.llm import quotient
from newsward.llm.common import FILTER_BITS, Batches, column, give_back, in_slices, runs, running_total, written
from newsward.llm.words import IS_SPACE, LOWER, flat, mix

LEAST = 30
LONGEST = 4
CONTAINED = 80  # percent
SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"
# N-grams that a task counts before it sends their filters on, and that a shard holds at most about.
BUFFER = 1 << 21
SHARD = 1 << 21
# Numbers of words that a task packs by block at a time: 16 MB.
PACKED = 1 << 20
# Lower case, and marks that end a piece as line ends.
PIECES = LOWER.copy()
PIECES[[ord(c) for c in ".,;:!?"]] = 0x0A
TOKENS = "langs array<string>, words array<string>, counts array<bigint>, codes binary"


def _word_column(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words as an Arrow column, the first word of each row, and whether a piece starts at a word."""
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    kept = data[word]
    arrow = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(kept))
    breaks = np.searchsorted(np.flatnonzero((data >= 0x0A) & (data <= 0x0D)), starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = breaks[1:] != breaks[:-1]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    return arrow, first, opens


def tokens(docs: DataFrame) -> DataFrame:
    """A row per few MB of text: its distinct words (by language) with their counts, and the
    text as places in that list, 0 where a piece ends, the list's first entry being 1."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = flat(batch.column(1))
        words, first, opens = _word_column(PIECES[data], offsets)
        if len(words) == 0:
            return None
        coded = pc.dictionary_encode(words)
        langs = pc.dictionary_encode(batch.column(0))
        own = np.repeat(langs.indices.to_numpy(), np.diff(first)).astype(np.int64)
        pair = coded.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + own
        counts = np.bincount(pair)
        present = np.flatnonzero(counts)
        present = present[np.argsort(-counts[present], kind="stable")]
        place = np.zeros(len(counts), np.int32)
        place[present] = np.arange(1, len(present) + 1)
        text = np.zeros(len(pair) + int(opens.sum()), np.int32)
        text[np.arange(len(pair)) + np.cumsum(opens)] = place[pair]
        word, lang = divmod(present, len(langs.dictionary))
        whole = [0, len(present)]
        arrays = [
            pa.ListArray.from_arrays(whole, langs.dictionary.take(pa.array(lang))),
            pa.ListArray.from_arrays(whole, coded.dictionary.take(pa.array(word)).cast(pa.string())),
            pa.ListArray.from_arrays(whole, pa.array(counts[present], pa.int64())),
            pa.array([text.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["langs", "words", "counts", "codes"])

    return docs.mapInArrow(in_slices(count, docs.columns[1], 4 << 20), TOKENS)


def vocabulary(blocks: DataFrame, least: int) -> DataFrame:
    """``lang, word, f, id`` of the words that occur ``least`` times or more; ids count from 1."""
    pairs = blocks.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("x"))
    counts = pairs.groupBy(F.col("x.langs").alias("lang"), F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    frequent = counts.where(F.col("f") >= least).withColumn("one", F.lit(1))
    return running_total(frequent, ["lang", "word"], "one", "place").select("lang", "word", "f", (F.col("place") + 1).alias("id"))


def numbered_texts(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``ids`` of each block: its text as word ids of 32 bits, 0 for breaks and rare words.

    Each block asks for its distinct words only, and they meet the vocabulary in a join, so
    neither has to fit a task. Numbers leave a task of the join packed by block, and a block's codes
    and numbers meet by a sort, which Spark can do on disk; no list of rows is held in its memory.
    """
    asked = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words")).alias("place", "x")).select("block", "place", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"))
    known = asked.join(words.select("lang", "word", "id"), ["lang", "word"])
    # The place in the high half, the id in the low one.
    slot = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("id"))

    def by_block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own, slots = (np.concatenate(arrays) for arrays in zip(*parts))
        order = np.argsort(own, kind="stable")
        own, slots = own[order], slots[order]
        edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(slots)])
        return pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), packed], names=["block", "packed"])

    def pack(batches: Batches) -> Batches:
        parts, held = [], 0
        for batch in batches:
            parts.append((column(batch, "block").copy(), column(batch, "slot").copy()))
            held += batch.num_rows
            if held >= PACKED:
                yield by_block(parts)
                parts, held = [], 0
        if held:
            yield by_block(parts)

    def translate(batches: Batches) -> Batches:
        codes, table = None, None
        for batch in batches:
            for place, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                if place == 0:
                    if codes is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([table[codes].tobytes()], pa.binary())], names=["ids"])
                    codes = np.frombuffer(raw.as_py(), np.int32)
                    table = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
                else:
                    slots = np.frombuffer(raw.as_buffer(), np.int64)
                    table[(slots >> 32) + 1] = slots & 0xFFFFFFFF
        if codes is not None:
            yield pa.RecordBatch.from_arrays([pa.array([table[codes].tobytes()], pa.binary())], names=["ids"])
        give_back()

    numbers = known.select("block", slot.alias("slot")).mapInArrow(pack, "block bigint, packed binary")
    rows = blocks.select("block", F.lit(0).alias("part"), F.col("codes").alias("packed")).union(numbers.select("block", F.lit(1), "packed"))
    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(translate, "ids binary")


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of permuted n-grams, for the bit map."""
    with np.errstate(over="ignore"):
        return mix(left ^ mix(right + np.uint64(1)))


def bit_map(frequent: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that passes every n-gram of ``frequent(key)`` and few others. The map has at most
    2**27 bits, 16 MB; with more n-grams than it serves well more pass, never fewer."""
    bits = min(FILTER_BITS, max(16, (8 * frequent.count()).bit_length()))
    place = F.pmod("key", F.lit(1 << bits))
    table = frequent.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")
    ).toArrow()  # at most 2**21 rows of two numbers
    masks = np.zeros(1 << (bits - 6), np.int64)
    masks[table["word"].to_numpy()] = table["mask"].to_numpy()
    shared = frequent.sparkSession.sparkContext.broadcast(masks)

    def test(keys: np.ndarray) -> np.ndarray:
        at = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        return (shared.value[at >> 6] >> (at & 63)) & 1 == 1

    return test


def partial_filters(texts: DataFrame, n: int, width: int, shard_bits: int, passes) -> DataFrame:
    """``shard, filter`` of the n-grams that a task has read, about ``BUFFER`` at a time.

    ``passes`` tests n-grams one word shorter: an n-gram counts only if its first and its
    last n - 1 words pass.
    """

    def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = max(len(ids) - n + 1, 0)
        whole = np.ones(size, bool)
        for k in range(n):
            whole &= ids[k : k + size] != 0
        at = np.flatnonzero(whole)
        if n > 2 and len(at):
            starts = np.unique(np.concatenate([at, at + 1]))
            short = quotient.permuted(*quotient.packed([ids[starts + k] for k in range(n - 1)], width), n - 1, width)
            good = np.zeros(len(ids), bool)
            good[starts[passes(_key(*short))]] = True
            at = at[good[at] & good[at + 1]]
        return quotient.permuted(*quotient.packed([ids[at + k] for k in range(n)], width), n, width)

    def sent(parts) -> Batches:
        left, right, counts = quotient.merged(parts, n, width)  # which empties the list
        shards = quotient.shard_of(left, n, width, shard_bits)
        edges = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else [0]
        for low, high in zip(edges[:-1], edges[1:]):
            raw = quotient.encoded((left[low:high], right[low:high], counts[low:high]), n, width, shard_bits)
            yield pa.RecordBatch.from_arrays([pa.array([int(shards[low])], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "filter"])

    def run(batches: Batches) -> Batches:
        parts, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = grams(np.frombuffer(batch.column(0)[k].as_buffer(), np.uint32))
                parts.append(quotient.counted(left, right, np.ones(len(left), np.int64), n, width))
                held += len(parts[-1][0])
                if held >= BUFFER:
                    yield from sent(parts)
                    parts, held = [], 0
                    give_back()
        if held:
            yield from sent(parts)
        del parts
        give_back()

    return texts.select("ids").mapInArrow(run, "shard bigint, filter binary")


def frequent_grams(filters: DataFrame, n: int, width: int, shard_bits: int, least: int) -> DataFrame:
    """``ids, f, key`` of the n-grams that occur ``least`` times or more over all filters."""

    def run(batches: Batches) -> Batches:
        for table in runs(batches, "shard"):
            shards = column(table, "shard")
            edges = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            raws = table.column("filter")
            for low, high in zip(edges[:-1], edges[1:]):
                parts, held = [], 0
                for k in range(low, high):
                    parts.append(quotient.decoded(raws[k].as_py(), n, width, shard_bits))
                    held += len(parts[-1][0])
                    if held > 2 * len(parts[0][0]) and len(parts) > 8:
                        parts = [quotient.merged(parts, n, width)]
                        held = len(parts[0][0])
                left, right, counts = quotient.merged(parts, n, width)
                often = counts >= least
                left, right, counts = left[often], right[often], counts[often]
                ids = quotient.unpacked(*quotient.restored(left, right, n, width), n, width)
                arrow = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, n), pa.int32()), pa.array(ids.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([arrow, pa.array(counts), pa.array(_key(left, right).view(np.int64))], names=["ids", "f", "key"])
            give_back()

    dealt = filters.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "ids array<bigint>, f bigint, key bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, n`` of all words; ``lang, word, f, id`` of frequent words; ``ids, f`` of frequent
    phrases of 1 to ``longest`` words. ``docs`` has the columns ``lang`` and ``text`` in that order."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = written(tokens(own).withColumn("block", F.monotonically_increasing_id()), "tokens")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "counts")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n"))
    words = written(vocabulary(blocks, least), "vocabulary")
    highest, occurrences = words.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    texts = written(numbered_texts(blocks, words), "ids")
    width = max(1, int(highest).bit_length())
    shard_bits = max(3, (occurrences // SHARD).bit_length())
    found, passes = [words.select(F.array("id").alias("ids"), "f")], None
    for n in range(2, longest + 1):
        filters = partial_filters(texts, n, width, shard_bits, passes)
        frequent = written(frequent_grams(filters, n, width, shard_bits, least), f"grams-{n}")
        passes = bit_map(frequent) if n < longest else None
        found.append(frequent.select("ids", "f"))
    grams = found[0]
    for more in found[1:]:
        grams = grams.union(more)
    return totals, words, grams


def scored(grams: DataFrame) -> DataFrame:
    """``ids, a, l, r, score`` of every phrase of two words or more, by its lowest-scoring cut."""
    cuts = grams.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    parts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    firsts = grams.select(F.col("ids").alias("first"), F.col("f").alias("l"))
    rests = grams.select(F.col("ids").alias("rest"), F.col("f").alias("r"))
    joined = parts.join(firsts, "first").join(rests, "rest")
    score = F.expr(f"(cast(a as decimal(19,0)) * {SCALE}) div (cast(l as decimal(19,0)) + r)")
    best = joined.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("ids", "a", "cut.l", "cut.r", "cut.score")


def uncontained(grams: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """``phrases`` that no longer frequent phrase around them explains."""
    longer = grams.where(F.size("ids") > 2).select("ids", "f", F.explode(F.expr("sequence(2, size(ids) - 1)")).alias("size"))
    inner = longer.select("f", F.explode(F.expr("transform(sequence(1, size(ids) - size + 1), k -> slice(ids, k, size))")).alias("ids"))
    around = inner.groupBy("ids").agg(F.max("f").alias("around"))
    return phrases.join(around, "ids", "left").where(~F.coalesce(F.expr(f"100 * cast(around as decimal(19,0)) >= {percent} * cast(a as decimal(19,0))"), F.lit(False))).drop("around")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has columns ``lang`` and ``text`` and may have others. Letters A-Z are lowered; a
    piece ends at ``.,;:!?`` and line ends, words at spaces and tabs, and phrases stay within
    pieces. A null language is ``und``, a null or empty text has no words. Every row counts,
    repeated ones too. A phrase of 2 to ``longest`` words needs ``least`` occurrences ``a``; ``l`` and ``r``
    count the parts of its lowest-scoring cut, ties by the earlier cut. Equal scores are
    ordered by ``a``, then by the phrase's bytes. All counts are exact: words meet by their text,
    and a filter's entries hold whole n-grams.
    """
    totals, words, grams = phrase_counts(docs.select("lang", "text"), least, longest)
    left = written(uncontained(grams, scored(grams), contained), "phrases")
    spelled = left.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    parts = spelled.groupBy("ids").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("parts"))
    phrases = parts.select("ids", "lang", F.array_join(F.col("parts.word"), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.join(phrases, "ids").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    counted = ranked.join(totals, "lang")
    return counted.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
