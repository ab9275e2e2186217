"""Substring dedup: passages whose word sequence recurs, found exactly.

Every window of 35 words holds a content-chosen anchor, so equal windows meet at equal
anchors. The surroundings of recurring anchors are dealt to shards by anchor; a shard
confirms which windows recur, compiles an Aho-Corasick automaton of the passages they
form and streams the surroundings of all documents through it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import Batches, column, in_slices, key_filter, runs, text_key, written
from newsward.llm.words import BASE, INVERSE, grams, mix, powers, words

WINDOW = 35
ANCHOR_WORDS = 8
# Bytes that stand for a word in a shard.
CODE_BYTES = 5
# Windows of a long text worked on at a time.
PIECE = 1 << 14
# An anchor with more surroundings is confirmed window by window and dealt to many shards.
SHARD_LIMIT = 512


def sequence_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each text's whole word sequence."""
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        scrambled = mix(hashes + mix(place.astype(np.uint64) + np.uint64(1)))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(scrambled, out=sums[1:])
        return mix(sums[first[1:]] - sums[first[:-1]] + mix(np.diff(first).astype(np.uint64))).view(np.int64)


def owners(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a text and, for each of its windows, which gram it is owned by: the
    leftmost of least hash. Owners never go back, so a gram owns a run of windows."""
    size = min(ANCHOR_WORDS, window)
    found = grams(hashes, size)
    wide = window - size + 1
    if len(found) < wide:
        return found, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(found, wide)
    # In pieces: the least of each window is sought in a copy of them all.
    least = [view[at : at + PIECE].argmin(1) for at in range(0, len(view), PIECE)]
    return found, np.concatenate(least) + np.arange(len(view))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``doc_key, seq, n_words, anchors``: the hashes of the grams that own windows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, _, _, first, _ = words(batch.column(1))
        own = []
        for low, high in zip(first[:-1], first[1:]):
            found, owner = owners(hashes[low:high], window)
            own.append(found[np.unique(owner)].tobytes())
        arrays = [batch.column(0), pa.array(sequence_keys(hashes, first)), pa.array(np.diff(first)), pa.array(own, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_key", "seq", "n_words", "anchors"])

    schema = "doc_key bigint, seq bigint, n_words bigint, anchors binary"
    return docs.select(text_key(), "text").mapInArrow(in_slices(work, "text"), schema)


def _anchor_rows(batches: Batches) -> Batches:
    for batch in batches:
        packed = batch.column(1).to_pylist()
        found = np.frombuffer(b"".join(packed), np.int64)
        seq = np.repeat(column(batch, "seq"), [len(x) // 8 for x in packed])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seq)], names=["anchor", "seq"])


def surroundings(texts: DataFrame, window: int) -> DataFrame:
    """For each recurring anchor of ``texts(doc_key, text, seq, recurring)``, the words of
    the windows it owns: ``anchor, segment, uses, codes, places``. Equal surroundings of a
    few MB of text are one row; ``places`` are the (seq, first word) where they stand."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, _, _, first, _ = words(batch.column(1))
        keys, wanted = sequence_keys(hashes, first), column(batch, "seq")
        recurring = batch.column(3).to_pylist()
        anchor, segment, seq, start, size = [], [], [], [], []
        prefix = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * powers(BASE, len(hashes)), out=prefix[1:])
        for row, (low, high) in enumerate(zip(first[:-1], first[1:])):
            if keys[row] != wanted[row]:
                continue  # another text under a repeated id
            found, owner = owners(hashes[low:high], window)
            gram, begin, many = np.unique(owner, return_index=True, return_counts=True)
            good = np.isin(found[gram].view(np.int64), np.array(recurring[row], np.int64))
            anchor.append(found[gram[good]])
            seq.append(np.full(good.sum(), keys[row]))
            start.append(begin[good] + low)
            size.append(many[good] + window - 1)
            segment.append(begin[good])
        if not anchor or not sum(map(len, anchor)):
            return None
        anchor, seq, start, size, place = map(np.concatenate, (anchor, seq, start, size, segment))
        with np.errstate(over="ignore"):
            shift = powers(INVERSE, len(hashes) + 1)
            segment = mix((prefix[start + size] - prefix[start]) * shift[start] + size.astype(np.uint64))
        _, at, inverse, uses = np.unique(segment, return_index=True, return_inverse=True, return_counts=True)
        raw = hashes.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]
        codes = [raw[start[k] : start[k] + size[k]].tobytes() for k in at]
        order = np.argsort(inverse, kind="stable")
        stand = np.column_stack([seq, place])[order]
        cuts = np.concatenate([[0], np.cumsum(uses)])
        places = [stand[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        arrays = [anchor[at].view(np.int64), segment[at].view(np.int64), uses.astype(np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(codes, pa.binary()), pa.array(places, pa.binary())], names=["anchor", "segment", "uses", "codes", "places"])

    schema = "anchor bigint, segment bigint, uses bigint, codes binary, places binary"
    return texts.select("doc_key", "text", "seq", "recurring").mapInArrow(in_slices(work, "text"), schema)


def window_names(packed: list[bytes], anchor: np.ndarray, window: int):
    """The word codes of surroundings laid end to end, where each ends, and for each
    window its surrounding, its first word there and a name by its anchor and words."""
    sizes = np.array([len(x) // CODE_BYTES for x in packed])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :CODE_BYTES] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, CODE_BYTES)
    codes = wide.view(np.uint64).ravel()
    ends = np.cumsum(sizes)
    found = grams(mix(codes), window)
    counts = sizes - window + 1
    which = np.repeat(np.arange(len(packed)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        names = mix(found[(ends - sizes)[which] + place] ^ mix(anchor.astype(np.int64).view(np.uint64)[which]))
    return codes, ends, which, place, names


def covers_by_automaton(codes: np.ndarray, ends: np.ndarray, which: np.ndarray, place: np.ndarray, recurs: np.ndarray, window: int):
    """Which surroundings hold a recurring passage, and its (first, end) word pairs there.

    Runs of recurring windows are passages; one automaton of all of them reads every
    surrounding that holds one.
    """
    import ahocorasick

    begins = np.append(0, ends[:-1])
    edge = np.flatnonzero(recurs)
    new = np.ones(len(edge), bool)
    new[1:] = (np.diff(edge) > 1) | (which[edge[1:]] != which[edge[:-1]])
    heads = edge[new]
    lengths = np.diff(np.append(np.flatnonzero(new), len(edge))) + window - 1
    _, letters = np.unique(codes, return_inverse=True)
    letters = letters.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for head, length in zip(heads.tolist(), lengths.tolist()):
        base = int(begins[which[head]] + place[head])
        automaton.add_word(tuple(letters[base : base + length]), length)
    automaton.make_automaton()
    touched = np.unique(which[edge])
    out = []
    for k in touched.tolist():
        own = tuple(letters[begins[k] : ends[k]])
        spans = [(end + 1 - length, end + 1) for end, length in automaton.iter(own)]
        out.append(np.array(spans, "<i4").tobytes())
    return touched, out


def located(segments: DataFrame, window: int) -> DataFrame:
    """``segment, covers`` of each distinct surrounding with a recurring passage; covers
    are (first word, end word) pairs of 32 bits within the surrounding.

    An anchor's surroundings are one shard. Anchors with very many (a common phrase in
    ever new texts) are told by a bit map, which may pass others too: either way gives
    the same covers.
    """

    def shards(batches: Batches) -> Batches:
        for table in runs(batches, "anchor"):
            segment, uses = column(table, "segment"), column(table, "uses")
            keys, at, inverse = np.unique(segment, return_index=True, return_inverse=True)
            total = np.bincount(inverse, uses)
            packed = table["codes"].take(pa.array(at)).to_pylist()
            codes, ends, which, place, names = window_names(packed, column(table, "anchor")[at], window)
            _, name = np.unique(names, return_inverse=True)
            recurs = np.bincount(name, total[which])[name] >= 2
            if recurs.any():
                touched, covers = covers_by_automaton(codes, ends, which, place, recurs, window)
                yield pa.RecordBatch.from_arrays([pa.array(keys[touched]), pa.array(covers, pa.binary())], names=["segment", "covers"])

    many = segments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_LIMIT).select("anchor")
    large = key_filter(written(many, "many"), "anchor")(F.col("anchor"))
    dealt = segments.where(~large).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(shards, "segment bigint, covers binary").union(located_in_large(segments.where(large), window))


def located_in_large(segments: DataFrame, window: int) -> DataFrame:
    """As :func:`located` for anchors with very many surroundings: each window is a row
    of its own, counted over all tasks; every surrounding then knows which of its windows
    recur, and any handful of surroundings is a shard."""

    def named(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                _, _, which, place, names = window_names(batch.column(2).to_pylist(), column(batch, "anchor"), window)
                arrays = [column(batch, "segment")[which], place.astype(np.int32), names.view(np.int64), column(batch, "uses")[which]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["segment", "place", "name", "uses"])

    def shards(batches: Batches) -> Batches:
        for batch in batches:
            for low in range(0, batch.num_rows, SHARD_LIMIT):
                part = batch.slice(low, SHARD_LIMIT)
                codes, ends, which, place, _ = window_names(part.column(2).to_pylist(), column(part, "anchor"), window)
                at = part.column(3).to_pylist()
                firsts = np.searchsorted(which, np.arange(part.num_rows))
                recurs = np.zeros(len(which), bool)
                recurs[np.concatenate([first + np.array(own) for first, own in zip(firsts, at)])] = True
                touched, covers = covers_by_automaton(codes, ends, which, place, recurs, window)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(touched)), pa.array(covers, pa.binary())], names=["segment", "covers"])

    once = written(segments.groupBy("segment").agg(F.first("anchor").alias("anchor"), F.first("codes").alias("codes"), F.sum("uses").alias("uses")), "once")
    windows = once.select("segment", "anchor", "codes", "uses").mapInArrow(named, "segment bigint, place int, name bigint, uses bigint")
    again = written(windows.groupBy("name").agg(F.sum("uses").alias("n")).where("n > 1").select("name"), "again")
    places = windows.join(again, "name").groupBy("segment").agg(F.collect_list("place").alias("places"))  # at most window - 7
    rows = once.join(places, "segment").select("segment", "anchor", "codes", "places")
    return rows.mapInArrow(shards, "segment bigint, covers binary")


def _placed(batches: Batches) -> Batches:
    """Covers of a surrounding, moved to where it stands in its texts."""
    for batch in batches:
        for places, covers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stand = np.frombuffer(places, np.int64).reshape(-1, 2)
            spans = np.frombuffer(covers, "<i4").reshape(-1, 2).astype(np.int64)
            spans = np.unique(spans, axis=0)
            moved = stand[:, None, 1:] + spans[None, :, :]
            rows = [x.tobytes() for x in moved.reshape(len(stand), -1)]
            yield pa.RecordBatch.from_arrays([pa.array(stand[:, 0]), pa.array(rows, pa.binary())], names=["seq", "spans"])


def recurring_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``seq, copies, spans``: for each word sequence of which something recurs, how many
    rows have it and a list of (first, end) word pairs of 64 bits, which may overlap."""
    signed = written(anchors(docs, window), "anchors")
    texts = signed.groupBy("seq").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"), F.min("doc_key").alias("doc_key"))
    once = signed.where("length(anchors) > 0").select("seq", "anchors").dropDuplicates(["seq"])
    rows = once.mapInArrow(_anchor_rows, "anchor bigint, seq bigint")
    often = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Written first, so that the join is one of plain shuffles and Spark splits a hot anchor.
    often = written(often, "often")
    # The anchors of one text, which its length bounds.
    recurring = rows.join(often, "anchor").groupBy("seq").agg(F.collect_set("anchor").alias("recurring"))
    wanted = written(recurring.join(texts, "seq").select("seq", "doc_key", "recurring"), "wanted")
    passes = key_filter(wanted.select("doc_key"), "doc_key")
    some = docs.select(text_key(), "text").where(passes(F.col("doc_key")))
    segments = written(surroundings(some.join(wanted, "doc_key"), window), "segments")
    covers = located(segments.select("anchor", "segment", "uses", "codes"), window)
    placed = segments.select("segment", "places").join(covers, "segment").select("places", "covers").mapInArrow(_placed, "seq bigint, spans binary")
    spans = placed.groupBy("seq").agg(F.collect_list("spans").alias("spans"))
    found = texts.join(spans, "seq", "left").where(F.col("spans").isNotNull() | ((F.col("copies") > 1) & (F.col("n_words") >= window)))
    return found.select("seq", "copies", "spans")


def _covered(count: int, copies: int | None, spans: list[bytes] | None, window: int) -> np.ndarray:
    """Which words of a text of ``count`` words are removed."""
    if copies is not None and copies > 1 and count >= window:
        return np.ones(count, bool)
    change = np.zeros(count + 1, np.int64)
    for packed in spans or ():
        pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change)[:count] > 0


def judged(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` as ``own_row``, and ``removal``: the words, the words removed,
    the text kept and its SHA-256.

    A word goes if a window of ``window`` words that covers it starts anywhere else too,
    in this text or another; kept words are joined by one space. Null texts have no
    words, texts below the window lose none; rows of equal words all lose them; rows of
    one id with other texts are judged each by its text.
    """

    def keys(texts: pa.Array) -> pa.Array:
        hashes, _, _, first, _ = words(texts)
        return pa.array(sequence_keys(hashes, first))

    def cut(texts: pa.Array, copies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, many, found in zip(texts.to_pylist(), copies.to_pylist(), spans.to_pylist()):
            own = text.encode().split()
            gone = _covered(len(own), many, found, window)
            kept = [own[k] for k in np.flatnonzero(~gone)] if gone.any() else own
            joined = b" ".join(kept)
            out.append({"n_words": len(own), "n_removed": int(gone.sum()), "kept": joined.decode(), "sha256": hashlib.sha256(joined).hexdigest()})
        kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("sha256", pa.string())])
        return pa.array(out, kind)

    spans = recurring_spans(docs, window).withColumnsRenamed({"seq": "own_seq", "copies": "own_copies", "spans": "own_spans"})
    rows = docs.select(F.struct(*docs.columns).alias("own_row"))
    text = F.coalesce(F.col("own_row.text"), F.lit(""))
    joined = rows.withColumn("own_seq", F.arrow_udf(keys, "bigint")(text)).join(spans, "own_seq", "left")
    removal = F.arrow_udf(cut, "struct<n_words:bigint,n_removed:bigint,kept:string,sha256:string>")
    return joined.select("own_row", removal(text, F.col("own_copies"), F.col("own_spans")).alias("removal"))


def remove_recurring(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row; see :func:`judged`."""
    out = judged(docs.select("doc_id", "text"), window)
    return out.select("own_row.doc_id", "removal.n_words", "removal.n_removed", F.col("removal.sha256").alias("kept_sha256"))
