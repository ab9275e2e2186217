"""Packing along a space-filling curve: similar documents share a sequence."""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import Batches, column, give_back, running_total, written
from newsward.llm.words import LOWER, flat, slices, words

LENGTH = 1024
DIMENSIONS = 3
BITS = 16
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


# Distinct segments whose ids a worker remembers; then it keeps those it met again.
REMEMBERED = 1 << 18
# Bytes of text worked on at a time, and segments that the tokenizer gets as one text.
SLICE_BYTES = 2 << 20
JOINED = 256
# Segments of visible ASCII, after a blank at most. "<" begins the special token, so those with one go alone.
PLAIN = r"^ ?[!-;=-~]+$"


class Segments:
    """Ids of text segments by the byte-level BPE of 50,257 ids, as its file has it, special
    tokens included. Segments met before are not encoded again. They are held as Arrow
    strings and one array of ids, which takes a small part of what Python's strings and lists do."""

    def __init__(self):
        # A task has one core; threads of the tokenizer would only take others'.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.line_end = self._ids(["\n"])[0][0]
        self.known = pa.array([], pa.large_string())
        self.pool, self.sizes, self.uses = np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids``, by the tokenizer.

        Plain segments go to it as lines of one text: its pattern takes a line end after a
        visible character and before a visible one or a single blank by itself, so the ids of
        the lines are those of the segments, and the id of the line end, which no plain
        segment has, parts them.
        """
        plain = pc.match_substring_regex(segments, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.zeros(len(segments), np.int64)
        parts: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        texts = segments.take(pa.array(order)).to_pylist()
        many = int(plain.sum())
        for low in range(0, many, 64 * JOINED):
            lines = texts[low : min(low + 64 * JOINED, many)]
            joined = ["\n".join(lines[k : k + JOINED]) + "\n" for k in range(0, len(lines), JOINED)]
            ids = np.fromiter(itertools.chain.from_iterable(self._ids(joined)), "<u2")
            ends = np.flatnonzero(ids == self.line_end)
            sizes[low : low + len(lines)] = np.diff(ends, prepend=-1) - 1
            parts.append(np.delete(ids, ends))
        for low in range(many, len(texts), JOINED):
            found = self._ids(texts[low : low + JOINED])
            sizes[low : low + len(found)] = [*map(len, found)]
            parts.append(np.fromiter(itertools.chain.from_iterable(found), "<u2"))
        pool, starts = np.concatenate([np.zeros(0, "<u2"), *parts]), np.cumsum(sizes) - sizes
        back = np.argsort(order)
        return pool[spans(starts[back], sizes[back])], sizes[back]

    def ids(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments end to end, and how many each one has."""
        if len(self.known) > REMEMBERED or len(self.pool) > 8 * REMEMBERED:
            again = (self.uses > 1) & (self.sizes <= 64)
            if again.sum() > REMEMBERED // 2:
                again[:] = False
            starts = np.cumsum(self.sizes) - self.sizes
            self.pool = self.pool[spans(starts[again], self.sizes[again])]
            self.known, self.sizes, self.uses = self.known.filter(pa.array(again)), self.sizes[again], np.ones(again.sum(), np.int64)
        # Known segments come first, so that their numbers stay.
        coded = pa.concat_arrays([self.known, segments]).dictionary_encode()
        which = coded.indices.to_numpy()[len(self.known) :]
        if len(coded.dictionary) > len(self.known):
            pool, sizes = self.encoded(coded.dictionary.slice(len(self.known)))
            self.pool, self.sizes = np.concatenate([self.pool, pool]), np.concatenate([self.sizes, sizes])
            self.known = coded.dictionary
        met = np.zeros(len(self.known), np.int64)
        met[which] = 1
        self.uses = met + np.pad(self.uses, (0, len(met) - len(self.uses)))
        starts = np.cumsum(self.sizes) - self.sizes
        return self.pool[spans(starts[which], self.sizes[which])], self.sizes[which]


@functools.cache
def remembered() -> Segments:
    """The segments of this worker, which serves many tasks: the file is read once."""
    return Segments()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
MARKS = np.zeros(256, bool)
MARKS[[*b".,;:!?\n"]] = True


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes where a text can be cut without changing its ids: row starts, each single
    blank between characters that are surely no white space, and marks after ASCII letters.

    The vocabulary's pattern never joins a character to a blank after it, nor a letter to one of
    ``MARKS``, and its special token holds neither. Characters of two bytes from 0xC3 on are no white space; next to
    others beyond ASCII no cut is made, which only makes a segment longer.
    """
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = True
    two = np.zeros(256, bool)
    two[0xC3:0xE0] = True
    plain = visible[data]
    ends = plain.copy()  # bytes that end a visible character
    ends[1:] |= two[data[:-1]] & (data[1:] >= 0x80)
    begins = plain | two[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1 : len(data) - 1] = (data[1:-1] == 0x20) & ends[:-2] & begins[2:]
    cut[1:-1] |= MARKS[data[1:]] & LETTERS[data[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut)


def encoded(texts: pa.Array, known: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's begin (one entry more than texts).

    Each distinct segment goes to the tokenizer once; a text's ids are those of its segments in order.
    """
    data, offsets = flat(texts)
    if len(data) == 0:
        return np.zeros(0, "<u2"), np.zeros(len(offsets), np.int64)
    starts = segment_starts(data, offsets)
    places = np.append(starts[starts < len(data)], len(data)).astype(np.int64)
    segments = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    ids, many = known.ids(segments)
    before = np.append(0, np.cumsum(many))
    return ids, before[np.searchsorted(places[:-1], offsets)]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert-curve positions of whole-number points (rows) with ``bits`` bits each.

    The Gray-code form: undo the rotations from the highest bit down, then interleave.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    level = top
    while level > 1:
        turn = np.where((x[dims - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def curve_keys(text: pa.Array, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Place each text on the curve.

    A document's hashed word counts, projected with random signs: each word adds +1 or
    -1 by a bit of its hash in each dimension. Divided by the root of the length that is
    about normal, and its rank under the normal curve fills the cube evenly.
    """
    hashes, _, _, first, _ = words(text, LOWER)
    counts = np.diff(first)
    out = np.zeros((len(counts), dims))
    for d in range(dims):
        signs = ((hashes >> np.uint64(40 + d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.concatenate([[0], np.cumsum(signs)])
        out[:, d] = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(counts, 1))
    # The logistic curve of this slope is within 0.01 of the normal one.
    grid = np.floor((1 << bits) / (1 + np.exp(-1.702 * np.clip(out, -8, 8)))).astype(np.int64)
    return hilbert_keys(np.minimum(grid, (1 << bits) - 1), bits)


def encode(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, curve_key, doc_tokens, ids`` of every document; ids are 16 bits each."""
    schema = "doc_id bigint, curve_key bigint, doc_tokens bigint, ids binary"

    def run(batches: Batches) -> Batches:
        known = remembered()
        names = ["doc_id", "curve_key", "doc_tokens", "ids"]
        for batch in batches:
            texts = batch.column(1)
            for low, high in slices(texts, SLICE_BYTES):
                part = texts.slice(low, high - low)
                found, edges = encoded(part, known)
                ids = [found[a:b].tobytes() + b"\0\0" for a, b in zip(edges[:-1], edges[1:])]
                sizes = np.array([len(x) // 2 for x in ids], np.int64)
                arrays = [batch.column(0).slice(low, high - low), pa.array(curve_keys(part)), pa.array(sizes), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            del batch, texts, part, found, ids, arrays
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row_id", F.monotonically_increasing_id())


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens.

    Documents are laid end to end in the order of their curve keys and the line is cut
    every ``length`` tokens, so only the last sequence can need padding. Each row of
    ``docs`` is packed, repeated ones as well; a null or empty text is its closing id 0.
    """
    tokens = written(encode(docs), "tokens")
    narrow = tokens.select("row_id", "curve_key", "doc_tokens")
    placed = running_total(narrow, ["curve_key", "row_id"], "doc_tokens", "place").select("row_id", "place")

    def cut(batches: Batches) -> Batches:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            place, total = column(batch, "place"), column(batch, "doc_tokens")
            data, offsets = flat(batch.column(batch.schema.get_field_index("ids")))
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            pieces = (place + total - 1) // length - place // length + 1
            doc = np.repeat(np.arange(len(place)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[doc] // length + nth
            begin = np.maximum(sequence * length, place[doc])
            end = np.minimum((sequence + 1) * length, place[doc] + total[doc])
            start = begin - place[doc]
            crcs = np.empty(len(doc), np.int64)
            at = offsets[doc] + 2 * start
            size = end - begin
            for k in range(len(doc)):
                ids = data[at[k] : at[k] + 2 * size[k]].view("<u2") if at[k] % 2 == 0 else np.frombuffer(data[at[k] : at[k] + 2 * size[k]].tobytes(), "<u2")
                crcs[k] = zlib.crc32(ids.astype("<u4"))
            arrays = [doc_ids.take(pa.array(doc)), *map(pa.array, (start, size, crcs, total[doc], sequence, begin - sequence * length))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return tokens.select("row_id", "doc_id", "doc_tokens", "ids").join(placed, "row_id").mapInArrow(cut, SCHEMA)
