"""Scoring texts by a subword lattice model learned from the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm import lattice
from newsward.llm.common import Batches, crc_of_id, written
from newsward.llm.words import LOWER, slices, words

FOLDS, HELD_OUT = 7, 2
# Text per block of documents and per bucket of words: bounds the memory of a task.
BLOCK_BYTES = 8 << 20
DISCOUNT = 0.75
EM_ROUNDS = 3
# Text classes (such as languages) with counts of their own; the rest share the last one.
CLASSES = 6

PACKETS = "kind bigint, block bigint, bucket bigint, hashes binary, counts binary, sizes binary, blob binary"
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)
DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("class", pa.int64())])


def _wide(raw: bytes) -> np.ndarray:
    """Numbers behind a byte that says how many bytes each takes."""
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _word_blob(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the chosen words, one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return data[at + np.repeat(starts - (ends - sizes), sizes)]


def _unique(texts: pa.Array):
    hashes, starts, ends, first, data = words(texts, LOWER)
    keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, at, inverse, starts, ends, first, data


def packets(docs: DataFrame, buckets: int, classes: int) -> DataFrame:
    """Blocks of documents, and the distinct words of each block in buckets by hash.

    A task cuts its documents into blocks of bounded size and compresses each. The table
    is written, which fixes the blocks for all later steps.
    """
    names = [part.split()[0] for part in PACKETS.split(", ")]

    def run(batches: Batches) -> Batches:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in slices(batch.column(2), BLOCK_BYTES):
                part = pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in batch.columns], schema=DOCS)
                texts, held_out = part.column(2), part.column(1).to_numpy(zero_copy_only=False)
                keys, at, inverse, starts, ends, first, data = _unique(texts)
                # Counts by class; held-out texts fall into one more class, which is left out.
                kind = np.where(held_out, classes, part.column(3).to_numpy())
                place_of = np.repeat(kind, np.diff(first)) * len(keys) + inverse
                counts = np.bincount(place_of, minlength=(classes + 1) * len(keys)).reshape(classes + 1, len(keys))[:classes].astype("<u4")
                sizes = ends[at] - starts[at]
                rows = [(0, block, 0, b"", b"", b"", _squeeze(_ipc(part)))]
                place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    k = slice(cuts[b], cuts[b + 1])
                    blob = _word_blob(data, starts[at[k]], sizes[k])
                    rows.append((1, block, int(b), keys[k].tobytes(), _squeeze(counts[:, k].tobytes()), _squeeze(sizes[k].astype("<u4").tobytes()), _squeeze(blob.tobytes())))
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)

    return docs.select("doc_id", "held_out", "text", "class").mapInArrow(run, PACKETS)


def _merged(table: pa.Table, classes: int):
    """The distinct words of a bucket over all blocks, with their counts by class and bytes."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    counts = np.concatenate([np.frombuffer(_expand(x), "<u4").reshape(classes, -1) for x in table["counts"].to_pylist()], axis=1)
    sizes = np.concatenate([np.frombuffer(_expand(x), "<u4") for x in table["sizes"].to_pylist()]).astype(np.int64)
    blob = np.frombuffer(b"".join(_expand(x) for x in table["blob"].to_pylist()), np.uint8)
    keys, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.array([np.bincount(inverse, c, len(keys)) for c in counts]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    return total, blob, starts[at], sizes[at], inverse, hashes


LEARNED = pa.schema([("tokens", pa.list_(pa.int64())), ("types", pa.list_(pa.int64())), ("seen", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary())])


def learned_words(words_: DataFrame, classes: int) -> DataFrame:
    """The training words of each bucket, once each, and their tokens and types by
    class, with the types of all classes together at the end."""

    def run(table: pa.Table) -> pa.Table:
        total, blob, starts, sizes, _, _ = _merged(table, classes)
        known = total.sum(0) > 0
        row = {
            "tokens": total.sum(1).tolist(), "types": [*(total > 0).sum(1).tolist(), int(known.sum())],
            "seen": np.packbits(total[:, known] > 0, axis=1).tobytes(), "sizes": sizes[known].astype("<u4").tobytes(), "blob": _word_blob(blob, starts[known], sizes[known]).tobytes(),
        }
        return pa.Table.from_pylist([row], schema=LEARNED)

    return words_.groupBy("bucket").applyInArrow(run, "tokens array<bigint>, types array<bigint>, seen binary, sizes binary, blob binary")


def reestimated(vocabulary: lattice.Vocabulary, learned: DataFrame) -> lattice.Vocabulary:
    """One round of expectation-maximisation over the distinct training words of each
    class. Every task sums its own expected counts, one number per piece and class."""
    classes, pieces = vocabulary.log_p.shape

    def run(batches: Batches) -> Batches:
        total = np.zeros((classes, pieces))
        for batch in batches:
            for seen, sizes, blob in zip(*[c.to_pylist() for c in batch.columns]):
                size, data = np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(blob, np.uint8)
                start = np.cumsum(size) - size
                own = np.unpackbits(np.frombuffer(seen, np.uint8).reshape(classes, -1), axis=1, count=len(size)) > 0
                for k in range(classes):
                    total[k] += lattice.expected_counts(vocabulary, k, data, start[own[k]], size[own[k]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["piece", "uses"])

    uses = learned.select("seen", "sizes", "blob").mapInArrow(run, "piece bigint, uses double")
    table = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # at most one row per piece and class
    found = np.zeros(classes * pieces)
    found[table["piece"].to_numpy()] = table["uses"].to_numpy()
    found = found.reshape(classes, pieces)
    # A little of the first weights and of all classes together keeps every piece possible.
    p = 0.01 * np.exp(vocabulary.log_p) + 0.04 * found.sum(0) / max(found.sum(), 1e-9)
    p += 0.95 * found / np.maximum(found.sum(1), 1e-9)[:, None]
    return lattice.Vocabulary(vocabulary.pieces, np.log(p / p.sum(1)[:, None]))


def score_texts(docs: DataFrame, vocabulary: lattice.Vocabulary, held_out=None, group: str | None = None) -> DataFrame:
    """Score all rows of ``docs(doc_id, text)``; rows for which ``held_out`` is true
    (by default, ids with crc32 mod 7 of 2) are not learned from.

    The model draws a class of texts, then words and an end. A word comes from the
    discounted counts of its class, backed off to those of all classes, backed off to
    pieces: all segmentations of the word into pieces of the vocabulary, weighed by piece
    probabilities, summed by a forward recursion in log space. Piece probabilities start
    from the vocabulary's scores and are re-estimated on all distinct training words. The
    classes are the most frequent values of ``group`` in the training rows; a text is
    scored by the sum over all classes, whatever its own value.

    A null text is empty and is scored as the end alone; repeated rows are scored alike;
    without training rows only pieces count. A null id is not held out.

    The word counts of the corpus are never in one place: each block of documents
    sends its distinct words to buckets by hash, the buckets sum them, and each block
    gets the counts and lattice scores of its own words back.
    """
    flag = F.coalesce(crc_of_id() % FOLDS == HELD_OUT if held_out is None else held_out, F.lit(False))
    kind = F.col(group).cast("string") if group else F.lit("")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), flag.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"))
    frequent = docs.where("not held_out and kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(CLASSES - 1)
    names_of = [row["kind"] for row in frequent.collect()]
    listed = F.coalesce(F.col("kind").isin(names_of), F.lit(False))
    # Rows of other values need a class of their own only if there are any to learn from.
    others = not names_of or bool(docs.where("not held_out").where(~listed).select("doc_id").take(1))
    number = F.lit(len(names_of) if others else 0)
    for i, name in enumerate(names_of):
        number = F.when(F.col("kind") == name, i).otherwise(number)
    classes = len(names_of) + others
    docs = docs.withColumn("class", number.cast("bigint"))
    size_of = docs.groupBy("class").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.expr("int(not held_out)")).alias("train")).collect()
    train = np.zeros(classes, np.int64)
    train[[row["class"] for row in size_of]] = [row["train"] for row in size_of]
    buckets = max(1, -(-sum(row["bytes"] for row in size_of) // BLOCK_BYTES))
    parts = written(packets(docs, buckets, classes), "packets")
    words_, blocks = parts.where("kind = 1"), parts.where("kind = 0")
    learned = written(learned_words(words_, classes), "learned")
    sums = learned.agg(*[F.sum(F.col("tokens")[k]) for k in range(classes)], *[F.sum(F.col("types")[k]) for k in range(classes + 1)]).first()
    tokens_of = np.array([x or 0 for x in sums[:classes]], float)
    types_of = np.array([x or 0 for x in sums[classes : 2 * classes]], float)
    word_types, train_docs = int(sums[2 * classes] or 0), int(train.sum())
    vocabulary = lattice.Vocabulary(vocabulary.pieces, np.repeat(vocabulary.log_p[:1], classes, axis=0))
    for _ in range(EM_ROUNDS if word_types else 0):
        vocabulary = reestimated(vocabulary, learned)
    all_tokens, all_types = int(tokens_of.sum()) + train_docs, word_types + (train_docs > 0)
    log_base = np.log10(all_tokens + all_types + 1)
    p_end = (train + 1) / (tokens_of + train + 2)
    log_class = np.log((train + 1) / (train + 1).sum())

    def look_up(table: pa.Table) -> pa.Table:
        total, blob, starts, sizes, inverse, hashes = _merged(table, classes)
        logs = lattice.log_marginals(vocabulary, blob, starts, sizes).astype("<f4")
        parts = np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])
        # Counts over the whole corpus may pass 32 bits; the first byte says how wide they are.
        width = 4 if total.max(initial=0) < 1 << 32 else 8
        counts = [_squeeze(bytes([width]) + total[:, i].astype(f"<u{width}").tobytes()) for i in parts]
        rows = [table["block"], table["bucket"], pa.array(counts), pa.array([_squeeze(logs[:, i].tobytes()) for i in parts])]
        return pa.Table.from_arrays(rows, names=["block", "bucket", "counts", "logs"])

    found = words_.groupBy("bucket").applyInArrow(look_up, "block bigint, bucket bigint, counts binary, logs binary")
    names = [part.split()[0] for part in SCORES.split(", ")]

    def class_logs(counts: np.ndarray, log_pieces: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word in each class."""
        with np.errstate(divide="ignore"):
            shared = np.log(np.maximum(counts.sum(0) - DISCOUNT, 0)) - np.log(tokens_of.sum() + 1)
            own = np.log(np.maximum(counts - DISCOUNT, 0))
        new = np.log(DISCOUNT * word_types + 1) - np.log(tokens_of.sum() + 1) + log_pieces
        backoff = np.logaddexp(shared, new)
        own = np.logaddexp(own, np.log(DISCOUNT * types_of + 1)[:, None] + backoff)
        return own - np.log(tokens_of + 1)[:, None] + np.log1p(-p_end)[:, None]

    def score_block(docs_: pa.Table, words__: pa.Table) -> pa.Table:
        out = []
        words__ = words__.sort_by("bucket")
        counts = np.concatenate([np.zeros((classes, 0), "<u4"), *[_wide(_expand(x)).reshape(classes, -1) for x in words__["counts"].to_pylist()]], axis=1).astype(np.int64)
        pieces = np.concatenate([np.zeros((classes, 0), "<f4"), *[np.frombuffer(_expand(x), "<f4").reshape(classes, -1) for x in words__["logs"].to_pylist()]], axis=1).astype(float)
        logs, totals = class_logs(counts, pieces), counts.sum(0)
        for packed in docs_["blob"].to_pylist():
            batch = pa.ipc.open_stream(_expand(packed)).read_next_batch()
            # Buckets follow the order of hashes, so the words come back in their order.
            _, _, inverse, _, _, first, _ = _unique(batch.column(2))

            def summed(values: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(values[inverse])])
                return total[first[1:]] - total[first[:-1]]

            n = np.diff(first) + 1
            base = summed(np.log10(totals + 1.0)) + np.log10(train_docs + 1.0) - n * log_base
            known = summed((totals > 0).astype(np.int64)) + (train_docs > 0)
            by_class = np.array([summed(logs[k]) + log_class[k] + np.log(p_end[k]) for k in range(classes)])
            score = np.logaddexp.reduce(by_class, axis=0) / np.log(10)
            out.append(pa.Table.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, known, np.full(len(n), all_tokens), base, score))], names=names))
        return pa.concat_tables(out)

    return blocks.select("block", "blob").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score_block, SCORES)
