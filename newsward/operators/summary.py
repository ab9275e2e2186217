"""Extractive summaries: the sentences most similar to the rest of their document.

The similarity of two sentences is the cosine of their vectors. No pair is ever
built: with unit vectors u, the sum over all other sentences of x_j * cos(i, j) is
u_i . (sum of x_j u_j) - x_i (u_i . u_i), so one vector sum per document replaces
its n x n matrix exactly and the work grows with n.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsward.functions.text import sentences
from newsward.lexicons import STOP_WORDS
from newsward.operators.boundaries import Boundaries, split_learned
from newsward.operators.skew import dimension_join
from newsward.session import stage

# The usual damping of the ranking, and the length of a summary.
DAMPING = 0.85
# The rounds end when the scores change by less than this per sentence, or after so many.
TOLERANCE = 1e-6
ROUNDS = 100
SUMMARY_SENTENCES = 5
# Characters of the documents that share a dictionary in one task: the more, the fewer copies of vectors
# move. The sentences that it takes at a time, and those of an Arrow batch that it returns.
LOT_CHARS = 128 << 20
PIECE = 32768
SENTENCES = 4096


def by_document(documents: DataFrame) -> DataFrame:
    """The texts by document. None moves here: what follows gathers a document's sentences
    where it needs them, once, and another shuffle of the texts before would only fill disks."""
    return documents.select("doc_id", "text")


def split_sentences(documents: DataFrame, learned: Boundaries | None = None) -> DataFrame:
    """(doc_id, pos, sentence) in text order; by the plain rule of marks and white space,
    or by boundaries learned from a corpus."""
    if learned is not None:
        return split_learned(documents, learned)
    return documents.select(
        "doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")
    )


# Executors get this module's functions by value and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# All that is not a plain letter separates words.
BETWEEN_WORDS = "[^a-zA-Z]+"


def _dropped(stop_words: list[str] | None) -> list[str]:
    return ["", *(STOP_WORDS if stop_words is None else stop_words)]


def clean_words(sentence: Column, stop_words: list[str] | None = None) -> Column:
    lower = F.transform(F.split(sentence, BETWEEN_WORDS), F.lower)
    return F.filter(lower, lambda w: ~w.isin(_dropped(stop_words)))


def clean_sentence(sentence: Column, stop_words: list[str] | None = None) -> Column:
    """Lower case words without stop words; repeated words stay."""
    return F.array_join(clean_words(sentence, stop_words), " ")


def _dictionary(known: list[pa.RecordBatch], dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, how many rows each has, and their summed vectors after a row of zeros.
    ``known`` is emptied on the way, so that its vectors are not held twice."""
    if not known:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros((1, dim))
    words = pa.chunked_array([batch.column("word") for batch in known]).combine_chunks().dictionary_encode()
    codes, single = words.indices.to_numpy(), len(words.dictionary) == len(words)
    kind = known[0].schema.field("embedding").type.value_type
    table = np.zeros((len(words.dictionary) + 1, dim), np.float32 if single and kind == pa.float32() else np.float64)
    known.reverse()
    at = 0
    while known:
        vectors = known.pop().column("embedding")
        if (pc.list_value_length(vectors).drop_null().to_numpy() != dim).any():
            raise ValueError(f"a word vector has fewer than {dim} numbers")
        own = codes[at : at + len(vectors)][vectors.is_valid().to_numpy(zero_copy_only=False)] + 1
        flat = pc.fill_null(vectors.flatten().cast(pa.from_numpy_dtype(table.dtype)), 0.0).to_numpy()
        np.add.at(table, own, flat.reshape(-1, dim))
        at += len(vectors)
    return words.dictionary, np.bincount(codes, minlength=len(words.dictionary)), table


def _sentence_starts(split: pa.Table) -> np.ndarray:
    """The first row of each sentence of sorted rows: those that share doc_id and pos are one."""
    codes = split.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    pos = split.column("pos").combine_chunks().fill_null(-1).to_numpy()
    return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (pos[1:] != pos[:-1])])


def _piece_vectors(
    split: pa.Table, first: np.ndarray, known: tuple, dropped: list[str], sentences: bool
) -> Iterator[pa.RecordBatch]:
    """The vectors of whole sentences, whose first rows are ``first``."""
    words, times, table = known
    dim = table.shape[1]
    apart = pc.replace_substring_regex(split.column("sentence").combine_chunks(), BETWEEN_WORDS, " ")
    lists = pc.split_pattern(pc.ascii_lower(apart), " ")
    starts = lists.offsets.to_numpy()[first]
    flat = lists.flatten()
    place = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy() + 1
    stopped = pc.is_in(flat, value_set=pa.array(dropped, flat.type)).to_numpy(zero_copy_only=False)
    counted = np.where(place > 0, np.r_[0, times][place], ~stopped)
    n_words = np.add.reduceat(counted, starts).astype(np.int64)
    ends = np.r_[starts[1:], len(flat)]
    for k in range(0, len(first), SENTENCES):
        some = slice(k, k + SENTENCES)
        sums = np.add.reduceat(table[place[starts[k] : ends[some][-1]]], starts[some] - starts[k], axis=0, dtype=np.float64)
        vector = (sums / (n_words[some] + 0.001)[:, None]).ravel()
        offsets = np.arange(len(sums) + 1, dtype=np.int32) * dim
        own = split.select(["doc_id", "pos"]).take(pa.array(first[some])).combine_chunks()
        own = own.append_column("n_words", pa.array(n_words[some]))
        own = own.append_column("vector", pa.ListArray.from_arrays(offsets, vector))
        if sentences:
            edges = np.r_[first, split.num_rows][k : k + len(sums) + 1]
            texts = split.column("sentence").slice(edges[0], edges[-1] - edges[0]).combine_chunks()
            own = own.append_column("sentences", pa.ListArray.from_arrays((edges - edges[0]).astype(np.int32), texts))
        yield from own.to_batches()


def sentence_vectors(
    split: DataFrame, vectors: DataFrame, dim: int, stop_words: list[str] | None = None, sentences: bool = False
) -> DataFrame:
    """(doc_id, pos, n_words, vector): word vectors summed over n_words + 0.001.

    ``vectors`` is (word, embedding). An unknown word adds nothing, an empty sentence
    has a vector of zeros. Documents are dealt to lots, one to a partition, and a lot gets each of its distinct
    words' vectors once, from a join on the word, whatever the size of the dictionary. Its words come
    first, then its sentences in order, which a task takes piece by piece; the sentences are
    shuffled only once. A document's rows follow one another within a partition. With ``sentences``
    those of a row, which share doc_id and pos, come as a list beside its vector.
    """
    dropped = _dropped(stop_words)
    (chars,) = split.agg(F.sum(F.length("sentence"))).first()
    lots = max(split.sparkSession.sparkContext.defaultParallelism, (chars or 0) // LOT_CHARS)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(lots)).cast("int").alias("lot")
    own = split.where("sentence IS NOT NULL").select(lot, F.lit(1).alias("kind"), "doc_id", "pos", "sentence")
    raw = own.select("lot", F.explode(F.split("sentence", BETWEEN_WORDS)).alias("raw"))
    words = raw.select("lot", F.lower("raw").alias("word")).where(~F.col("word").isin(dropped))
    # The lots of a word as bits, 64 to a row, which are joined within the tasks that read the texts.
    lots_of = words.groupBy("word", F.shiftright("lot", 6).alias("some")).agg(
        F.bit_or(F.expr("shiftleft(1L, lot & 63)")).alias("mask")
    )
    own_vectors = vectors.select("word", F.slice("embedding", 1, dim).alias("embedding"))
    met = dimension_join(stage(lots_of), own_vectors, "word", "inner", ["some"], row_bytes=4 * dim + 100)
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda bit: F.getbit("mask", bit) == 1)
    known = met.select("some", F.explode(places).alias("bit"), "word", "embedding")
    known = known.select((F.col("some") * 64 + F.col("bit")).alias("lot"), F.lit(0).alias("kind"), "word", "embedding")
    rows = known.unionByName(own, allowMissingColumns=True).repartitionById(lots, "lot")
    dealt = rows.sortWithinPartitions("kind", "doc_id", "pos").select("kind", "word", "embedding", "doc_id", "pos", "sentence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dictionary, held, count = [], None, [], 0
        for batch in batches:
            cut = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if cut:
                known.append(batch.select(["word", "embedding"]).slice(0, cut))
            if cut == batch.num_rows:
                continue
            if dictionary is None:
                dictionary = _dictionary(known, dim)
            held.append(batch.select(["doc_id", "pos", "sentence"]).slice(cut))
            count += batch.num_rows - cut
            if count >= PIECE:
                piece = pa.Table.from_batches(held).combine_chunks()
                first = _sentence_starts(piece)
                # The last sentence may go on in the next batch.
                if len(first) > 1:
                    yield from _piece_vectors(piece.slice(0, first[-1]).combine_chunks(), first[:-1], dictionary, dropped, sentences)
                held = piece.slice(first[-1]).to_batches()
                count = piece.num_rows - int(first[-1])
        if held:
            piece = pa.Table.from_batches(held).combine_chunks()
            yield from _piece_vectors(piece, _sentence_starts(piece), dictionary, dropped, sentences)

    key, place = (split.schema[name].dataType.simpleString() for name in ("doc_id", "pos"))
    schema = f"doc_id {key}, pos {place}, n_words bigint, vector array<double>{', sentences array<string>' if sentences else ''}"
    return dealt.mapInArrow(run, schema)


def dot(a: str, b: str, dim: int) -> Column:
    """The inner product of two array columns, spelled out to run as generated code."""
    return F.expr(" + ".join(f"{a}[{k}] * {b}[{k}]" for k in range(dim)))


def cosine(a: str, b: str, dim: int) -> Column:
    """The similarity of two sentence vectors; 0 if either is all zeros."""
    norms = F.sqrt(dot(a, a, dim)) * F.sqrt(dot(b, b, dim))
    return F.when(norms > 0, dot(a, b, dim) / norms).otherwise(0.0)


def _matrix(document: pa.Table) -> np.ndarray:
    flat = document.column("vector").combine_chunks().flatten().to_numpy()
    return flat.reshape(document.num_rows, -1).astype(float)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each document, whose rows follow one another, maybe over several batches."""
    kept, key = [], None
    for batch in batches:
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(codes)]
        for first, last in zip(cuts, cuts[1:] if len(codes) else []):
            own = batch.column(0)[int(first)].as_py()
            if kept and own != key:
                yield pa.Table.from_batches(kept)
                kept = []
            key = own
            kept.append(batch.slice(first, last - first))
    if kept:
        yield pa.Table.from_batches(kept)


def _per_document(
    vectors: DataFrame, name: str, score: Callable[[np.ndarray], np.ndarray], together: bool, best: int | None = None
) -> DataFrame:
    """(doc_id, pos, ``name``) from a function of the vectors of one document; with ``best`` only that many
    rows of a document at most, the first by the order of ``top_sentences``, and their ``sentences``.

    ``together``: a document's rows follow one another within a partition, as ``sentence_vectors``
    leaves them, so that no vector moves; else they are grouped by a shuffle.
    """

    columns = ["doc_id", "pos"] if best is None else ["doc_id", "pos", "sentences"]

    def scored(document: pa.Table) -> pa.Table:
        values = score(_matrix(document))
        made = document.select(columns).append_column(name, pa.array(values))
        if best is None or len(values) <= best:
            return made
        some = np.flatnonzero(values >= np.partition(values, len(values) - best)[len(values) - best])
        if len(some) > best:
            ties = made.select(["sentences", "pos"]).take(pa.array(some)).to_pydict()
            # A row with several sentences counts by its greatest; strings in the order of their bytes.
            order = [(values[k], max(x.encode() for x in own), -1 if pos is None else pos, k) for k, own, pos in zip(some, ties["sentences"], ties["pos"])]
            some = np.sort([k for *_, k in sorted(order)[-best:]])
        return made.take(pa.array(some))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, rows = [], 0
        for document in _documents(batches):
            gathered.append(scored(document))
            rows += document.num_rows
            if rows >= SENTENCES:
                yield from pa.concat_tables(gathered).combine_chunks().to_batches()
                gathered, rows = [], 0
        if gathered:
            yield from pa.concat_tables(gathered).combine_chunks().to_batches()

    key, place = (vectors.schema[column].dataType.simpleString() for column in ("doc_id", "pos"))
    schema = f"doc_id {key}, pos {place}, {'' if best is None else 'sentences array<string>, '}{name} double"
    rows = vectors.select(*columns, "vector")
    return rows.mapInArrow(over, schema) if together else rows.groupBy("doc_id").applyInArrow(scored, schema)


def similarity_weight(vectors: DataFrame, dim: int, together: bool = False) -> DataFrame:
    """(doc_id, pos, weight): the summed similarity to all other sentences of the document.
    ``together`` as with ``sentence_rank``."""
    return _per_document(vectors.select("doc_id", "pos", F.slice("vector", 1, dim).alias("vector")), "weight", lambda matrix: _units(matrix)[2], together)


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, which of them are not all zeros, and each one's summed similarity to the others."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    own = norms[:, 0] > 0
    return u, own, u @ u.sum(axis=0) - own


def rank_by_rounds(vectors: np.ndarray, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> np.ndarray:
    """Weighted PageRank over the similarities of one document's sentences, round by round.

    Every sentence hands its score on, shared by similarity, damped by ``DAMPING``; one
    without similarity to any other shares evenly. A round needs one vector sum, not the matrix of similarities.
    The rounds end by the usual rule: when all scores together change by less than ``tolerance`` per sentence.
    Where negative similarities keep ``rounds`` rounds from that, all sentences of the document score alike.
    """
    n = len(vectors)
    u, own, weight = _units(vectors)
    linked = np.abs(weight) > 1e-9
    scores = np.full(n, 1 / n)
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(rounds):
            share = np.divide(scores, weight, out=np.zeros(n), where=linked)
            passed = u @ (u.T @ share) - own * share + scores[~linked].sum() / n
            new = DAMPING * passed + (1 - DAMPING) / n
            change = np.abs(new - scores).sum()
            scores = new
            if change < n * tolerance:
                return scores
    return np.full(n, 1 / n)


def rank_scores(vectors: np.ndarray) -> np.ndarray:
    """The scores that the rounds converge to, solved for directly.

    With unit vectors u, weights w and scores x = w * y, the stationary scores obey
    (w + d) y = d u.z + c with z = sum of y u, so one small system in the vector
    dimension gives z and with it all scores, in time linear in the number of sentences:
    what the usual rounds converge to where similarities are not negative. A sentence
    without similarity to any other shares its score evenly. Where negative similarities
    leave no finite solution, all sentences of the document score alike.
    """
    n = len(vectors)
    u, _, weight = _units(vectors)
    linked = np.abs(weight) > 1e-9
    constant = (1 - DAMPING) / (n - DAMPING * np.count_nonzero(~linked))
    scores = np.full(n, constant)
    if linked.any():
        v, w = u[linked], weight[linked]
        if np.abs(w + DAMPING).min() < 1e-9:
            return np.full(n, 1 / n)
        scaled = v / (w + DAMPING)[:, None]
        system = np.eye(v.shape[1]) - DAMPING * (v.T @ scaled)
        try:
            z = np.linalg.solve(system, constant * scaled.sum(axis=0))
        except np.linalg.LinAlgError:
            return np.full(n, 1 / n)
        scores[linked] = w * (DAMPING * (v @ z) + constant) / (w + DAMPING)
    return scores if np.isfinite(scores).all() else np.full(n, 1 / n)


def sentence_rank(
    vectors: DataFrame, method: str = "rounds", together: bool = False, best: int | None = None
) -> DataFrame:
    """(doc_id, pos, score), by ``rounds`` with their stop rule or by ``solve``. One group is
    the sentences of one document, whose text was one cell of one row before; either way the work is
    linear in their number. Scores are given to 12 decimals, so that sentences that score alike tie.
    ``together``: the rows come as ``sentence_vectors`` leaves them, and none moves. ``best``:
    only the rows that so many best sentences of a document can be in, with their ``sentences``."""
    ranking = {"rounds": rank_by_rounds, "solve": rank_scores}[method]
    return _per_document(vectors, "score", lambda matrix: np.round(ranking(matrix), 12), together, best)


def top_sentences(ranked: DataFrame, k: int = SUMMARY_SENTENCES) -> DataFrame:
    """The ``k`` best sentences of each document by (score, sentence), best first."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("sentence"), F.desc("pos"))
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def summaries(split: DataFrame, scores: DataFrame, k: int = SUMMARY_SENTENCES) -> DataFrame:
    """(doc_id, summary): the best sentences, each with a leading blank."""
    return _joined(top_sentences(split.join(scores, ["doc_id", "pos"]), k))


def _joined(top: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sentence")))
    text = F.array_join(F.transform(ordered, lambda r: F.concat(F.lit(" "), r["sentence"])), "")
    return top.groupBy("doc_id").agg(text.alias("summary"))


def summarize(
    documents: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int = SUMMARY_SENTENCES,
    stop_words: list[str] | None = None,
    learned: Boundaries | None = None,
) -> DataFrame:
    """(doc_id, summary) from whole texts."""
    split = split_sentences(by_document(documents), learned)
    made = sentence_vectors(split, vectors, dim, stop_words, sentences=True)
    # The sentences stay beside their vectors: only a document's best ones leave the task that scores it.
    best = sentence_rank(made, together=True, best=k).where("doc_id IS NOT NULL AND pos IS NOT NULL")
    return _joined(top_sentences(best.select("doc_id", "pos", "score", F.explode("sentences").alias("sentence")), k))
