"""Toxicity by two class-conditional Kneser-Ney bigram models with shared backoff."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsward.llm.common import crc_of_id
from newsward.llm.words import BASE, LETTERS, mix, slices, words

FOLDS = 5
# The classifier is fit on at most this many labelled documents of each class, those of
# the lowest hashed id. Nothing else is sampled.
TRAIN_PER_CLASS = 4000
# Discounts of the two orders: counts up to this go to the shared backoff.
PAIR_DISCOUNT = 2.0
WORD_DISCOUNT = 1.0
# The highest score without any evidence: nothing is rejected then.
NO_EVIDENCE = 0.49
# A word whose class counts differ by less than this many standard deviations is a rare
# or neutral expression: both classes take its shared count.
SIGNIFICANT = 4.0


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(BASE) + word)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, bigram hashes (the first word of a text follows 0) and first words of rows."""
    hashes, _, _, first, _ = words(text, LETTERS)
    before = np.zeros_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1][first[:-1] < len(hashes)]] = 0
    return hashes, before, first


@dataclass
class Table:
    """Numbers by 64-bit key; a missing key has the numbers ``missing``."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray, missing: float = 0.0) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


@dataclass
class Model:
    """Log ratio of the two class models, by word and by bigram of two known words."""

    words: Table
    pairs: Table
    weights: np.ndarray

    def sums(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihood ratio and word count of each text."""
        hashes, before, first = tokens(text)
        logs = self.words.get(hashes)
        if len(self.pairs.keys):
            marked = (logs != 0) | (self.words.get(before) != 0)
            at = np.flatnonzero(marked)
            logs[at] += self.pairs.get(_pairs(before[at], hashes[at]))
        ratio = np.concatenate([[0.0], np.cumsum(logs)])
        return ratio[first[1:]] - ratio[first[:-1]], np.diff(first)

    def probability(self, text: pa.Array) -> np.ndarray:
        x = features(*self.sums(text))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def features(ratio: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the calibration sees: the ratio normalised by the root of the length, by
    which its spread by chance grows, the length, and a constant."""
    n = np.maximum(count, 1)
    return np.column_stack([ratio / np.sqrt(n), np.log(n), np.ones(len(n))])


def _spread(key: np.ndarray, before: np.ndarray, doc: np.ndarray, all_keys: np.ndarray) -> np.ndarray:
    """Continuation counts: how many distinct words each key follows, or distinct
    documents if these are fewer, so that neither copies nor long texts weigh more."""
    out = []
    for context in (before, doc):
        _, at = np.unique(_pairs(context, key), return_index=True)
        found, counts = np.unique(key[at], return_counts=True)
        total = np.zeros(len(all_keys))
        total[np.searchsorted(all_keys, found)] = counts
        out.append(total)
    return np.minimum(*out)


def _log_ratio(toxic: np.ndarray, ordinary: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the discounted class probabilities, and how far from chance it is.

    Each class keeps its count above the discount; what is discounted from both classes
    is the key's shared backoff count, dealt to the classes by their sizes.
    """
    size = np.array([max(ordinary.sum(), 1.0), max(toxic.sum(), 1.0)])
    share = size / size.sum()
    kept = [np.maximum(x - discount, 0) for x in (ordinary, toxic)]
    backoff = ordinary + toxic - kept[0] - kept[1] + discount
    logs = [np.log((k + backoff * s) / n) for k, s, n in zip(kept, share, size)]
    total = ordinary + toxic
    sigma = np.sqrt(np.maximum(total, 1) * share[0] * share[1])
    return logs[1] - logs[0], (toxic - total * share[1]) / sigma


def fit_counts(text: pa.Array, labels: np.ndarray) -> Model:
    hashes, before, first = tokens(text)
    doc = np.repeat(np.arange(len(labels), dtype=np.uint64), np.diff(first))
    toxic = np.repeat(labels, np.diff(first)) == 1
    keys = np.unique(hashes)
    counts = [_spread(hashes[m], before[m], doc[m], keys) for m in (toxic, ~toxic)]
    ratio, far = _log_ratio(*counts, WORD_DISCOUNT)
    good = np.abs(far) >= SIGNIFICANT
    word_table = Table(keys[good], ratio[good])
    # Bigrams of such a word: what the pair says beyond its words.
    marked = (word_table.get(hashes) != 0) | (word_table.get(before) != 0)
    pairs = _pairs(before, hashes)[marked]
    earlier = np.concatenate([[np.uint64(0)], before[:-1]])[marked] if len(before) else before
    pair_keys, at = np.unique(pairs, return_index=True)
    counts = [_spread(pairs[m], earlier[m], doc[marked][m], pair_keys) for m in (toxic[marked], ~toxic[marked])]
    ratio, far = _log_ratio(*counts, PAIR_DISCOUNT)
    good = np.abs(far) >= SIGNIFICANT
    word_part = word_table.get(hashes[marked][at])
    return Model(word_table, Table(pair_keys[good], (ratio - word_part)[good]), np.zeros(3))


def fit(text: pa.Array, labels: np.ndarray, prior: float) -> Model:
    """Two models on one half each; each half calibrates on what the other half says of
    it, then the counts of all rows are used."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    half = np.arange(len(labels)) % 2 == 0
    xs, ys = [], []
    for part in (half, ~half):
        model = fit_counts(text.filter(pa.array(part)), labels[part])
        xs.append(features(*model.sums(text.filter(pa.array(~part)))))
        ys.append(labels[~part])
    model = fit_counts(text, labels)
    model.weights = logistic(np.concatenate(xs), np.concatenate(ys).astype(float), prior)
    return model


def logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton steps; rows are weighted so that
    label 1 has the share ``prior``."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-2 * b
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        b -= np.linalg.solve(hessian, gradient)
    return b / scale


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_PER_CLASS) -> Model:
    """Fit on the ``most`` labelled documents of each class with the lowest hashed id,
    held-out ids excluded. Without labelled documents of both classes that tell words
    apart, every text gets the share of label 1 as its score, but less than a half."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(crc_of_id() % FOLDS != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    of_class = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    prior = of_class.get(1, 0) / max(sum(of_class.values()), 1)
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * most rows of two numbers
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    table = rows.toArrow().sort_by("doc_id")
    y = table["toxic"].to_numpy()
    if len(set(y.tolist())) == 2:
        model = fit(table["text"].combine_chunks(), y, min(max(prior, 0.01), 0.99))
        if len(model.words.keys):
            return model
    none = Table(np.zeros(0, np.uint64), np.zeros(0))
    share = min(max(prior, 1e-9), NO_EVIDENCE)
    return Model(none, none, np.array([0.0, 0.0, np.log(share / (1 - share))]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); a null text is empty."""
    probability = F.arrow_udf(lambda text: pa.array(probabilities(model, text)), "double")
    scored = docs.withColumn("score", probability(F.coalesce(F.col("text"), F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def probabilities(model: Model, text: pa.Array) -> np.ndarray:
    parts = [model.probability(text.slice(low, high - low)) for low, high in slices(text)]
    return np.concatenate(parts) if parts else np.zeros(0)
