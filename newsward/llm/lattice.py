"""Subword lattice likelihood: a word's marginal probability over all segmentations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from newsward.llm.words import BASE, BYTE_CODES, INVERSE, mix, powers

# A word is scored as this byte, which no word holds, and its own bytes.
WORD_START = 0x20
# Words are handled this many at a time.
CHUNK = 20_000


def _hash(piece: bytes) -> int:
    with np.errstate(over="ignore"):
        codes = BYTE_CODES[np.frombuffer(piece, np.uint8)]
        return int(mix((codes * powers(BASE, len(codes))).sum(dtype=np.uint64).reshape(1))[0])


@dataclass
class Vocabulary:
    """Pieces as byte strings with the log-probabilities that weigh them, a row of them
    for each class of texts.

    Pieces are found by hash: one slot of a table much larger than the vocabulary, and
    for slots that two pieces share a sorted list.
    """

    pieces: list[bytes]
    log_p: np.ndarray

    def __post_init__(self):
        self.keys = np.array([_hash(p) for p in self.pieces], np.uint64)
        self.lengths = sorted({len(p) for p in self.pieces})
        self.slots = np.full(1 << 20, -1, np.int32)
        slot = (self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.slots[slot[::-1]] = np.arange(len(self.keys))[::-1]
        shared = np.flatnonzero(self.slots[slot] != np.arange(len(self.keys)))
        order = np.argsort(self.keys[shared])
        self.other_keys, self.other_ids = self.keys[shared][order], shared[order].astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the piece of each key, or -1."""
        ids = self.slots[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)]
        wrong = np.flatnonzero((ids >= 0) & (self.keys[ids] != keys))
        ids[wrong] = -1
        if len(wrong) and len(self.other_keys):
            at = np.minimum(np.searchsorted(self.other_keys, keys[wrong]), len(self.other_keys) - 1)
            ids[wrong] = np.where(self.other_keys[at] == keys[wrong], self.other_ids[at], -1)
        return ids


def existing_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model with its own scores as first weights.

    The scores of this kind of vocabulary are ranks, 0, -1, -2, ...; a piece of rank r
    starts with a weight proportional to 1 / (r + 10), as frequencies fall with rank. Byte
    pieces make every word spellable.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            weights.setdefault(bytes([int(piece[3:5], 16)]), 1e-7)
            continue
        raw = piece.replace("▁", " ").encode()
        if b" " in raw[1:]:
            continue  # spans words
        weight = 1 / (10 - model.get_score(i))
        weights[raw] = max(weights.get(raw, 0.0), weight)
    pieces = sorted(weights)
    p = np.array([weights[x] for x in pieces])
    return Vocabulary(pieces, np.log(p / p.sum())[None, :])


def _prepared(blob: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Prefix hashes of words of one size, a row per position."""
    raw = np.empty((size + 1, len(starts)), np.uint8)
    raw[0] = WORD_START
    for k in range(size):
        raw[k + 1] = blob[starts + k]
    sums = np.zeros((size + 2, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[raw] * powers(BASE, size + 1)[:, None], axis=0, out=sums[1:])
    return sums


def _arcs(vocabulary: Vocabulary, sums: np.ndarray):
    """For each end position: the lengths of possible pieces and their numbers by word."""
    back = powers(INVERSE, len(sums))
    out = []
    for end in range(1, len(sums)):
        arcs = []
        for length in vocabulary.lengths:
            if length > end:
                break
            with np.errstate(over="ignore"):
                ids = vocabulary.find(mix((sums[end] - sums[end - length]) * back[end - length]))
            if (ids >= 0).any():
                arcs.append((length, ids))
        out.append(arcs)
    return out


def _forward(log_p: np.ndarray, arcs, words: int) -> np.ndarray:
    log_p = np.append(log_p, -np.inf)
    alpha = np.full((len(arcs) + 1, words), -np.inf)
    alpha[0] = 0
    for end, found in enumerate(arcs, 1):
        terms = np.array([alpha[end - length] + log_p[ids] for length, ids in found])
        top = terms.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            alpha[end] = safe + np.log(np.exp(terms - safe).sum(0))
    return alpha


def _groups(blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cuts):
        if len(same):
            size = int(sizes[same[0]])
            step = max(1, min(CHUNK, (CHUNK * 16) // (size + 1)))
            for at in range(0, len(same), step):
                yield same[at : at + step], size


def log_marginals(vocabulary: Vocabulary, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each class, summed over all its
    segmentations."""
    out = np.empty((len(vocabulary.log_p), len(starts)))
    for chosen, size in _groups(blob, starts, sizes):
        arcs = _arcs(vocabulary, _prepared(blob, starts[chosen], size))
        for k, log_p in enumerate(vocabulary.log_p):
            out[k, chosen] = _forward(log_p, arcs, len(chosen))[-1]
    return out


def expected_counts(vocabulary: Vocabulary, k: int, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often class ``k`` uses each piece over all words, each segmentation counted
    by its posterior probability (forward-backward)."""
    total = np.zeros(len(vocabulary.pieces))
    log_p = np.append(vocabulary.log_p[k], -np.inf)
    for chosen, size in _groups(blob, starts, sizes):
        arcs = _arcs(vocabulary, _prepared(blob, starts[chosen], size))
        alpha = _forward(vocabulary.log_p[k], arcs, len(chosen))
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        for end in range(len(arcs), 0, -1):
            for length, ids in arcs[end - 1]:
                through = log_p[ids] + beta[end]
                beta[end - length] = np.logaddexp(beta[end - length], through)
                share = np.exp(alpha[end - length] + through - alpha[-1])
                some = np.flatnonzero(share > 0)
                total += np.bincount(ids[some], share[some], len(total))
    return total
