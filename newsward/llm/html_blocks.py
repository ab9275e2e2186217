"""Blocks of HTML pages: leaf texts with the tags and attributes above them."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from newsward.llm.words import LOWER, words

# Comments and hidden elements are one token each, scanned from left to right.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>script|style|template|noscript|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
# Elements inside a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag that ends an open element of these.
CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
PATH_SLOTS, WORD_SLOTS, NUMBERS = 128, 16, 6
WIDTH = PATH_SLOTS + WORD_SLOTS + NUMBERS


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_share: float


def blocks(source: str) -> list[Block]:
    """Non-empty blocks in page order. Character references are decoded, white space
    inside a block is one space, and ends are trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    pieces: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, path, min(1.0, linked / len(raw))))
            pieces.clear()
        linked = 0

    for token in TOKEN.finditer(source):
        text = token["text"]
        if text is not None:
            pieces.append(text)
            linked += len(text) if links else 0
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(token["close"])
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        links = 0
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag not in VOID:
            ends = CLOSES.get(tag, ())
            while stack and stack[-1][0] in ends:
                stack.pop()
            rest = token["rest"]
            names = ("<" + tag,)
            if "=" in rest:
                for found in NAMES.findall(rest):
                    names += tuple(PARTS.findall("".join(found).lower()))
            stack.append((tag, names))
        path = tuple(name for _, own in stack for name in own)
    flush()
    return out


def _slot(name: str, slots: int) -> tuple[int, float]:
    code = zlib.crc32(name.encode())
    return code % slots, 1.0 if code >> 31 else -1.0


def features(rows: list[Block]) -> np.ndarray:
    """A vector per block: hashed tag path, hashed words, and a few numbers."""
    out = np.zeros((len(rows), WIDTH), np.float32)
    known: dict[str, tuple[int, float]] = {}
    for k, block in enumerate(rows):
        for depth, name in enumerate(reversed(block.path)):
            if name not in known:
                known[name] = _slot(name, PATH_SLOTS)
            slot, sign = known[name]
            out[k, slot] += sign
    hashes, _, _, first, _ = words(pa.array([b.text for b in rows], pa.string()), LOWER)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(rows)), counts)
    slot = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(row * WORD_SLOTS + slot, sign, len(rows) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    out[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.clip(bag / np.sqrt(np.maximum(counts, 1))[:, None], -2, 2)
    sizes = np.array([len(b.text) for b in rows], float)
    out[:, -6] = np.log1p(sizes) / 5
    out[:, -5] = np.log1p(counts) / 5
    out[:, -4] = [b.link_share for b in rows]
    out[:, -3] = [sum(map(b.text.count, ".,!?")) / len(b.text) * 10 for b in rows]
    out[:, -2] = [len(b.path) / 10 for b in rows]
    out[:, -1] = [b.text[-1] in ".!?" for b in rows]
    return out
