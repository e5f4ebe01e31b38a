"""Words of many texts at once, as 64-bit hashes over one byte buffer.

Texts are laid end to end in UTF-8.  A word's hash is a polynomial over its bytes, taken from running sums, so the cost
is a few passes over the bytes and none per word.  Equal words have equal hashes everywhere; different words
agree with probability about 2**-64, and whoever needs certainty checks the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quillgraph.llm.common import mix64

#: Bytes laid end to end at a time; one longer text makes a longer piece.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Piece:
    """Some consecutive texts.  ``words`` are hashes, text i has ``words[at[i]:at[i + 1]]``, bytes ``cut[i]:cut[i + 1]``."""

    def __init__(self, first: int, texts: list[str], lower: bool = False):
        self.first, self.texts = first, texts
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        self.cut = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded])))
        self.in_word = ~_SPACE[self.bytes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], self.in_word)).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        power, unpower = _power_tables(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
            (self.bytes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        self.words = mix64((sums[self.ends] - sums[self.starts]) * unpower[self.starts]
                           + (self.ends - self.starts).astype(np.uint64))
        self.at = np.searchsorted(self.starts, self.cut)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a number per byte, by text."""
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[self.cut[1:]] - sums[self.cut[:-1]]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.at))


def pieces(texts: list[str | None], lower: bool = False) -> Iterator[Piece]:
    """Cut a list of texts into pieces of about PIECE bytes; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE:
            yield Piece(first, held, lower)
            first, held, size = i + 1, [], 0
    if held:
        yield Piece(first, held, lower)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (of all texts; runs over a border are the caller's to drop)."""
    have, out, size = hashes, None, 1
    left, at = n, 0
    while left:
        if left & 1:
            part = have[at:]
            out = part if out is None else _pair(out[:len(part)], part)
            at += size
        left >>= 1
        if left:
            have = _pair(have[:-size], have[size:]) if len(have) > size else have[:0]
            size *= 2
    return out[:max(0, len(hashes) - n + 1)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix64(a[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + b[:n])
