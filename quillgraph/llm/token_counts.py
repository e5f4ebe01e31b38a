"""Exact token counts of every prefix of a text, by dynamic programming over a sentencepiece BPE vocabulary.

A sequence of pieces is what the merges produce exactly when every two neighbours are (the merges of the two texts
together give just these two pieces).  So the last piece of a prefix is the one suffix of it that is in the vocabulary and
goes with the last piece of the shorter prefix before it, and

    count[i] = count[i - len(piece)] + 1        (or the number of bytes, for a character outside the vocabulary)

One pass from left to right gives the count of every prefix, in time proportional to the length.  The counts then answer
how many tokens a cut text has, and where to cut it to stay within a budget, without encoding again.

No piece of the vocabulary continues behind a space mark, so a text falls into words (space marks, then other
characters) whose counts add up; a word's counts are computed once and kept in a bounded memo.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.common import map_rows
from quillgraph.llm.piece_model import model_bytes

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"


def merged(score: dict[str, float], text: str) -> list[str]:
    """Pieces of a short text by the merges themselves: best score first, leftmost among equals."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Pairs(dict):
    """(left, right) -> whether the merges of both texts together end with just these two pieces; a bounded memo."""

    def __init__(self, score: dict[str, float], limit: int):
        super().__init__()
        import sentencepiece
        # the same merges without marks or changes of the text
        self.score, self.limit, self.letters = score, limit, set("".join(score))
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(score))
        self.id = {p: i for i, p in enumerate(score)}

    def __missing__(self, key: tuple[str, str]) -> bool:
        left, right = key
        if left[-1] not in self.letters or right[0] not in self.letters:
            got = True  # a character of no piece never merges
        elif left + right in self.score:
            got = False
        elif left in self.score and right in self.score:
            got = self.bare.encode(left + right) == [self.id[left], self.id[right]]
        else:
            got = merged(self.score, left + right) == [left, right]
        if len(self) >= self.limit:
            self.clear()
        self[key] = got
        return got

    def made(self) -> set[str]:
        """Pieces that the merges do make out of their own text."""
        names = list(self.score)
        return {p for p, got in zip(names, self.bare.encode(names, num_threads=1)) if got == [self.id[p]]}


class PrefixCounter(dict):
    """Counts under one model; as a dict it is the bounded memo word -> tokens of the whole word."""

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__()
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.limit, self.pairs = limit, Pairs(self.score, limit)
        self.made = self.pairs.made()
        # the model must mark spaces, put one mark in front and change nothing else
        for probe in ("", " ", "  a b ", "　x\n\ty", "é ﬁ"):
            marked = (SPACE + probe.replace(" ", SPACE)) if probe else ""
            if "".join(model.encode(probe, out_type=str)) != "".join(
                    c if c in self.score else "".join(f"<0x{b:02X}>" for b in c.encode()) for c in marked):
                raise ValueError(f"{path} normalises text in a way these counts do not follow")
        alone = "".join(c for c in map(chr, range(128)) if c not in self.pairs.letters)
        inside = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.words = re.compile("(?s).+" if inside else (
            f"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+|[{re.escape(alone)}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")).findall

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ... word."""
        made, pairs, score, longest = self.made, self.pairs, self.score, self.longest
        count, last = [0], [""]
        for i in range(1, len(word) + 1):
            for start in range(i - longest if i > longest else 0, i):
                piece = word[start:i]
                if (piece in made or start == i - 1) and (not start or pairs[last[start], piece]):
                    count.append(count[start] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass"))))
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no piece ends {word[:i]!r}")
        return count[1:]

    def __missing__(self, word: str) -> int:
        total = self.counts(word)[-1]
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = total
        return total


class PrefixCounts:
    """The counts of one text: running totals at word ends, and counts inside a word on demand."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter = counter
        self.words = counter.words(SPACE + text.replace(" ", SPACE)) if text else []
        self.ends = np.cumsum(list(map(len, self.words)), dtype=np.int64) - 1
        self.totals = np.cumsum(list(map(counter.__getitem__, self.words)), dtype=np.int64)

    @property
    def total(self) -> int:
        return int(self.totals[-1]) if len(self.words) else 0

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars <= 0 or not self.words:
            return 0
        at = int(np.searchsorted(self.ends, chars))
        if at >= len(self.words):
            return self.total
        start = int(self.ends[at - 1]) if at else -1
        return (int(self.totals[at - 1]) if at else 0) + self.counter.counts(self.words[at])[chars - start - 1]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        at = int(np.searchsorted(self.totals, budget, side="right"))
        done, spent = (int(self.ends[at - 1]), int(self.totals[at - 1])) if at else (-1, 0)
        if at < len(self.words):
            fits = np.flatnonzero(np.array(self.counter.counts(self.words[at])) <= budget - spent)
            done += int(fits[-1]) + 1 if len(fits) else 0
        return max(done, 0)

    def every(self) -> np.ndarray:
        """Counts of all prefixes, from the empty one to the whole text."""
        if not self.words:
            return np.zeros(1, np.int64)
        before = np.concatenate(([0], self.totals[:-1]))
        return np.concatenate(([0], np.concatenate([b + np.array(self.counter.counts(w)) for b, w in zip(before, self.words)])[1:]))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per worker process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within_limit for every row of ``docs`` (doc_id, text).

    ``chars_within_limit`` is the longest prefix with at most ``limit`` tokens.  Null text counts as empty: no bytes, no tokens.
    Any id, null or repeated, is carried along; other columns are ignored.  An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_bytes": [], "n_tokens": [], "chars_within_limit": []}
        for text in batch["text"]:
            text = text or ""
            known = PrefixCounts(counter(path), text)
            out["n_bytes"].append(len(text.encode("utf-8", "surrogatepass")))
            out["n_tokens"].append(known.total)
            out["chars_within_limit"].append(len(text) if known.total <= limit else known.longest(limit))
        return out

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_bytes long, n_tokens long, chars_within_limit long", run).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within_limit")


def stored_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``counts``, the token count of every prefix: counts[i] is that of the first i characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, counts array<int>", lambda b: {
        "doc_id": b["doc_id"], "counts": [PrefixCounts(counter(path), t or "").every() for t in b["text"]]})


def count_at(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters, from stored counts."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1)
    return F.element_at(counts, (F.greatest(at, F.lit(0)) + 1).cast("int"))


def chars_within(counts: Column, budget: Column | int) -> Column:
    """Longest prefix with at most ``budget`` tokens, from stored counts."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= most, i)))
