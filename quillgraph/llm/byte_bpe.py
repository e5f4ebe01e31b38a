"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

A rank file lists byte strings by rank.  Each byte is shown as one character (``chr(0x100 + byte)``), so that a byte string
becomes a piece; pieces are stored in rank order with score -rank in a sentencepiece BPE model with identity
normalisation.  Its merges then take the pair with the lowest rank first, the leftmost among equals, as
byte-level BPE does.  Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token that is itself in the
vocabulary is one token, any other is encoded by the model.  Decoding goes from ids back to pieces and bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from quillgraph.llm.common import map_rows
from quillgraph.llm.piece_model import model_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of one text that are held as objects at a time, and texts that are cut at once (in characters).
BLOCK, SHORT = 200_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_SHOWN = {b: 0x100 + b for b in range(256)}


def shown(raw: bytes) -> str:
    """One character per byte."""
    return raw.decode("latin-1").translate(_SHOWN)


def unshown(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


class Codec(dict):
    """Encoder and decoder; as a dict it is a memo pre-token -> ids as little-endian 32-bit integers.

    The memo is emptied before a block whenever it holds ``limit`` pre-tokens.
    """

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        super().__init__()
        import regex
        import sentencepiece
        self.ranks, self.limit = read_ranks(path), limit
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(
            {shown(t): -float(self.ranks[t]) for t in sorted(self.ranks, key=self.ranks.__getitem__)}))
        compiled = regex.compile(pattern)
        self.find, self.find_all = compiled.finditer, compiled.findall
        order = sorted(self.ranks, key=self.ranks.__getitem__)
        self.id_of_piece = np.array([self.ranks[t] for t in order], np.uint32)
        pieces = [unshown(self.model.id_to_piece(at)) for at in range(len(order))]
        # a list when ids are 0, 1, 2 ..., which is the usual case
        self.piece_of_id = pieces if self.id_of_piece[-1] == len(order) - 1 else dict(zip(self.id_of_piece.tolist(), pieces))

    def learn(self, words: Iterable[str]) -> None:
        """Put pre-tokens into the memo, those outside the vocabulary by one call of the model."""
        if len(self) >= self.limit:
            self.clear()
        rest = []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append((word, shown(raw)))
            else:
                self[word] = struct.pack("<I", rank)
        if rest:
            for (word, _), pieces in zip(rest, self.model.encode([piece for _, piece in rest], num_threads=1)):
                self[word] = self.id_of_piece[pieces].astype("<u4").tobytes()

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text, some pre-tokens at a time."""
        if len(text) <= SHORT:
            whole = self.find_all(text)
            parts = iter((whole,) if whole else ())
        else:
            words = (m.group() for m in self.find(text))
            parts = iter(lambda: list(islice(words, BLOCK)), [])
        for part in parts:
            try:
                yield b"".join(map(self.__getitem__, part))
            except KeyError:
                self.learn(dict.fromkeys(w for w in part if w not in self) if len(self) < self.limit else dict.fromkeys(part))
                yield b"".join(map(self.__getitem__, part))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.blocks(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.piece_of_id.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def encode_digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text); ``with_ids`` adds the ids.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded bytes as they are.  Null text counts as empty: no tokens,
    the digests of nothing.  Any id, null or repeated, is carried along; other columns are ignored.  Very
    long texts are encoded, decoded and hashed block by block; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batch: dict[str, list]) -> dict[str, list]:
        c = codec(path, pattern)
        out: dict[str, list] = {"doc_id": batch["doc_id"], **{n: [] for n in names}}
        for text in batch["text"]:
            ids, back, n, size, held = hashlib.sha256(), hashlib.sha256(), 0, 0, []
            for block in c.blocks(text or ""):
                part = np.frombuffer(block, "<u4")
                raw = c.decode(part.tolist())
                ids.update(block)
                back.update(raw)
                n, size = n + len(part), size + len(raw)
                if with_ids:
                    held.append(part.astype(np.int32))
            row = [n, size, ids.hexdigest(), back.hexdigest(), np.concatenate(held) if held else np.zeros(0, np.int32)]
            for name, value in zip(names, row):
                out[name].append(value)
        return out

    schema = f"doc_id {kind}, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs, ["doc_id", "text"], schema, run)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; nulls and empties give an empty array."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, ids array<int>", lambda b: {
        "doc_id": b["doc_id"], "ids": [codec(path, pattern).encode(t or "") for t in b["text"]]})


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``text`` of rows (doc_id, ids); ids that cut a character are shown with U+FFFD, null ids give null."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded, ["doc_id", "ids"], f"doc_id {kind}, text string", lambda b: {
        "doc_id": b["doc_id"],
        "text": [None if i is None else codec(path, pattern).decode(i).decode("utf-8", "replace") for i in b["ids"]]})
