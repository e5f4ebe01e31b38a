"""Writes a sentencepiece BPE model from pieces and scores."""

from __future__ import annotations

import struct


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


# Fixed values of the sentencepiece model format: field numbers and enum values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def model_bytes(scores: dict[str, float]) -> bytes:
    """The serialised model: piece i is the i-th of ``scores``, an unknown piece follows; texts are taken as they are."""
    piece = lambda text, score, kind: _block(PIECES, (
        _block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score) + _number(PIECE_TYPE, kind)))
    body = b"".join(piece(p, s, NORMAL) for p, s in scores.items()) + piece("<unk>", 0.0, UNKNOWN)
    trainer = (_number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(scores) + 1) + _number(UNK_ID, len(scores))
               + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1))
    normalizer = (_block(NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(REMOVE_SPACES, 0) + _number(ESCAPE_SPACES, 0))
    return body + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)
