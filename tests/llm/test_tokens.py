import base64
import hashlib
import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402
from hypothesis import given, settings, strategies as st  # noqa: E402

from quillgraph.llm import byte_bpe, token_counts  # noqa: E402

RANKS, MODEL = P.path(byte_bpe.VOCABULARY), P.path(token_counts.MODEL)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
CODEC, COUNTER = byte_bpe.Codec(RANKS, P.PATTERN), token_counts.PrefixCounter(MODEL)
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MIXED = st.text(st.one_of(st.sampled_from("  \n\t▁aethinosr'll9<>é"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_ids_are_those_of_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_every_token_and_byte():
    some = list(CODEC.ranks)[::37]
    for raw in some:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)
    assert byte_bpe.unshown(byte_bpe.shown(bytes(range(256)))) == bytes(range(256))


def test_long_texts_go_block_by_block(monkeypatch):
    text = "word and 12 more!\n" * 500 + "x" * 3000
    whole = CODEC.encode(text)
    monkeypatch.setattr(byte_bpe, "SHORT", 10)
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    assert CODEC.encode(text) == whole == LIBRARY.encode_ordinary(text)


def test_a_full_memo_changes_nothing():
    small = byte_bpe.Codec(RANKS, P.PATTERN, limit=5)
    for text in ("one two three four five six seven", "eight nine ten", "one two"):
        assert small.encode(text) == LIBRARY.encode_ordinary(text)


def test_encode_query_shape(make, odd_rows):
    got = byte_bpe.encode_digests(make(odd_rows, clashing=True), RANKS, P.PATTERN, with_ids=True).collect()
    want = []
    for i, t in odd_rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_digests(make([]), RANKS, P.PATTERN).count() == 0


def test_texts_round_trip(make, odd_rows):
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(make(odd_rows), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in odd_rows), key=repr)


@settings(max_examples=150, deadline=None)
@given(MIXED, st.integers(0, 30))
def test_prefix_counts_are_those_of_the_library(text, budget):
    known = token_counts.PrefixCounts(COUNTER, text)
    want = [len(PIECES.encode(text[:i])) for i in range(len(text) + 1)]
    assert known.every().tolist() == want
    assert [known.count(i) for i in range(len(text) + 2)] == want + want[-1:]
    assert known.longest(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_runs_of_spaces_and_pieces():
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice([" " * draw.randrange(1, 40), "the", "ing", "x", "\n", "日本"]) for _ in range(8))
        assert token_counts.PrefixCounts(COUNTER, text).total == len(PIECES.encode(text)), text


def test_token_counts_odd_rows(make, odd_rows):
    rows = odd_rows + [(40, "<s></s><unk><0x0A>"), (41, "▁▁ a")]
    got = token_counts.token_counts(make(rows, clashing=True), MODEL, limit=50).collect()
    want = [(i, len((t or "").encode()), n := len(PIECES.encode(t or "")), n > 50) for i, t in rows]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        assert len(PIECES.encode(text[:r["chars_within_limit"]])) <= 50
        assert r["chars_within_limit"] == len(text) or r["over_limit"]
    assert token_counts.token_counts(make([]), MODEL).count() == 0


def test_stored_counts_answer_without_encoding(make):
    rows = [(1, "hello wonderful world of tokens"), (2, None), (3, "")]
    stored = token_counts.stored_counts(make(rows), MODEL)
    got = stored.select("doc_id", token_counts.count_at(stored["counts"], 7).alias("n"), token_counts.chars_within(stored["counts"], 3).alias("c")).collect()
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        assert r["n"] == len(PIECES.encode(text[:7]))
        assert r["c"] == max(i for i in range(len(text) + 1) if len(PIECES.encode(text[:i])) <= 3)
