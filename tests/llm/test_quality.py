import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from quillgraph.llm import bytewords, quality
from tests.llm.conftest import CLASHING

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("ab \n\t#|é　"), max_size=120)


def counts_brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lines, dup = t.split("\n"), 0
    for k, x in enumerate(lines):
        dup += bool(WORD.search(x)) and x in lines[:k]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_counts(texts):
    got = []
    for p in bytewords.pieces(texts):
        c = quality._counts(p)
        got += list(zip(*(c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [counts_brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.booleans())
def test_words_have_one_hash_each(texts, lower):
    hashes, words = [], []
    for p in bytewords.pieces(texts, lower):
        hashes += p.words.tolist()
        words += [w for t in p.texts for w in WORD.findall(t.lower() if lower and t.isascii() else t)]
    names = dict(zip(hashes, words))
    assert len(hashes) == len(words)
    assert all(names[h] == w for h, w in zip(hashes, words)) or lower
    assert len(set(words)) == len(names) or lower


def test_joined_runs():
    h = bytewords.mix64(np.arange(1, 40, dtype=np.uint64))
    for n in (1, 2, 3, 5, 8):
        runs = bytewords.joined(np.concatenate((h, h)), n)
        assert len(runs) == 2 * len(h) - n + 1 and len(set(runs.tolist())) == len(h)
    assert len(bytewords.joined(h[:3], 5)) == 0


def corpus():
    draw = random.Random(3)
    good = lambda: " ".join(f"good{draw.randrange(300)}" for _ in range(80))
    bad = lambda: " ".join(f"junk{draw.randrange(300)}" for _ in range(80))
    return [(i, good() if i % 3 else bad()) for i in range(150)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_against_brute_force(spark, make):
    rows = corpus()
    trusted = {i for i, _ in rows if i % 3 and i % 2}
    labels = labels_of(spark, [(i, 1, 0) for i in trusted] + [(0, 0, 0), (None, 1, 0), (5, 0, 1)])
    got = {r["doc_id"]: r for r in quality.quality_rules(make(rows, clashing=True), labels).collect()}
    grams = {}
    for i, t in rows:
        [p] = bytewords.pieces([t])
        one, two, _ = quality._grams(p, quality.BUCKETS)
        grams[i] = one.tolist() + two.tolist()
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in trusted:
            np.add.at(good, g, 1)
    p_raw = (raw + 1) / (raw.sum() + quality.BUCKETS)
    w = np.log((good + quality.PRIOR * p_raw) / (good.sum() + quality.PRIOR)) - np.log(p_raw)
    for i, g in grams.items():
        assert abs(got[i]["score"] - w[g].mean()) < 1e-9
        assert got[i]["kept"] == (i % 3 != 0)
    kept = quality.keep_good(make(rows, clashing=True), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 3}
    assert [tuple(r) for r in kept.select(*CLASHING).distinct().collect()] == [tuple(f"own {c}" for c in CLASHING)]


def test_odd_rows(spark, make, odd_rows):
    labels = labels_of(spark, [(4, 1, 0)])
    got = quality.quality_rules(make(odd_rows, clashing=True), labels).collect()
    assert len(got) == len(odd_rows)
    want = {(i, *counts_brute(t)) for i, t in odd_rows if i not in (4,)}
    fields = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert want <= {tuple(r[f] for f in fields) for r in got}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert quality.quality_rules(make([]), labels).count() == 0


def test_no_trusted_documents(spark, make):
    got = quality.quality_rules(make(corpus()), labels_of(spark, [])).collect()
    assert all(r["kept"] and r["score"] == 0 for r in got)


def test_every_trusted_document_counts(spark):
    labels = spark.range(100_100).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 100_100
