import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing
from tests.llm.conftest import CLASHING

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_brute(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        rate = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if most * sizes[s] <= rate * w[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else rate * w[s] for s in names}
        capped |= over


def corpus(n=300):
    return [(i, " ".join(["w"] * (1 + (i * 7919) % 120)), ["a", "b", "c", "B", None][i % 5 if i % 3 else 0]) for i in range(n)]


def test_targets_and_words(make):
    rows = corpus()
    got = mixing.pareto_mix(make(rows, clashing=True)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want, source = targets_brute(sizes), {i: s for i, _, s in rows}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(make):
    one = sorted(map(tuple, mixing.pareto_mix(make(corpus())).collect()))
    two = sorted(map(tuple, mixing.pareto_mix(make(corpus()).repartition(7, "text")).collect()))
    assert one == two
    assert one != sorted(map(tuple, mixing.pareto_mix(make(corpus()), seed=2).collect()))


@pytest.mark.parametrize("bins", [1, 16, 1 << 16])
def test_bins_do_not_matter(make, bins):
    got = mixing.pareto_mix(make(corpus(120)), bins=bins)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.pareto_mix(make(corpus(120))).collect()))


def test_unequal_odds_are_pareto_sampling(make):
    """Against the ranks computed one by one, with odds that differ within a source."""
    rows = [(i, "w " * (3 + i % 9), "a") for i in range(200)]
    appeal = 1 + F.col("doc_id") % 4
    got = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(make(rows), appeal=appeal, most_copies=4, share=1.0).collect()}
    us = {r["doc_id"]: r["u"] for r in make(rows).select("doc_id", mixing.uniform(F.col("doc_id"), 1).alias("u")).collect()}
    size = {i: 3 + i % 9 for i, _, _ in rows}
    total = sum(size.values())
    rate = total / sum(size[i] * (1 + i % 4) for i in size)
    expected = {i: min(4.0, rate * (1 + i % 4)) for i in size}
    sure = {i: math.floor(e) for i, e in expected.items()}
    ranks = sorted(((us[i] / (1 - us[i])) / ((e - sure[i]) / (1 - e + sure[i])), i) for i, e in expected.items() if e > sure[i])
    left, want = total - sum(sure[i] * size[i] for i in size), dict(sure)
    for _, i in ranks:
        if size[i] / 2 > left:
            break
        want[i] += 1
        left -= size[i]
    assert got == want
    # the more appealing a document, the oftener it is taken
    by = [sum(c for i, c in got.items() if i % 4 == k) for k in range(4)]
    assert by == sorted(by)


def test_documents_are_repeated(make):
    rows = corpus(60)
    docs = make(rows, clashing=True)
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(docs).collect()}
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    seen = defaultdict(int)
    for r in got.collect():
        seen[r["doc_id"]] += 1
        assert r["_size"] == "own _size"
    assert seen == {i: c for i, c in copies.items() if c}
    assert set(CLASHING) <= set(got.columns)


def test_odd_rows(make, odd_rows):
    got = mixing.pareto_mix(make(odd_rows, clashing=True)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.pareto_mix(make([])).count() == 0 and mixing.mix_documents(make([])).count() == 0
    assert [tuple(r) for r in mixing.pareto_mix(make([(1, None), (2, "")])).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2
