import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from quillgraph.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=20):
    split = [(i, Counter(terms_of(t))) for i, t in docs]
    with_terms = [(i, c) for i, c in split if c]
    n_docs, length = len(with_terms), sum(c.total() for _, c in with_terms)
    df = Counter(t for _, c in with_terms for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(terms_of(text))
        scored = []
        for i, c in with_terms:
            m = 75 + (25 * c.total() * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def run(spark, make, docs, items, **options):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = R.ranked_search(make(docs, clashing=True).withColumnRenamed("size", "rank"), asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some(seed, n, words=60):
    draw = random.Random(seed)
    return [(i, " ".join(f"w{int(draw.paretovariate(0.7)) % words}" for _ in range(draw.randrange(1, 60)))) for i in range(n)]


def test_against_brute_force_with_odd_rows(spark, make, odd_rows):
    docs = odd_rows + some(1, 150) + [(900 + i, "w1 w2 tied tied") for i in range(40)]
    items = [(1, "w1 w2 w3"), (2, "W1 w2, w3-w4 w4"), (2, "second item with the same id: w1"), (None, "tied w1 w2 É é"), (4, None), (5, ""),
             (6, "...!"), (7, "nowhere found"), (8, "one two three one"), (9, "x" * 5000), (10, "𝒳 ﬁ")]
    assert run(spark, make, docs, items) == brute(docs, items)
    assert run(spark, make, docs, items, k=3, queries_per_pass=2) == brute(docs, items, 3)


def test_empty_tables(spark, make):
    items = [(1, "a b")]
    assert run(spark, make, [], items) == []
    assert run(spark, make, [(1, "a")], []) == []
    assert run(spark, make, [(1, None), (2, "...")], items) == []


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"word{i % 91}" for i in range(5000))
    whole = R.term_counts(text)
    monkeypatch.setattr(R, "PIECE", 37)
    assert R.term_counts(text) == whole == Counter(w.encode() for w in text.split())


def sums(plan):
    """Terms of each query of a plan, with multiplicity, by unfolding its graph."""
    leaves = [Counter({t: 1}) for t in plan.terms]
    for a, b in plan.pairs:
        leaves.append(leaves[a] + leaves[b])
    out = []
    for parts in plan.sums:
        total = Counter()
        for node, times in parts:
            for t, c in leaves[node].items():
                total[t] += c * times
        out.append(total)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f"]), max_size=12), max_size=8))
def test_graph_unfolds_to_the_queries(queries):
    plan = R.share([(i, Counter(q)) for i, q in enumerate(queries)])
    assert sums(plan) == [Counter(q) for q in queries]
    for node, a, b in (x for level in plan.levels() for x in level.T):
        assert a < node and b < node


def test_shared_terms_are_summed_once():
    base = [b"t%d" % i for i in range(10)]
    plan = R.share([(i, Counter([*base, b"own%d" % i])) for i in range(20)])
    # nine additions build the common part; each query then adds its own term
    assert len(plan.pairs) == 9 and all(len(p) == 2 for p in plan.sums)


@pytest.mark.parametrize("n", [1, 2])
def test_no_pair_is_left_unshared(n):
    plan = R.share([(i, Counter([b"a", b"b", b"c"])) for i in range(n)])
    assert [len(p) for p in plan.sums] == ([3] if n == 1 else [1, 1])
