import itertools
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from quillgraph.llm import exact_dedup, line_dedup, near_dedup
from tests.llm.conftest import CLASHING

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# exact dedup

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    best = {k: max([i for i in v if i is not None], default=None) for k, v in groups.items()}
    return sorted(((i, best[lower(t or "")], len(groups[lower(t or "")]), i == best[lower(t or "")]) for i, t in rows), key=repr)


def test_exact_dedup_odd_rows(make, odd_rows):
    rows = odd_rows + [(20, "Straße"), (21, "STRAßE"), (22, "STRASSE"), (None, ""), (23, "É"), (24, "é")]
    got = exact_dedup.mark_duplicates(make(rows, clashing=True))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept") == exact_brute(rows)


def test_exact_dedup_hot_group_and_salts(make):
    rows = [(i, "Hot text") for i in range(500)] + [(1000 + i, f"cold {i % 50}") for i in range(200)]
    for salts in (1, 7):
        assert rows_of(exact_dedup.mark_duplicates(make(rows), salts), "doc_id", "keep_id", "group_size", "kept") == exact_brute(rows)


def test_exact_dedup_does_not_rest_on_the_digest(make, monkeypatch):
    """With a digest that is the same for all texts the contents still decide."""
    from pyspark.sql import functions as F
    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda docs: keyed(docs).withColumn("_digest", F.lit("same")))
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, None), (5, "")]
    assert rows_of(exact_dedup.mark_duplicates(make(rows)), "doc_id", "keep_id", "group_size", "kept") == exact_brute(rows)


def test_exact_dedup_empty(make):
    assert exact_dedup.mark_duplicates(make([])).count() == 0


# line dedup

def lines_brute(rows, similarity=80):
    """(doc_id, removed) by comparing every line with every earlier one; ids must differ."""
    lines = [(i, k, frozenset(WORD.findall(x))) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
             for k, x in enumerate((t or "").split("\n"))]
    gone = defaultdict(list)
    for at, (i, k, a) in enumerate(lines):
        gone[i] += []
        if a and any(b and 100 * len(a & b) >= similarity * len(a | b) for _, _, b in lines[:at]):
            gone[i].append(k)
    return sorted(((i, v) for i, v in gone.items()), key=repr)


@pytest.mark.parametrize("similarity", [60, 80, 100])
def test_line_dedup_against_brute_force(make, similarity):
    draw = random.Random(5)
    base = [prose(k, draw.choice([1, 3, 4, 5, 9, 10, 20, 40]), 60) for k in range(60)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(draw.randrange(1, 6)):
            words = draw.choice(base).split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                words[draw.randrange(len(words))] = f"w{draw.randrange(60)}"
            lines.append(" ".join(words).upper() if draw.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(lines + [""] * draw.randrange(2))))
    got = line_dedup.line_report(make(rows), similarity)
    assert rows_of(got, "doc_id", "removed") == lines_brute(rows, similarity)


def test_line_dedup_odd_rows(make, odd_rows):
    rows = list(dict.fromkeys(r for r in odd_rows if r[0] != 5)) + [(50, "a b c d e\nB A c D e\n\n \na b c d f g h")]
    assert rows_of(line_dedup.line_report(make(rows, clashing=True)), "doc_id", "removed") == lines_brute(rows)
    assert line_dedup.line_report(make([])).count() == 0


def test_line_dedup_rewrites_texts(make):
    rows = [(1, "one two three\nkeep me"), (2, "new words here\none two three"), (3, None), (4, "keep me"), (4, "other text"), (5, ""), (5, "")]
    got = line_dedup.drop_repeated_lines(make(rows, clashing=True))
    assert rows_of(got, "doc_id", "text", "n_chars") == sorted([
        (1, "one two three\nkeep me", 21), (2, "new words here", 14), (3, None, None), (4, "", 0), (4, "other text", 10),
        (5, "", 0), (5, "", 0)], key=repr)
    assert [tuple(r) for r in got.select(*CLASHING).distinct().collect()] == [tuple(f"own {c}" for c in CLASHING)]


def test_line_dedup_pairs_few_unlike_long_lines(make, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(150))) for i in range(300)]
    pairs, write = [], line_dedup.write_table

    def counted(df, name):
        out = write(df, name)
        if name == "line-pairs":
            pairs.append(out[0].count())
        return out

    monkeypatch.setattr(line_dedup, "write_table", counted)
    assert set(rows_of(line_dedup.line_report(make(rows)), "doc_id", "n_removed")) == {(i, 0) for i in range(300)}
    # most of the 44,850 pairs share a word of their prefixes
    assert sum(pairs) < 300, pairs


def test_line_dedup_has_no_python(make):
    plan = line_dedup.drop_repeated_lines(make([(1, "a b c d"), (2, "a b c d")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# near dedup

def near_brute(rows, similarity):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))
    find = lambda x: x if head[x] == x else find(head[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            head[x] = y
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = min([x for x in least[find(k)] if x is not None], default=None)
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("similarity", [80, 85])
def test_near_dedup_against_brute_force(make, similarity):
    draw = random.Random(9)
    rows, i = [], 0
    for base in range(12):
        words = prose(base, draw.choice([4, 6, 30, 120, 300]), 3000).split()
        for _ in range(draw.choice([1, 3, 10])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10_000)}"
            rows.append((i, " ".join(copy)))
            i += 1
    # a chain in which only neighbours are near
    chain = prose(99, 200, 5000).split()
    for step in range(30):
        rows.append((i + step, " ".join(chain)))
        chain[step * 6] = f"step{step}"
    draw.shuffle(rows)
    got = near_dedup.components(make(rows), similarity)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute(rows, similarity)


def test_near_dedup_without_pivots_gives_the_same(make):
    rows = [(k, prose(1, 150, 4000).replace("w1 ", "") + f" end{k} w{k}") for k in range(25)]
    one = rows_of(near_dedup.components(make(rows), 80, pivot_rounds=0), "doc_id", "component_id")
    assert one == rows_of(near_dedup.components(make(rows), 80, pivot_rounds=2), "doc_id", "component_id")
    assert {c for _, c in one} == {0}


def test_near_dedup_odd_rows(make, odd_rows):
    rows = odd_rows + [(None, None), (None, "no id here but words enough"), (30, "b a"), (31, "A")]
    got = near_dedup.components(make(rows, clashing=True), 80)
    want = [r if r[2] is not None or r[0] is not None else (None, r[1], None, True) for r in near_brute(rows, 80)]
    assert [r[:3] for r in rows_of(got, "doc_id", "n_shingles", "component_id")] == sorted((
        (i, n, i if n == 0 else c) for i, n, c, _ in want), key=repr)
    assert near_dedup.components(make([])).count() == 0


def test_keep_first_keeps_columns(make):
    rows = [(3, prose(1, 60)), (2, prose(1, 60) + " tail"), (9, prose(2, 60)), (8, None), (7, "")]
    got = near_dedup.keep_first(make(rows, clashing=True))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7, 8, 9]
    assert got.columns == make(rows, clashing=True).columns


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 300), st.integers(0, 60))
def test_odd_sketch_estimates(n, changed):
    import numpy as np
    items = near_dedup.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    a, b = items[:n], np.concatenate((items[:max(0, n - changed)], items[n:n + min(changed, n)]))
    bands, exact = near_dedup.band_count(80), len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    samples = bands * near_dedup.ROWS
    x, y = (near_dedup.odd_sketch(near_dedup.min_hashes(s, samples)) for s in (a, b))
    differ = sum(int(v).bit_count() for v in (x.view(np.uint64) ^ y.view(np.uint64)))
    if exact >= 0.8:
        assert differ <= near_dedup.most_differing(80, samples)
    if exact <= 0.35:
        assert differ > near_dedup.most_differing(80, samples)


def test_band_count_keeps_its_promise():
    for similarity in (80, 85, 95):
        bands = near_dedup.band_count(similarity)
        assert (1 - (similarity / 100) ** near_dedup.ROWS) ** bands <= near_dedup.MISS
