import random
import re
from collections import Counter, defaultdict

import pytest

from quillgraph.llm import collocations as C

WORD, PIECE = re.compile(r"[^\x20\x09]+"), re.compile(r"[.,;:!?\x0A-\x0D]")


def brute(rows, least=30, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        lang = "und" if lang is None else lang
        for piece in PIECE.split(low):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i:i + k]] = max(cover[p[i:i + k]], a)
        ranked = []
        for p, a in cands.items():
            if p in cover and 100 * cover[p] >= 80 * a:
                continue
            cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-cut[0], -a, " ".join(p).encode(), counts[p[:cut[1]]], counts[p[cut[1]:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def prose(seed, n, size=12):
    draw = random.Random(seed)
    words = [f"v{int(draw.paretovariate(1.1)) % size}" for _ in range(n)]
    return "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for w in words)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)],
                               "doc_id long, lang string, text string, words string, f long").repartition(3)
    got = C.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


ROWS = ([("en", prose(i, 400)) for i in range(20)] + [("de", prose(100 + i, 300, 7)) for i in range(8)]
        + [(None, "New York City is, New York City. " * 40), ("und", "new york\tcity"), ("en", None), ("en", ""), ("fr", "!?.,"), ("", "a b " * 50),
           ("fr", "é ü " * 35 + "É ü"), ("fr", "\x1c y " * 33), ("en", prose(1, 400)), ("en", prose(1, 400))])


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


@pytest.mark.parametrize("bits", [15, 20])
def test_a_full_filter_changes_nothing(spark, bits):
    assert run(spark, ROWS, least=5, top=40, bits=bits) == brute(ROWS, 5, 40)


def test_blocks_of_a_long_text(spark, monkeypatch):
    rows = [("en", "a b c a b d " * 3000), ("en", prose(3, 3000)), ("de", "lang" * 4000 + " ende")]
    for size in (1, 7, 64):
        texts = [t for _, t in rows]
        monkeypatch.setattr(C, "PIECE", size * 100)
        opened = []
        for raw, own in C._blocks(texts):
            words = C._Words(raw, own, "en", 20)
            opened += [raw[s:e] for s, e in zip(words.starts[:words.own], words.ends[:words.own])]
            # the three words after a block's last one come along, unless its piece ends
            assert words.own == len(words.starts) or len(words.starts) <= words.own + 3
        assert opened == [w for t in texts for w in "\n".join([t]).translate({44: 10, 46: 10}).lower().encode().split()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None)]) == []


def test_exact_beyond_64_bits(spark):
    big = 10**14
    rows = [("en", 1, "a", big * 3), ("en", 1, "b", big * 5 + 7), ("en", 2, "a b", big + 1)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    got = C._scored(counts).collect()[0]
    assert got["score"] == 2_000_000 * (big + 1) // (8 * big + 7) and (got["l"], got["r"]) == (3 * big, 5 * big + 7)
