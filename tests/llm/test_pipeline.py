"""The pipeline against plain-Python versions of its stages, each judged on its own input."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quillgraph.llm import mixing  # noqa: E402
from tests.llm.test_dedup import lines_brute, near_brute  # noqa: E402
from tests.llm.test_mixing import WORD, targets_brute  # noqa: E402
from tests.llm.test_quality import counts_brute  # noqa: E402
from tests.llm.test_tokens import LIBRARY  # noqa: E402


def corpus():
    draw = random.Random(11)
    prose = lambda n: " ".join(f"good{draw.randrange(900)}" for _ in range(n))
    rows = []
    for i in range(110):
        kind = i % 11
        text = "\n".join(prose(draw.choice([25, 40, 60])) for _ in range(draw.randrange(1, 4)))
        if kind == 0:
            text = " ".join(f"junk{draw.randrange(300)}***" for _ in range(60))
        elif kind == 1:
            text = "too short"
        elif kind == 2:
            text += "\n" + "the same footer stands under many of these documents"
        elif kind == 3 and rows:
            text = rows[draw.randrange(len(rows))][1] or text
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text, "en", ["a", "b", "c", None][draw.choice([0, 0, 0, 1, 2, 3])], len(text)))
    return rows + [(200, None, None, None, None), (201, "", "en", "a", 0)]


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(corpus(), make([]).schema)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 11 == 0 else 1, 0) for i in range(0, 110, 2) if i % 11 != 1]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, make, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {}
    assert [s.__name__ for _, s in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
        rows[name] = (out if k == 4 else docs).collect()

    start = {r[0]: r for r in corpus()}
    good = rows["quality rules"]
    junk = {i for i, t, *_ in corpus() if i % 11 == 0 and i < 110}
    failed = {i for i, t, *_ in corpus() if (c := counts_brute(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert {r["doc_id"] for r in good} == set(start) - junk - failed
    assert all(tuple(r) == start[r["doc_id"]] for r in good)

    gone = dict(lines_brute([(r["doc_id"], r["text"]) for r in good]))
    want = {r["doc_id"]: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[r["doc_id"]]) for r in good}
    assert {r["doc_id"]: r["text"] for r in rows["line dedup"]} == want
    assert any(gone.values()) and all(r["n_chars"] == len(r["text"]) for r in rows["line dedup"])

    kept = {i for i, _, _, k in near_brute([(r["doc_id"], r["text"]) for r in rows["line dedup"]], 80) if k}
    assert {r["doc_id"] for r in rows["near dedup"]} == kept

    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows["near dedup"]}
    source = {r["doc_id"]: r["source"] for r in rows["near dedup"]}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    copies = Counter(r["doc_id"] for r in rows["mix sources"])
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += n * copies[i]
        longest[source[i]] = max(longest[source[i]], n)
    targets = targets_brute(sizes)
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 for s in sizes) and max(copies.values()) <= mixing.MOST_COPIES

    encoded = [(r["doc_id"], list(r["ids"]), r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in rows["byte bpe"]]
    expected = []
    for r in rows["mix sources"]:
        ids = LIBRARY.encode_ordinary(r["text"])
        expected.append((r["doc_id"], ids, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(r["text"].encode()).hexdigest(), len(ids)))
    assert sorted(encoded) == sorted(expected)

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole) == sorted((e[0], e[2]) for e in expected)


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
