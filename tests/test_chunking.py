import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import markdown as M
from quillgraph.operators import chunking as C
from tests import models

DOC = "doc_id bigint, source_file string, source_type string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d/f{i}.md", "markdown", t) for i, t in enumerate(texts)], DOC)


def chunks(spark, text, **kw):
    return C.chunk_documents(docs(spark, text), C.ChunkParams(**kw)).orderBy("seq").collect()


def test_headings_pages_and_fences(spark):
    text = "lead\n# A\nx\n```\n# no\n12\n```\n<!-- page: 4 -->\n## B ##\ny\n0\nz\n# C\n\n"
    got = [(r["page"], r["heading_path"], r["text"]) for r in C.assign_sections(docs(spark, text)).orderBy("section_no").collect()]
    assert got == [(0, [], "lead"), (0, ["A"], "x\n```\n# no\n12\n```"), (4, ["A", "B"], "y"), (1, ["A", "B"], "z")]


def test_blocks(spark):
    text = ("# T\np1\np2\n\n| a | b |\n|---|---|\n| 1 | 2 |\nq\n![i](u.png)\n~~~\n```\n~~~\n"
            "<table><tr><td>1</td></tr>\n</table> x\nend\n```\nopen")
    b = C.classify_text_blocks(C.segment_blocks(C.assign_sections(docs(spark, text)))).orderBy("block_no")
    assert [(r["kind"], r["line_index"], r["text"]) for r in b.collect()] == [
        ("text", 0, "p1\np2"), ("table", 3, "| a | b |\n|---|---|\n| 1 | 2 |"), ("text", 6, "q"), ("image", 7, "![i](u.png)"),
        ("code", 8, "~~~\n```\n~~~"), ("table", 11, "<table><tr><td>1</td></tr>\n</table> x"), ("text", 13, "end"),
        ("code", 14, "```\nopen")]


def test_table_and_image_document(spark):
    text = ("# Guide\n\n## Net\n\nOpen the panel.\n\n![port view](img/port.png)\n\nThen confirm.\n\n"
            "| 参数 | 默认 | 说明 |\n| --- | --- | --- |\n| MTU | 9014 | size |\n")
    rows = {r["block_type"]: r for r in chunks(spark, text)}
    image = rows["image"]
    assert image["image_path"] == "img/port.png" and image["image_alt"] == "port view"
    assert image["content"] == "Open the panel.\n\n![port view](img/port.png)\n\nThen confirm."
    assert "[Path: Guide] [Path: Guide > Net] [Type: image] [Title: Net]" in image["embedding_text"]
    table = rows["parameter_table"]
    assert table["description"].endswith("表头包含：参数、默认、说明。\n参数为MTU，默认为9014，说明为size。")


def test_heading_only_in_embedding_text_and_empty_section_absent(spark):
    rows = chunks(spark, "# Top\n\nname: value\n\n## Empty\n\n## Steps\n\n1. one\n2. two\n")
    assert all("Empty" not in r["heading_path"] for r in rows)
    steps = rows[-1]
    assert steps["block_type"] == "tutorial" and "Steps" not in steps["content"] and "Top > Steps" in steps["embedding_text"]


def test_long_paragraph(spark):
    rows = chunks(spark, "# H\n\n" + " ".join(f"alpha{i}" for i in range(700)) + "\n\n## S\n\nshort\n")
    assert len(rows) > 2 and rows[0]["content"].startswith("alpha0")
    assert all(r["content"] == r["display_content"] for r in rows)


def test_contents_section_dropped_and_fallback(spark):
    assert [r["content"] for r in chunks(spark, "# 目录\njunk\n# Real\nbody text")] == ["body text"]
    assert [r["content"] for r in chunks(spark, "# only heading")] == ["# only heading"]
    assert chunks(spark, " \n\t\n") == []


def test_html_rows(spark):
    text = "<table><tr><th>k <b>x</b></th><td> v </td></tr><tr><td></td><td></td></tr>\n<tr><td>1</td></tr></table>"
    got = spark.createDataFrame([(text,)], "t string").select(M.table_rows(F.col("t")).alias("r")).first()["r"]
    assert got == [["k x", "v"], ["1"]]


def test_split_matches_model(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab c。.,\n ") for _ in range(rnd.randrange(0, 900))) for _ in range(80)]
    texts += ["x" * 500, " " * 300, "工" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.split_long(F.col("t"), 100, 20).alias("p"))
    for r in df.collect():
        assert r["p"] == models.split_long(r["t"], 100, 20)
    with pytest.raises(ValueError):
        M.split_long(F.col("t"), 100, 60)


def _items(spark, rows):
    """rows: list of documents, each a list of (type, path, page, text)."""
    flat = [(d, i, *it) for d, doc in enumerate(rows) for i, it in enumerate(doc)]
    df = spark.createDataFrame(flat, "doc_id bigint, seq int, block_type string, heading_path string, page bigint, content string")
    for c, t in (("title", "string"), ("description", "string"), ("has_table", "boolean"), ("has_image", "boolean"),
                 ("image_alt", "string"), ("image_path", "string"), ("context_before", "array<string>"),
                 ("context_after", "array<string>")):
        df = df.withColumn(c, F.lit(None).cast(t))
    return C.collect_items(df)


def _random_docs(seed, n=60):
    rnd = random.Random(seed)
    kinds = ["text", "term", "image", "code", "tutorial"]
    return [[(rnd.choice(kinds), rnd.choice(["", "A", "A > B"]), rnd.choice([0, 0, 2]),
              "w" * rnd.choice([1, 5, 20, 60, 130])) for _ in range(rnd.randrange(1, 14))] for _ in range(n)]


def _texts(df):
    return {r["doc_id"]: [i["content"] for i in r["items"]] for r in df.collect()}


def test_micro_merge_matches_model(spark):
    rows = _random_docs(1)
    got = _texts(C.merge_micro(_items(spark, rows), 50, 100))
    for d, doc in enumerate(rows):
        assert got[d] == ["\n\n".join(doc[k][3] for k in g) for g in models.micro_groups(doc, 50, 100)]


def test_windows_match_model(spark):
    rows = _random_docs(2)
    got = _texts(C.window_flat_documents(_items(spark, rows).withColumn("depth", F.lit(0)), 150, 40))
    for d, doc in enumerate(rows):
        spans = models.windows([len(i[3]) for i in doc], [i[0] in ("image", "table", "parameter_table", "code") for i in doc], 150, 40)
        assert got[d] == ["\n\n".join(i[3] for i in doc[a:b]) for a, b in spans]


def test_strict_windows_never_exceed_the_limit(spark):
    rows = [[("text", "", 0, "w" * n) for n in (90, 40, 70, 120, 30, 100)]]
    got = _texts(C.window_flat_documents(_items(spark, rows).withColumn("depth", F.lit(0)), 150, 120, strict_max=True))
    assert all(len(t.replace("\n\n", "")) <= 150 for t in got[0])


def test_preamble_merge(spark):
    rows = [[("code", "", 3, "a"), ("text", "", 4, "b"), ("text", "X", 4, "c"), ("term", "", 5, "d"), ("text", "", 5, "e" * 200)]]
    out = C.merge_preamble(_items(spark, rows)).first()["items"]
    assert [(i["content"], i["block_type"], i["page"]) for i in out] == [
        ("a\n\nb", "text", 3), ("c", "text", 4), ("d", "text", 5), ("e" * 200, "text", 5)]


def test_ids_are_unique_and_do_not_depend_on_partitions(spark):
    text = "# A\n\n" + "x: same\n\n![i](p.png)\n\n" * 3
    d = docs(spark, text, text)
    a = C.chunk_documents(d)
    one = {(r["doc_id"], r["seq"], r["id"]) for r in a.collect()}
    two = {(r["doc_id"], r["seq"], r["id"]) for r in C.chunk_documents(d.repartition(7)).collect()}
    assert one == two and len({i for _, _, i in one}) == len(one)
    assert any(i.endswith("-2") for _, _, i in one)
    direct = C.stable_chunk_ids(a.drop("id"))
    assert {(r["doc_id"], r["seq"], r["id"]) for r in direct.collect()} == one


def test_chunk_plan_has_no_shuffle(spark):
    plan = C.chunk_documents(docs(spark, "# a\nb"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
