import json
import random

from pyspark.sql import functions as F

from quillgraph.functions import vocab as V
from quillgraph.operators import conversation as CV, media as M, review as R, store as U
from quillgraph.operators.ordering import scratch_path
from quillgraph.plans import prompts as P
from quillgraph.sources import chunk_json as J, files as FS
from quillgraph.streaming import asr
from tests import models

STORE = ", ".join(f"{n} {t}" for n, t in J.STORE_FIELDS.items())


def test_condense_matches_model(spark):
    rnd = random.Random(7)
    words = ["怎么安装", "它 怎么用", "这个呢", "", "  ", "参数", "那么 ok", "plain"]
    convs = [[rnd.choice(words) for _ in range(rnd.randrange(1, 12))] for _ in range(50)]
    rows = [(c, t, q, "a") for c, conv in enumerate(convs) for t, q in enumerate(conv)]
    df = CV.condense_queries(spark.createDataFrame(rows, "conv_id bigint, turn bigint, query string, answer string"))
    got = {(r["conv_id"], r["turn"]): r["standalone_query"] for r in df.collect()}
    for c, conv in enumerate(convs):
        assert [got[c, t] for t in range(len(conv))] == models.condense(conv, V.FOLLOWUP_MARKERS)


def test_suggestions_match_model(spark):
    rnd = random.Random(13)
    chunks, sugg, want = [], [], []
    for f in range(25):
        n = rnd.randrange(2, 12)
        ids = [f"f{f}-{i}" for i in range(n)]
        mine = [(i, f" text {i} ") for i in ids]
        plan = {}
        for i in ids:
            action = rnd.choice(["keep", "update", "delete", "merge_with_next", "merge_with_next", "odd"])
            plan[i] = (action, rnd.choice(["", "new " + i]), rnd.choice(ids + ["", "missing"]))
        if n < 4:
            plan.pop(ids[0])
        # a chunk merged into itself is left to the reference rules: it stays and doubles its text
        plan = {k: v for k, v in plan.items() if not (v[0] == "merge_with_next" and v[2] == k)}
        chunks += [(f"f{f}.md", i, t, False, k) for k, (i, t) in enumerate(mine)]
        sugg += [(i, *v, "why", 1) for i, v in plan.items()]
        want += models.suggest(mine, plan)
    c = spark.createDataFrame(chunks, "source_file string, chunk_id string, content string, is_manual boolean, seq bigint")
    s = spark.createDataFrame(sugg, "chunk_id string, action string, optimized_content string, merge_target_id string, reason string, pos bigint")
    got = [(r["chunk_id"], r["content"]) for r in R.apply_suggestions(c, s).collect()]
    assert sorted(got) == sorted(want)


def test_long_merge_chains_take_few_rounds(spark, monkeypatch):
    """Chains, stars and random trees of merges against a walk from front to back."""
    rnd = random.Random(2)
    merges = [("chain", f"c{i:04d}", f"c{i + 1:04d}") for i in range(1000)]
    merges += [("star", f"s{i}", "s99") for i in range(20)] + [("star", "s99", "t")]
    for f in range(40):
        n = rnd.randrange(2, 60)
        merges += [(f"tree{f}", f"{i:03d}", f"{rnd.randrange(i + 1, min(n, i + rnd.choice([2, 2, 9])) + 1):03d}") for i in range(n) if rnd.random() < 0.9]
    skipped = set()
    for f, chunk, target in sorted(merges, key=lambda m: (m[0], m[1] if m[0] != "star" or m[1] != "s99" else "t0")):
        if (f, chunk) not in skipped:
            skipped.add((f, target))
    rounds = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    reach = spark.createDataFrame(merges, "source_file string, chunk_id string, target string")
    assert {tuple(r) for r in R._resolve_skips(reach).collect()} == skipped
    rounds.clear()
    got = R._resolve_skips(reach.filter("source_file = 'chain'"))
    assert got.count() == 500 and len(rounds) <= 2 + 4 + 12


def _store(spark, rows):
    return spark.createDataFrame([(i, c, "markdown", i, h, "g.md", "general", False, "t0", v, n)
                                  for n, (i, c, h, v) in enumerate(rows)], STORE)


def _l2(spark, rows):
    return spark.createDataFrame(
        [(i, i, "g.md", "markdown", c, h, False, e, n) for n, (i, c, h, e) in enumerate(rows)],
        "chunk_id string, anchor_id string, source_file string, source_type string, content string, heading_path string, "
        "is_manual boolean, user_edited boolean, seq bigint")


def test_sync(spark):
    store = _store(spark, [("a", "one", "H", 1), ("b", "two", "H", 3), ("c", "gone", "", 1), ("d", "same", "K", 1)])
    l2 = _l2(spark, [("a", "one ", "", False), ("b", "TWO", "", False), ("n", "new 参数", "P", False), ("", "x", "", False),
                     ("e", "  ", "", False), ("d", "same", "", True)])
    new, actions = U.sync_chunks(l2, store, True, F.lit("t1"))
    assert sorted((r["id"], r["action"]) for r in actions.collect()) == [
        ("", "skipped"), ("a", "skipped"), ("b", "updated"), ("c", "deleted"), ("d", "updated"), ("e", "skipped"), ("n", "inserted")]
    rows = {r["id"]: r for r in new.collect()}
    assert set(rows) == {"a", "b", "d", "n"}
    assert (rows["b"]["content"], rows["b"]["version"], rows["b"]["heading_path"], rows["b"]["created_at"]) == ("TWO", 4, "H", "t0")
    assert (rows["n"]["version"], rows["n"]["category"], rows["n"]["created_at"]) == (1, "tech_manual", "t1")
    counts = U.diff_counts(l2, store).first()
    assert (counts["new"], counts["changed"], counts["unchanged"], counts["total"]) == (2, 2, 1, 6)


def test_update_rules(spark):
    store = _store(spark, [("a", "one", "H", 1), ("b", "two", "K", 1)])
    edits = spark.createDataFrame([("a", "new", "", 1), ("zz", "x", "P", 2)], "id string, content string, heading_path string, seq bigint")
    rows = {r["id"]: r for r in U.update_chunks(store, edits).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["heading_path"] == "H" and rows["a"]["version"] == 2 and rows["a"]["is_manual"]
    assert rows["b"]["version"] == 1


def test_bindings_are_added_once(spark):
    s = "id string, video_clip_id string, pdf_anchor_id string, note string, created_at bigint"
    old = spark.createDataFrame([("m1", "v", "p", "", 1)], s)
    new = M.bind(old, spark.createDataFrame([("m2", "v", "p", "", 2), ("m3", "v", "q", "", 3), ("m4", "v", "q", "", 4)], s))
    assert sorted(r["id"] for r in new.collect()) == ["m1", "m3"]


def test_transcript_lookup(spark):
    seg = spark.createDataFrame([("v", 1, 0.0, 10.0, "late", False), ("v", 0, 5.0, 200.0, "first", False), ("v", 2, 0.0, 500.0, "clip", True)],
                                "video_file string, seq bigint, start_sec double, end_sec double, text string, is_clip boolean")
    pts = spark.createDataFrame([(1, "v", 5.0), (2, "v", 4.9), (3, "v", 200.0), (4, "v", 201.0), (5, "w", 1.0)],
                                "point_id bigint, video_file string, t double")
    got = {r["point_id"]: r["text"] for r in M.transcript_at(pts, seg, 30.0).collect()}
    assert got == {1: "first", 2: "late", 3: "first", 4: None, 5: None}


def test_transcript_of_segments_of_all_lengths(spark):
    rnd = random.Random(6)
    year = 365 * 86400.0
    rows = [("v", 0, 5.0, year, "a year", False)]
    for k in range(1, 300):
        start = round(rnd.uniform(-10, 4000), 3)
        rows.append((rnd.choice("vw"), k, start, round(start + rnd.choice([0.0, 0.5, 60.0, 61.0, 119.99, 960.0, -3.0, 5000.0]), 3), f"t{k}", rnd.random() < 0.1))
    points = [(k, rnd.choice("vwx"), round(rnd.uniform(-20, 9000), 3)) for k in range(400)] + [(900 + k, r[0], r[2]) for k, r in enumerate(rows)]
    got = M.transcript_at(spark.createDataFrame(points, "point_id bigint, video_file string, t double"), spark.createDataFrame(
        rows, "video_file string, seq bigint, start_sec double, end_sec double, text string, is_clip boolean"), 60.0)
    want = {p: min(((s, x) for f, s, a, b, x, clip in rows if f == v and a <= t <= b and not clip), default=(0, None))[1] for p, v, t in points}
    assert {r["point_id"]: r["text"] for r in got.collect()} == want


def test_chunks_below_headings(spark):
    from quillgraph.plans import search as P2
    paths = ["A", "A > B", "a > bc", "AB", "", None, "É > x", "A > B > C"]
    chunks = spark.createDataFrame([(f"{p}-{k}", p, "c" if k else "d", n * 10 + k) for n, p in enumerate(paths) for k in range(3)],
                                   "id string, heading_path string, category string, seq bigint")
    picks = [("q", "a > b", 1), ("q", "A", 2), ("q", "É", 3), ("r", "zz", 1), ("s", "A > B > C", 5), ("s", "A > B > C > D", 1)]
    sel = spark.createDataFrame(picks, "query_id string, selected_path string, sel_no int")
    for category in (None, "c"):
        got = [(r["query_id"], r["rank"], r["id"]) for r in P2.hits_by_headings(sel, chunks, category).collect()]
        rows = [r for r in chunks.collect() if category in (None, r["category"]) and r["heading_path"] is not None]
        want = []
        for q in "qrs":
            below = sorted(((n, r["heading_path"], r["seq"], r["id"]) for x, p, n in picks if x == q for r in rows
                            if r["heading_path"].replace("A", "a").replace("B", "b").replace("C", "c").startswith(
                                p.replace("A", "a").replace("B", "b").replace("C", "c").replace("D", "d"))),
                           key=lambda x: (x[0], x[1].encode(), x[2]))
            want += [(q, k, x[3]) for k, x in enumerate(below, 1)]
        assert sorted(got) == sorted(want)


def test_chunk_json_files(spark, tmp_path):
    good = {"source_file": "g.pdf", "chunks": [{"chunk_id": "c1", "content": "body", "page": 2}, {"content": "no id"},
                                              {"anchor_id": " a2 ", "content": "x", "display_content": "shown"}]}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "g.chunks.json").write_text(json.dumps(good))
    (tmp_path / "pdf" / "bad.chunks.json").write_text("{broken")
    rows = J.read_chunk_json(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["index"], r["anchor_id"], r["source_type"], r["display_content"], r["page"]) for r in rows] == [
        (1, "c1", "pdf", "body", 2), (3, "a2", "pdf", "shown", 0)]


def test_store_payloads(spark):
    t = spark.createDataFrame([("1", "c", '{"file": "a.pdf", "page": 3}', "{bad"), ("2", "d", None, '{"start": 1.5}')],
                              "id string, content string, pdf_payload string, video_payload string")
    rows = {r["id"]: r for r in J.read_chunk_store(t).collect()}
    assert rows["1"]["pdf_payload"]["file"] == "a.pdf" and rows["1"]["video_payload"]["start"] is None
    assert rows["2"]["pdf_payload"]["file"] is None and rows["2"]["video_payload"]["start"] == 1.5 and rows["2"]["document"] == "d"


def test_review_files_round_trip(spark):
    body = "line\n```\ncode\n```\n- page: 9"
    c = spark.createDataFrame([("g.md", "pdf", "c1", "c1", body, "H > I", 2, 0), ("g.md", "pdf", "c2", "c2", "plain", "", 0, 1)],
                              "source_file string, source_type string, chunk_id string, anchor_id string, content string, heading_path string, page int, seq bigint")
    for name in ("display_content", "embedding_text"):
        c = c.withColumn(name, F.col("content"))
    c = c.withColumn("block_type", F.lit("text")).withColumn("stored", F.lit(True)).withColumn("is_manual", F.lit(False))
    path = scratch_path(spark, "review")
    FS.write_review_markdown(R.render_review_markdown(c, "2024"), path)
    text = "\n".join(r["value"] for r in spark.read.text(path + "/pdf/g.md").collect())
    assert text.startswith("# PDF Chunk Export\n\n- Source file: g.md") and "````text" in text
    parsed = FS.read_review_markdown(spark, path).orderBy("ordinal").collect()
    assert [(r["chunk_id"], r["page"], r["heading_path"], r["content"], r["source_file"]) for r in parsed] == [
        ("c1", 2, "H > I", body, "g.md"), ("c2", 0, None, "plain", "g.md")]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# T\nbody", encoding="utf-8")
    (tmp_path / "b.md").write_text(" \n")
    rows = FS.read_markdown(spark, str(tmp_path)).collect()
    assert [(r["source_file"], r["text"]) for r in rows] == [("a.md", "# T\nbody")]


def test_qa_log(spark):
    answers = spark.createDataFrame([("q", "question", "answer", "llm")], "query_id string, query string, answer string, mode string")
    hits = spark.createDataFrame([("q", 1, "h1", "a1", "pdf", 0.5, "0123456789abcdef tail")],
                                 "query_id string, rank int, id string, anchor_id string, source_type string, distance double, document string")
    rows = P.qa_log_rows(answers, hits, F.lit("t"), 16)
    path = scratch_path(spark, "log")
    FS.append_qa_log(rows, path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    back = FS.read_qa_log(spark, path).collect()
    assert len(back) == 1 and back[0]["retrieved_context"][0]["document"] == "0123456789abcdef..."
    assert back[0]["human_review"]["verdict"] == "unreviewed"
    assert P.qa_log_rows(answers, hits, F.lit("t"), 16, enabled=False).count() == 0


def test_graph_tables(spark):
    path = scratch_path(spark, "graph")
    FS.write_graph(path, communities=spark.createDataFrame([("a", "a")], "id string, community_id string"))
    back = FS.read_graph(spark, path)
    assert back["communities"].count() == 1 and back["nodes"].count() == 0


def test_asr_events(spark):
    lines = ['{"type":"meta","video_file":"v","duration":0}', "loading", '{"type":"segment","video_file":"v","segment":{"start":0,"end":0.4,"text":"a"}}',
             '{"type":"error","video_file":"w","message":"boom"}', '{"type":"done","video_file":"u"}']
    e = asr.asr_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert asr.segments(e).count() == 1 and asr.errors(e).first()["message"] == "boom"
    assert {r["video_file"]: r["progress"] for r in asr.asr_progress(e).collect()} == {"v": 0.4, "u": 1.0, "w": 0.0}


def test_citations_and_preview(spark):
    from quillgraph.functions import hits as H
    from quillgraph.plans import search as R2
    hits = spark.createDataFrame([("q", 1, "i1", "a1", "pdf", "# Title\nbody api"), ("q", 2, "v1", "a1", "video", "clip")],
                                 "query_id string, rank int, id string, anchor_id string, source_type string, content string")
    a = spark.createDataFrame([("q", "x [2] y [1] [7]")], "query_id string, answer string")
    got = [r["target"] for r in R2.resolve_citations(a, hits).orderBy("cite_no").collect()]
    assert got == ["video://v1", "anchor://a1", None]
    q = spark.createDataFrame([("q", "api")], "query_id string, query string")
    first = H.preview_rows(hits, q).orderBy("rank").first()
    assert first["title"] == "Title" and first["meta"] == "PDF" and first["body"].endswith("<mark>api</mark>")


def test_routed_search_rounds(spark):
    from quillgraph.plans import router as RT
    chunks = spark.createDataFrame(
        [("p1", "proc one", "P", "process", 1), ("g1", "gen one", "G", "general", 2), ("g2", "gen two find me", "G > H", "general", 3)],
        "id string, content string, heading_path string, category string, seq bigint")
    routed = spark.createDataFrame(
        [("ok", "process", "x"), ("widen", "process", "x"), ("extra", "general", "find me"), ("none", "parameter", "nothing here"),
         ("text", "process", "gen one"), ("stub", "general", "proc one")],
        "query_id string, category string, standalone_query string")
    pick = '{"selected_indices": [1]}'
    rows = [("ok", 1, "locate", pick), ("ok", 1, "validate", '{"valid": true}'),
            ("widen", 1, "locate", pick), ("widen", 1, "validate", '{"valid": false}'), ("widen", 2, "locate", pick), ("widen", 2, "validate", "odd"),
            ("extra", 1, "locate", '{"indices": [2, 9]}'), ("extra", 1, "validate", '{"valid": false, "missing": "one"}'),
            ("text", 1, "validate", '{"valid": true}'), ("stub", 1, "locate", "{}")]
    decisions = spark.createDataFrame(rows, "query_id string, round int, phase string, raw string")
    hits, outcome = RT.routed_search(routed, chunks, decisions)
    got = {r["query_id"]: (r["category"], r["attempts"], r["validated"]) for r in outcome.collect()}
    assert got == {"ok": ("process", 1, True), "widen": ("general", 2, True), "extra": ("general", 1, False),
                   "none": ("general", 2, False), "text": ("process", 1, True), "stub": ("general", 1, True)}
    by = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["id"], r["via"]))
    assert by == {"ok": [("p1", "heading")], "widen": [("g1", "heading"), ("g2", "heading")],
                  "extra": [("g2", "heading"), ("g1", "supplement"), ("p1", "supplement")],
                  "text": [("g1", "text")], "stub": [("p1", "text")]}


def test_router_steps_resume_from_written_state(spark, tmp_path):
    from quillgraph.plans import router as RT
    chunks = spark.createDataFrame(
        [("p1", "proc one", "P", "process", 1), ("g1", "gen " + "x" * 400, "G", "general", 2), ("g2", "gen two", "G > H", "general", 3)],
        "id string, content string, heading_path string, category string, seq bigint")
    routed = spark.createDataFrame([("a", "process", "x"), ("b", "parameter", "see h"), ("c", "process", "zzz")],
                                   "query_id string, category string, standalone_query string")
    answers = lambda *rows: spark.createDataFrame(list(rows), "query_id string, raw string")
    state = RT.start_router(routed)
    requests, lists = RT.locate_requests(state, chunks)
    assert {(r["query_id"], r["round"], r["list_id"]) for r in requests.collect()} == {
        ("a", 1, "category:process"), ("b", 1, "query:b"), ("c", 1, "category:process")}
    offered = {}
    for r in lists.orderBy("list_id", "position").collect():
        offered.setdefault(r["list_id"], []).append((r["position"], r["heading_path"]))
    assert offered == {"category:process": [(1, "P")], "query:b": [(1, "G"), (2, "G > H"), (3, "P")]}
    located = RT.locate_step(state, chunks, answers(("a", '{"indices": [1]}'), ("c", "no")))
    RT.write_router_state(located, str(tmp_path / "located"))
    again = RT.read_router_state(spark, str(tmp_path / "located"))
    assert again.round == 1 and again.hits is None
    asked = RT.validate_requests(again).collect()
    assert [(r["query_id"], r["rank"], r["heading_path"], r["content"]) for r in asked] == [("a", 1, "P", "proc one")]
    verdicts = answers(("a", '{"valid": false}'))
    steps = [RT.validate_step(at, chunks, verdicts) for at in (located, again, again)]
    for step in steps:
        assert step.round == 2 and step.found is None and step.hits.count() == 0
        assert {(r["query_id"], r["category"]) for r in step.open.collect()} == {("a", "general"), ("b", "general"), ("c", "general")}
    second = RT.locate_step(steps[1], chunks, answers(("a", '{"indices": [1]}')))
    assert all(len(r["content"]) <= 300 for r in RT.validate_requests(second).collect())
    RT.write_router_state(second, str(tmp_path / "second"))
    last = RT.validate_step(RT.read_router_state(spark, str(tmp_path / "second")), chunks, answers(("a", "unreadable")))
    assert last.open.isEmpty() and [(r["id"], r["rank"]) for r in last.hits.orderBy("rank").collect()] == [("g1", 1), ("g2", 2)]
    assert {(r["query_id"], r["attempts"], r["validated"]) for r in last.outcome.collect()} == {
        ("a", 2, True), ("b", 2, False), ("c", 2, False)}


def test_tags_and_routes(spark):
    from quillgraph.plans import router as RT
    q = spark.createDataFrame([("a", "x api", "x api"), ("b", "y", "y"), ("c", "z", "z")], "query_id string, query string, condensed string")
    d = spark.createDataFrame([("a", "none"), ("b", 'k {"category": "nope", "standalone_query": " s "}'), ("c", '{"category": "process"}')],
                              "query_id string, raw string")
    got = {r["query_id"]: (r["category"], r["standalone_query"], r["router_source"]) for r in RT.apply_route_decisions(q, d).collect()}
    assert got == {"a": ("tech_manual", "x api", "heuristic"), "b": ("general", "s", "llm"), "c": ("general", "z", "heuristic")}


def test_export_takes_fields_from_the_payload(spark):
    payload = {"file": "g.md", "page": 3, "coords": [1.0, 2.0], "heading_path": "From > Payload", "block_type": "table",
               "display_content": "shown", "embedding_text": "embedded", "metadata": {"title": "t"}}
    rows = [("a", "x", "", "", json.dumps(payload)), ("b", "y", "Own", "g.md", json.dumps(payload)), ("c", "z", "", "g.md", "broken"),
            ("d", "w", "", "other.md", json.dumps(payload))]
    raw = spark.createDataFrame([(i, c, "markdown", i, h, f, "general", False, "t0", 1, n, p)
                                 for n, (i, c, h, f, p) in enumerate(rows)], STORE + ", pdf_payload string")
    decoded = J.read_chunk_store(raw.withColumn("video_payload", F.lit(None).cast("string"))).drop("video_payload", "document")
    for store in (raw, decoded):
        lines = [r["line"] for r in J.export_store_to_json(store, "dir/g.md", "now").orderBy("pos").collect()]
        got = {c["chunk_id"]: c for c in json.loads("\n".join(lines))["chunks"]}
        assert sorted(got) == ["a", "b", "c"]
        assert [got[i]["heading_path"] for i in "abc"] == ["From > Payload", "Own", ""]
        a, c = got["a"], got["c"]
        assert (a["page"], a["coords"], a["block_type"], a["display_content"], a["embedding_text"], a["metadata"]["title"]) == (
            3, [1.0, 2.0], "table", "shown", "embedded", "t")
        assert (c["page"], c["coords"], c["block_type"], c["display_content"], c["embedding_text"]) == (0, [], "text", "z", "z")
