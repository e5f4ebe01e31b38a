"""Steps whose cost must follow the input: what is shuffled and read again, with results against plain statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import traversal as TR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_half_sweep_reads_edges_of_movers_only(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(20)], "src string, dst string, weight double")
    near = TR.both_ways(edges)
    state = near.groupBy(F.col("node").alias("id")).agg(F.sum("weight").alias("k")).select(
        "id", F.col("id").alias("community_id"), "k")
    step = TR._move_half(near, state, 40.0, 0, 1)
    movers = {r["id"] for r in state.filter("pmod(xxhash64(id, 0), 2) = 1").collect()}
    moved = {r["id"] for r in step.filter("old <> community_id").collect()}
    assert moved and moved <= movers and step.count() == 21
    now = step.select("id", "community_id", "k")
    assert abs(TR._state_modularity(edges, now, 40.0) - TR.modularity(edges, now).first()[0]) < 1e-12


def test_bfs_makes_neighbours_once(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string").withColumn("weight", F.lit(1.0))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    counted = edges.coalesce(1).mapInArrow(count, edges.schema)
    starts = spark.createDataFrame([("q", "n0")], "query_id string, id string")
    visited, _ = TR.bfs(counted, starts, 4)
    assert sorted((r["id"], r["depth"]) for r in visited.collect()) == [(f"n{i}", i) for i in range(5)]
    assert seen.value == 9


def test_heading_hits_place_chunks_once_for_all_questions(spark, monkeypatch):
    from quillgraph.plans import search as P
    placed = []
    inner = P.position_in_group

    def counted(df, *args, **kwargs):
        placed.append(df.count())
        return inner(df, *args, **kwargs)
    monkeypatch.setattr(P, "position_in_group", counted)
    paths = ["a", "a > x", "a > y", "b"]
    chunks = [(f"c{i}", paths[i % 4], i) for i in range(40)]
    sel = [(f"q{k}", n, p) for k in range(9) for n, p in enumerate(["A >", "b"][::1 - 2 * (k % 2)])]
    got = P.hits_by_headings(spark.createDataFrame(sel, "query_id string, sel_no int, selected_path string"),
                             spark.createDataFrame(chunks, "id string, heading_path string, seq long"))
    want = set()
    for q in {s[0] for s in sel}:
        rows = [c for s in sel if s[0] == q for c in sorted(
            (c for c in chunks if c[1].startswith(s[2].lower())), key=lambda c: (c[1], c[2]))]
        want |= {(q, r, c[0]) for r, c in enumerate(rows, 1)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want and len(want) == 9 * 30
    assert sum(placed) <= len(chunks) + 3 * 9


def test_located_rows_end_where_no_step_reads_them(spark, monkeypatch):
    from quillgraph.plans import router as RT
    chunks = spark.createDataFrame(
        [(f"c{i:02d}", "general" if i in (2, 30) else "process", "a", f"the text {i}", i) for i in range(40)],
        "id string, category string, heading_path string, content string, seq long")
    routed = spark.createDataFrame([("q1", "general", "none of it"), ("q2", "process", "none of it")],
                                   "query_id string, category string, standalone_query string")
    answers = [(q, n, phase, raw) for q in ("q1", "q2") for n in (1, 2, 3) for phase, raw in (
        ("locate", '{"indices": [1]}'), ("validate", '{"valid": false, "missing": "the"}'))]
    decisions = spark.createDataFrame(answers, "query_id string, round int, phase string, raw string")
    short = [sorted(map(tuple, df.collect())) for df in RT.routed_search(routed, chunks, decisions)]
    step = RT.locate_step
    state = RT.start_router(routed)
    assert step(state, chunks, decisions.filter("round = 1 and phase = 'locate'").select("query_id", "raw"), 5).found.count() == 3 + 5 - 1
    monkeypatch.setattr(RT, "locate_step", lambda s, c, a, read=None: step(s, c, a))
    assert short == [sorted(map(tuple, df.collect())) for df in RT.routed_search(routed, chunks, decisions)]


def test_node_queries_cut_documents_into_lines_once(spark, monkeypatch):
    from quillgraph.catalog import adapters as X, search
    from quillgraph.operators import scoring as S
    for name in ("find_nodes", "score_nodes", "fuzzy_scores"):
        made = []
        whole = X.chunks_t
        monkeypatch.setattr(X, "chunks_t", lambda s, d: made.append(whole(s, d)) or made[-1])
        texts = []
        inner = S.distinct_texts if name == "find_nodes" else S.counted_texts
        monkeypatch.setattr(S, inner.__name__, lambda nodes: texts.append(nodes) or inner(nodes))
        search.QUERIES[name](spark, "/root/testdata/sf0.001")
        monkeypatch.undo()
        assert len(made) == 1 and not any("documents.parquet" in f for f in texts[0].inputFiles()), name


def test_review_pieces_and_nodes_travel_without_copies_of_the_content(spark, monkeypatch):
    from quillgraph.operators import graph as G, review as R
    seen = []
    inner = R.position_in_group
    monkeypatch.setattr(R, "position_in_group", lambda df, *args: seen.append(df.columns) or inner(df, *args))
    chunks = spark.createDataFrame([("f", "markdown", 1, "a", "x " * 9, "x " * 9, "", "general")], "source_file string, source_type string, seq long, "
                                   "chunk_id string, content string, display_content string, heading_path string, category string").selectExpr(
        "*", "1 AS page", "'t' AS block_type", "true AS stored", "'a' AS anchor_id", "false AS is_manual", "chunk_id AS id", "source_file AS payload_file")
    got = [r["markdown"] for r in R.render_review_markdown(chunks, "now").orderBy("piece").collect()]
    assert "- Chunk count: 1\n" in got[0] and got[1].startswith("## Chunk 1\n\n- chunk_id: a\n") and seen == [["source_file", "source_type", "seq", "_body"]]
    for incremental in (False, True):
        plan = G.build_nodes(chunks, incremental)._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan[:plan.index("Window")]
        assert not [line for line in plan.splitlines() if "Window" in line and "content" in line]


def test_sync_makes_rows_and_store_once(spark):
    from quillgraph.operators import store as U
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    l2 = spark.createDataFrame([("s.md", "a", "a", "new", "", "markdown", False, 1), ("s.md", "b", "b", "same", "", "markdown", False, 2),
                                ("s.md", "c", "c", "more", "", "markdown", False, 3)],
                               "source_file string, chunk_id string, anchor_id string, content string, heading_path string, source_type string, is_manual boolean, seq long")
    store = spark.createDataFrame([("a", "old", "markdown", "a", "", "s.md", "general", False, "then", 1, 1),
                                   ("b", "same", "markdown", "b", "", "s.md", "general", False, "then", 1, 2)],
                                  "id string, content string, source_type string, anchor_id string, heading_path string, payload_file string, "
                                  "category string, is_manual boolean, created_at string, version int, seq long")
    after, actions = U.sync_chunks(l2.coalesce(1).mapInArrow(count, l2.schema), store, True, F.lit("now"))
    assert {(r["id"], r["content"], r["version"], r["created_at"]) for r in after.collect()} == {
        ("a", "new", 2, "then"), ("b", "same", 1, "then"), ("c", "more", 1, "now")}
    assert {(r["id"], r["action"]) for r in actions.collect()} == {("a", "updated"), ("b", "skipped"), ("c", "inserted")}
    assert seen.value == 3


def test_communities_are_searched_by_numbers(spark, monkeypatch):
    seen = []
    inner = TR._move_half
    monkeypatch.setattr(TR, "_move_half", lambda near, state, *args: seen.append((near.dtypes, state.dtypes)) or inner(near, state, *args))
    # two rings of text ids joined by one edge, a node without edges, and an edge to a node that is not listed
    rings = [(f"{r}{i}", f"{r}{(i + 1) % 5}") for r in "ab" for i in range(5)] + [("a0", "b0"), ("b1", "zz")]
    edges = spark.createDataFrame([(*p, 1.0) for p in rings], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"{r}{i}",) for r in "ab" for i in range(5)] + [("c",)], "id string")
    got = {r["id"]: r["community_id"] for r in TR.modularity_communities(nodes, edges).collect()}
    assert got.keys() == {r[0] for r in nodes.collect()} and got["c"] == "c"
    assert all(min(i for i in got if got[i] == c) == c for c in got.values()) and got["a2"] != got["b2"]
    assert seen and all(dict(near) == {"node": "bigint", "neighbor": "bigint", "weight": "double"} for near, _ in seen)
    assert all(dict(state)["id"] == dict(state)["community_id"] == "bigint" for _, state in seen)
    alone = edges.selectExpr("explode(array(src, dst)) AS id").distinct().selectExpr("id", "id AS community_id")
    assert abs(TR._alone(edges, 24.0) - TR.modularity(edges, alone).first()[0]) < 1e-12
