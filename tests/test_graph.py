import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G, matching as M, ordering as O, scoring as S, traversal as TR
from quillgraph.plans import search as R
from tests import models

NODE = "id string, label string, source_file string, category string, heading_path string, node_seq bigint"
EDGE = "src string, dst string, relation string, confidence string, confidence_score double, source_file string, weight double"


def edges_of(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), "references", "EXTRACTED", 1.0, "", 1.0) for p in pairs], EDGE)


def nodes_of(spark, ids, source="s"):
    return spark.createDataFrame([(i, i, source, "general", "", n) for n, i in enumerate(ids)], NODE)


def pairs(df):
    return {frozenset((r["src"], r["dst"])) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 5, 6, 11, 12, 30])
def test_category_edges_closed_form(spark, n):
    ids = [f"n{i:03d}" for i in range(n)]
    df = G.category_edges(nodes_of(spark, ids), hot_rows=4)
    assert pairs(df) == models.category_links(ids, []) and df.count() == len(pairs(df))


def test_category_edges_with_prior_edges(spark):
    """Random groups, trees with big parents and cliques, all in one job."""
    rnd = random.Random(11)
    rows, prior, want = [], [], set()
    for g in range(14):
        n = rnd.randrange(2, 45)
        ids = [f"g{g:02d}-{i:03d}" for i in range(n)]
        rows += [(x, x, f"src{g}", "general", "", i) for i, x in enumerate(ids)]
        if g % 3 == 0:
            mine = [(ids[rnd.randrange(0, max(i, 1))], ids[i]) for i in range(1, n) if rnd.random() < 0.7]
        elif g % 3 == 1:
            hub = rnd.randrange(n)
            mine = [(ids[hub], ids[i]) for i in range(min(n, 30)) if i != hub]
        else:
            mine = [(ids[a], ids[b]) for a in range(min(n, 9)) for b in range(a) if rnd.random() < 0.8]
        mine = [p for p in mine if p[0] != p[1]]
        prior += mine
        want |= models.category_links(ids, mine)
    nodes = spark.createDataFrame(rows, NODE)
    assert pairs(G.category_edges(nodes, edges_of(spark, prior))) == want


def test_incremental_category_edges(spark):
    ids = [f"n{i:02d}" for i in range(20)]
    got = pairs(G.category_edges_incremental(nodes_of(spark, ids)))
    assert got == {frozenset((ids[a], ids[b])) for a in range(5) for b in range(a + 1, 20)}


def test_heading_and_sequence_edges(spark):
    rows = [("a", "A"), ("b", "A > B"), ("c", "A > B > C"), ("d", "A>B"), ("e", "A > B"), ("f", "")]
    nodes = spark.createDataFrame([(i, i, "g.pdf", "tech_manual", h, n) for n, (i, h) in enumerate(rows)], NODE)
    assert pairs(G.heading_edges(nodes)) == {frozenset("ab"), frozenset("bc")}
    assert pairs(G.sequence_edges(nodes)) == {frozenset("fa"), frozenset("ab"), frozenset("be"), frozenset("ec"), frozenset("cd")}


def test_build_graph_from_two_chunks_and_precedence(spark):
    chunks = spark.createDataFrame(
        [("1", "x", "A > B", "tech_manual", "guide.pdf", 1), ("2", "y", "A > B > C", "tech_manual", "guide.pdf", 2),
         ("3", "z", "", "odd", "guide.pdf", 3)],
        "id string, content string, heading_path string, category string, payload_file string, seq bigint")
    nodes, edges = G.build_graph(chunks)
    assert nodes.count() == 2 and [(r["relation"], r["weight"]) for r in edges.collect()] == [("references", 1.0)]
    # an added source keeps nodes of any category, so order links the third chunk as well
    added, last = G.build_graph(chunks, None, "last")
    assert added.count() == 3 and sorted((r["src"], r["dst"], r["relation"], r["weight"]) for r in last.collect()) == [
        ("1", "2", "references", 0.3), ("1", "3", "references", 0.3)]


def test_remove_source(spark):
    nodes = spark.createDataFrame([("x1", "x1", "doc1.pdf", "general", "", 1), ("x2", "x2", "doc1.pdf", "general", "", 2),
                                   ("y1", "y1", "doc2.pdf", "general", "", 3)], NODE)
    kept, edges, removed = G.remove_source(nodes, edges_of(spark, [("x1", "x2"), ("x2", "y1")]),
                                           spark.createDataFrame([("doc1.pdf",)], "source_file string"))
    assert [r["id"] for r in kept.collect()] == ["y1"] and edges.count() == 0 and removed.first()["removed"] == 2


def test_bfs_chain_and_cap(spark):
    chain = [("a", "b"), ("b", "c"), ("c", "d")]
    starts = spark.createDataFrame([("q", "a")], "query_id string, id string")
    visited, walked = TR.bfs(edges_of(spark, chain), starts, 3)
    assert visited.count() == 4 and walked.count() == 3
    rnd = random.Random(4)
    ids = [f"v{i}" for i in range(40)]
    graph = {tuple(sorted(rnd.sample(ids, 2))) for _ in range(60)}
    begin = {f"q{k}": rnd.sample(ids, 2) for k in range(8)}
    starts = spark.createDataFrame([(q, i) for q, s in begin.items() for i in s], "query_id string, id string")
    visited, walked = TR.bfs(edges_of(spark, graph), starts, 3, 12)
    v, w = visited.collect(), walked.collect()
    for q, s in begin.items():
        seen, steps = models.bfs(graph, s, 3, 12)
        assert {r["id"] for r in v if r["query_id"] == q} == seen
        assert sorted((r["from_id"], r["to_id"]) for r in w if r["query_id"] == q) == sorted(steps)


def test_components(spark):
    ids = ["a1", "a2", "a3", "b1", "b2", "b3", "solo"]
    comm = TR.connected_components(nodes_of(spark, ids), edges_of(spark, [("a1", "a2"), ("a2", "a3"), ("b1", "b2"), ("b2", "b3")]))
    assert {r["id"]: r["community_id"] for r in comm.collect()} == {
        "a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1", "solo": "solo"}


def test_modularity_communities_beat_singletons(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    edges = edges_of(spark, cliques)
    nodes = nodes_of(spark, sorted({x for p in cliques for x in p}))
    comm = TR.modularity_communities(nodes, edges)
    alone = nodes.select("id", F.col("id").alias("community_id"))
    assert TR.modularity(edges, comm).first()[0] > TR.modularity(edges, alone).first()[0] + 0.3
    assert comm.count() == 10


def test_modularity_communities_run_to_the_end(spark):
    path = edges_of(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(399)])
    comm = TR.modularity_communities(nodes_of(spark, [f"n{i:03d}" for i in range(400)]), path)
    assert TR.modularity(path, comm).first()[0] >= 0.88
    found = {r["id"]: r["community_id"] for r in comm.collect()}
    order = [found[f"n{i:03d}"] for i in range(400)]
    assert len(order) == 400 and len(set(order)) == 1 + sum(a != b for a, b in zip(order, order[1:]))  # each is connected


def test_ring_of_cliques(spark):
    inner = [(f"q{k}_{i}", f"q{k}_{j}") for k in range(8) for j in range(6) for i in range(j)]
    ring = inner + [tuple(sorted((f"q{k}_0", f"q{(k + 1) % 8}_1"))) for k in range(8)]
    nodes = nodes_of(spark, sorted({x for p in ring for x in p}))
    found = {r["id"]: r["community_id"] for r in TR.modularity_communities(nodes, edges_of(spark, ring)).collect()}
    assert {x: found[f"{x[:2]}_0"] for x in found} == found and len(set(found.values())) == 8


def test_components_of_chain_and_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"leaf{i}") for i in range(400)]
    got = {r["node"]: r["label"] for r in TR.component_labels(edges_of(spark, chain + star).select("src", "dst")).collect()}
    assert {v for k, v in got.items() if k.startswith("c")} == {"c000"} and {v for k, v in got.items() if k[0] in "hl"} == {"hub"}
    assert len(got) == 121 + 401


def test_scores_match_model(spark):
    rnd = random.Random(9)
    words = ["configuration", "network", "参数", "port", "guide", "api", "setup", "机器", "mtu", "x1"]
    rows = []
    for n in range(60):
        path = " > ".join(rnd.sample(words, rnd.randrange(0, 3)))
        rows.append((f"n{n}", (path or rnd.choice(words)) + " [general]", "s", "general", path, n))
    nodes = spark.createDataFrame(rows, NODE)
    asked = ["network guide", "configration", "zz qq", "参数 mtu", "general", "p", "port port api"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id bigint, query string")
    terms = {r["query_id"]: r["terms"] for r in S.with_match_terms(queries).collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in S.score_nodes(queries, nodes).collect()}
    want = {(q, r[0]): models.node_score(t, r[1].lower(), r[4].lower(), r[3]) for q, t in terms.items() for r in rows}
    assert got == {k: v for k, v in want.items() if v > 0}
    top = S.find_nodes(queries, nodes, 3).collect()
    order = {r[0]: r[5] for r in rows}
    for q in terms:
        best = sorted((k for k in got if k[0] == q), key=lambda k: (-got[k], order[k[1]]))[:3]
        assert [r["id"] for r in sorted((r for r in top if r["query_id"] == q), key=lambda r: r["rank"])] == [b[1] for b in best]
    feats = S.lowered_fields(nodes).withColumn("degree", F.lit(0)).withColumn("cohesion", F.lit(0.0))
    visited = queries.filter("query_id = 0").select("query_id").join(nodes.select("id"), how="inner", on=F.lit(True))
    ranked = {r["id"]: r["score"] for r in S.rank_nodes(visited, queries, feats).collect()}
    assert ranked == {r[0]: 2 * models.node_score(["network", "guide"], r[1].lower(), r[4].lower(), r[3]) for r in rows}


def test_misspelled_question_finds_its_node(spark):
    nodes = spark.createDataFrame([("n", "configuration settings", "s", "general", "", 1), ("m", "other", "s", "general", "", 2)], NODE)
    q = spark.createDataFrame([(1, "configration")], "query_id bigint, query string")
    assert S.find_nodes(q, nodes, 1).first()["id"] == "n"
    fuzzy = S.fuzzy_scores(q, nodes).collect()
    assert [(r["id"], round(r["similarity"], 6)) for r in fuzzy] == [("n", round(1 - 1 / 13, 6))]


def test_blocks_cover_all_questions_and_texts(spark, monkeypatch):
    nodes = nodes_of(spark, [f"word{i}" for i in range(12)])
    q = spark.createDataFrame([(i, f"word{i}") for i in range(12)], "query_id bigint, query string")
    want = {i: f"word{i}" if i > 1 else "word1" if i == 1 else "word0" for i in range(12)}
    for texts, questions in ((4, 3), (1, 100), (100, 1)):
        monkeypatch.setattr(M, "TEXT_BLOCK", texts)
        monkeypatch.setattr(M, "QUESTION_BLOCK", questions)
        assert {r["query_id"]: r["id"] for r in S.find_nodes(q, nodes, 1).collect()} == want


def test_best_pairs_need_only_terms_and_are_those_of_the_whole_list(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["net", "network", "port", "po", "guide", "api", "参数", "mtu", "x1"]
    texts = [(0, n, " ".join(rnd.choices(words, k=rnd.randrange(1, 4))), rnd.choice(["", "net", "guide"]), "general",
              rnd.choice([0.0, 0.25, 1.5]), rnd.choice([0.0, 0.5]), 100 - n) for n in range(40)]
    asked = [(0, q, rnd.sample(words + ["zz qq", "tw", "epo"], 3)) for q in range(11)]
    t = spark.createDataFrame(texts, "group_id int, text_id bigint, label string, heading string, category string, bonus_a double, bonus_b double, seq bigint")
    q = spark.createDataFrame(asked, "group_id int, query_id bigint, terms array<string>")
    for name, size in (("TEXT_BLOCK", 17), ("QUESTION_BLOCK", 6), ("SLICE", 4), ("PART", 5)):
        monkeypatch.setattr(M, name, size)
    for factor, every in ((1.0, False), (2.0, True)):
        listed = M.score_in_groups(q, t, None, factor, every).collect()
        assert {(r["query_id"], r["text_id"]): r["relevance"] for r in listed} == {
            (a[1], b[1]): score for a in asked for b in texts if (score := models.node_score(a[2], b[2], b[3], b[4])) > 0 or every}
        place = lambda r: (-(r["relevance"] * factor + texts[r["text_id"]][5] + texts[r["text_id"]][6]), texts[r["text_id"]][7])
        first = lambda rows, n: sorted((r for r in rows if r["query_id"] == n), key=place)[:3]
        best = M.score_in_groups(q, t, 3, factor, every).collect()
        assert all([tuple(r) for r in first(best, a[1])] == [tuple(r) for r in first(listed, a[1])] for a in asked)


def test_score_counts_add_up_the_list_of_scores(spark, monkeypatch):
    nodes = nodes_of(spark, ["network guide"] * 5 + ["config port", "nothing", "api setup", "mtu 参数"])
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["network guide", "configration", "zz qq", "参数", "", "p", "port port api"])],
                              "query_id bigint, query string")
    want = {(r["query_id"], r["score"]): r["count"] for r in S.score_nodes(q, nodes).groupBy("query_id", "score").count().collect()}
    for texts, part in ((2, 2_048), (16_384, 3)):
        monkeypatch.setattr(M, "TEXT_BLOCK", texts)
        monkeypatch.setattr(M, "PART", part)
        assert {(r["query_id"], r["score"]): r["n"] for r in S.score_counts(q, nodes).collect()} == want


def test_similar_strings_are_all_found(spark):
    rnd = random.Random(5)
    strings = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 9))) for _ in range(260)} | {"configuration", "configration", "工控机IP", "工控IP"}
    terms, tokens = sorted(strings)[::2], sorted(strings)
    found = M.similar_strings(spark.createDataFrame([(t,) for t in terms], "term string"),
                              spark.createDataFrame([(t,) for t in tokens], "token string"), 0.7).collect()
    pairs = spark.createDataFrame([(a, b) for a in terms for b in tokens], "term string, token string")
    alike = 1.0 - F.levenshtein("term", "token") / F.greatest(F.length("term"), F.length("token"))
    want = pairs.withColumn("similarity", alike).filter("similarity >= 0.7").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) > len(terms)


def test_fuzzy_counts_add_up_the_list_of_scores(spark, monkeypatch):
    nodes = nodes_of(spark, ["network guide"] * 5 + ["config port", "nothing", "api setup", "netwerk configuration 参数", "portt"])
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["network guide", "configration", "zz qq", "参数", "", "p", "port port api"])],
                              "query_id bigint, query string")
    listed = S.fuzzy_scores(q, nodes).groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best")).collect()
    assert {r["query_id"] for r in listed} == {0, 1, 3, 6}
    for texts, part in ((2, 2_048), (16_384, 3)):
        monkeypatch.setattr(M, "TEXT_BLOCK", texts)
        monkeypatch.setattr(M, "PART", part)
        assert sorted(map(tuple, S.fuzzy_counts(q, nodes).collect())) == sorted(map(tuple, listed))


def test_nodes_of_one_text_share_its_score(spark):
    nodes = nodes_of(spark, ["same"] * 30 + ["other same", "nothing"])
    q = spark.createDataFrame([(1, "same"), (2, "zzz"), (3, "")], "query_id bigint, query string")
    got = S.find_nodes(q, nodes, 4).orderBy("rank").collect()
    every = S.score_nodes(q, nodes).filter("query_id = 1").orderBy(F.desc("score"), "node_seq").limit(4).collect()
    assert [r["id"] for r in got if r["query_id"] == 1] == [r["id"] for r in every] and {r["query_id"] for r in got} == {1}


def test_phrases_by_pieces(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6)))
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(0, 9))), None if i % 7 == 0 else rnd.choice(
        ["a b", "cab  abc", "x\ny z", "中文字符串", ""])) for i in range(300)]
    phrases = ["a", "ab", "abc", "c b", "ab a", "abcab c", "a b c", "abc ab a", "zz", "b b b b", "x\ny", "中文", "字", "aé", "y z", "x y z", "ab c"]
    df = spark.createDataFrame(texts, "id long, t string, u string").withColumn("extra", F.lit(1))
    asked = spark.createDataFrame([(p,) for p in [*phrases, "", None, "a"]], "phrase string")
    got = sorted((r["phrase"], r["id"], r["extra"]) for r in M.phrase_matches(asked, df, ["t", "u"]).collect())
    assert got == sorted((p, i, 1) for p in phrases for i, t, u in texts if p in t or (u and p in u))
    assert M.phrase_matches(asked, df.limit(0), ["t", "u"]).count() == M.phrase_matches(asked.limit(0), df, ["t", "u"]).count() == 0


def test_hub_steps_are_not_written_out(spark):
    """Hubs of shared and of own groups, long paths between them; the same hits as with every visited node listed."""
    rnd = random.Random(8)
    words = ["net", "cable", "guide", "setup", "disk", "fan", "port", "led"]
    ids = [f"n{i:03d}" for i in range(260)]
    nodes = spark.createDataFrame([(i, f"{rnd.choice(words)} {rnd.choice(words)}", f"s{k % 3}", "general", rnd.choice(["", "Net > Setup", "Disk"]), k)
                                   for k, i in enumerate(ids)], NODE)
    links = {(ids[h], i) for h in (0, 1, 2) for i in ids[3:90]} | {(ids[90], i) for i in ids[91:170]}
    links |= {(ids[k], ids[k + 1]) for k in range(170, 259)} | {(ids[89], ids[91]), (ids[40], ids[200])}
    edges = edges_of(spark, sorted(links))
    graph = R.prepare_graph(nodes, edges)
    q = spark.createDataFrame([(k, f"{rnd.choice(words)} {rnd.choice(words)} {w}") for k, w in enumerate(words * 3)],
                              "query_id bigint, query string")
    starts = spark.createDataFrame([(k, rnd.choice(ids)) for k in range(24) for _ in range(rnd.randrange(1, 5))], "query_id bigint, id string")
    near = G.both_ways(edges).select("node", "neighbor").distinct()
    hubs = near.groupBy("node").count().filter("count >= 50")
    assert {r["node"] for r in hubs.collect()} == {ids[0], ids[1], ids[2], ids[90]}
    visited, steps = TR.bounded_bfs(near, hubs, starts, 3, 50)
    all_visited, _ = TR.bfs(edges, starts, 3, 50)
    by_hub = steps.join(near.withColumnRenamed("node", "hub"), "hub").select("query_id", F.col("neighbor").alias("id"))
    assert set(map(tuple, visited.select("query_id", "id").union(by_hub).collect())) == set(map(tuple, all_visited.select("query_id", "id").collect()))
    assert visited.groupBy("query_id").count().agg(F.max("count")).first()[0] < 50
    of_node, of_cell = TR.hub_cells(near, hubs)
    assert of_node.groupBy("id").count().filter("count > 1").isEmpty() and of_cell.select("cell").distinct().count() < 8
    cells = steps.join(of_cell, "hub").select("query_id", "cell").distinct()
    for k in (1, 5):
        got = S.top_k_nodes(S.rank_with_hubs(visited, cells, S.cell_texts(of_node, graph.features, k), q, graph.features, k), k)
        want = S.top_k_nodes(S.rank_nodes(all_visited, q, graph.features), k)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
        assert rows(got) == rows(want)


def test_questions_without_a_node_are_answered_by_text(spark):
    nodes = nodes_of(spark, ["alpha one", "beta two"])
    chunks = nodes.select("id", F.lit("some QQ WW words").alias("content"), "heading_path", "category", F.col("node_seq").alias("seq"))
    no_edges = edges_of(spark, [("x", "y")]).limit(0)
    graph = R.prepare_graph(nodes.withColumn("chunk_id", F.col("id")), no_edges)
    q = spark.createDataFrame([("node", "alpha"), ("text", "qq ww"), ("none", "#")], "query_id string, query string")
    hits, summary = R.graph_search(q, graph, chunks, 1)
    assert sorted((r["query_id"], r["router_source"]) for r in hits.collect()) == [("node", "graph_traversal"), ("text", "text_search_fallback")]
    assert {r["query_id"]: (r["router_source"], r["validated"]) for r in summary.collect()} == {
        "node": ("graph_traversal", True), "text": ("text_search_fallback", False), "none": ("text_search_fallback", False)}


def test_positions_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                  (F.hash("id") % 1000).alias("o"), "id")
    got = O.position_in_group(df, ["k"], ["o", "id"], "pos").toPandas().sort_values(["k", "o", "id"])
    assert (got.groupby("k").cumcount() == got["pos"]).all() and len(got) == 5000
    prev = O.with_previous(spark.createDataFrame(got), ["k"], "pos", 2, ["id"], "p", bucket=64).toPandas().sort_values(["k", "pos"])
    for k, part in prev.groupby("k"):
        ids = list(part["id"])
        assert [[r["id"] for r in x] for x in part["p"]] == [ids[max(0, i - 2):i] for i in range(len(ids))]
    marked = O.last_marked_position(spark.createDataFrame(got), ["k"], "pos", F.col("id") % 97 == 0, "m", bucket=64).toPandas()
    for k, part in marked.sort_values(["k", "pos"]).groupby("k"):
        want = part["pos"].where(part["id"] % 97 == 0).ffill()
        assert want.fillna(-1).astype(int).tolist() == part["m"].fillna(-1).astype(int).tolist()


def test_salted_join_of_hot_groups(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    assert O.join_hot(big, small, ["k"], hot_rows=50).count() == big.join(small, "k").count() == 1000


def test_added_sources_follow_file_rules(spark):
    """Headings link inside one file, equal headings keep file order, every category counts; batches don't matter."""
    rows = [("r1", "f1.md", "Root", "general", 1), ("r2", "f2.md", "Root > Part", "general", 2), ("r3", "f2.md", "Root", "general", 3),
            ("t1", "f3.md", "", "tech_manual", 4), ("t2", "f3.md", "", "general", 5), ("t3", "f3.md", "", "made up", 6)]
    chunks = spark.createDataFrame(rows, "id string, payload_file string, heading_path string, category string, seq bigint").withColumn(
        "content", F.lit("text"))
    nodes, edges = G.build_graph(chunks, None, "last")
    assert nodes.count() == 6
    got = {(r["src"], r["dst"], r["weight"]) for r in edges.collect()}
    assert ("r2", "r3", 0.3) in got and not any("r1" in e[:2] for e in got)  # order overwrites the heading link of the same pair
    assert {e[:2] for e in got if e[0][0] == "t"} == {("t1", "t2"), ("t2", "t3")}
    heads = {(r["src"], r["dst"]) for r in G.heading_edges(nodes, per_file=True).collect()}
    assert heads == {("r2", "r3")}
    empty_nodes, empty_edges = nodes.limit(0), edges.limit(0)
    for name in ("f1.md", "f2.md", "f3.md"):
        empty_nodes, empty_edges = G.update_graph(empty_nodes, empty_edges, chunks.filter(F.col("payload_file") == name))
    assert {(r["src"], r["dst"], r["weight"]) for r in empty_edges.collect()} == got


def test_terms_in_texts_are_those_python_finds():
    rnd = random.Random(11)
    letters = "aab é参𝒳 "
    word = lambda lo, hi: "".join(rnd.choices(letters, k=rnd.randrange(lo, hi)))
    terms = [[word(1, 5) for _ in range(6)] + [word(11, 16)] for _ in range(12)] + [[""]]
    long = terms[0][6]
    texts = [(word(0, 30), word(0, 9), word(0, 4)) for _ in range(50)] + [("", "", ""), ("x" + long, "", ""), ("", long[:-1], "a"), ("", long, long)]
    vocabulary = M._Vocabulary(terms)
    held = vocabulary.held(*map(list, zip(*texts)))
    names = {i: t for t, i in vocabulary.at.items()}
    for i, (label, heading, category) in enumerate(texts):
        one = held[i:i + 1]
        want = {t: 3.0 if t in heading else 2.5 if t in label else 1.5 for t in vocabulary.at if t and t in f"{label} {heading} {category}"}
        assert {names[t]: w for t, w in zip(one.terms.tolist(), one.weights.tolist())} == want and len(one.terms) == len(want)


def test_later_texts_are_not_listed_where_earlier_ones_fill_the_places(monkeypatch):
    texts = pd.DataFrame({"label": ["net port"] * 400 + ["net"] * 100 + ["net port guide"], "heading": "", "category": "general",
                          "bonus_a": 0.0, "bonus_b": 0.0, "seq": range(501)})
    terms = [["net", "port"], ["net", "guide"], ["zz"]] + [["net"]] * 40
    monkeypatch.setattr(M, "PART", 100)
    vocabulary, pairs = M._vocabularies(terms)
    held, held_pairs = M._held_terms(vocabulary, texts), M._held_terms(pairs, texts)
    seen = []
    inner = M._first_of
    monkeypatch.setattr(M, "_first_of", lambda *args: seen.append(len(args[0])) or inner(*args))
    got = M._best_pairs(M._Questions(terms, vocabulary, held, pairs), held, held_pairs, texts, 3, 1.0, False)
    best = {q: got[got["question"] == q].sort_values("text")["text"].tolist() for q in range(len(terms))}
    assert best == {q: [0, 1, 500] if q == 1 else [] if q == 2 else [0, 1, 2] for q in range(len(terms))}
    assert max(seen[1:]) <= 3 * len(terms) + 1


def test_phrases_full_of_first_rows_are_not_looked_for_in_later_ones(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(f"c{i}", rnd.choice(["the Er text", "er of the", "word the text er"]) + (" rare er thing" if i % 97 == 0 else "") + (" one" if i == 399 else ""),
             rnd.choice([None, "", "a", "b > the"]), rnd.choice([i, i, None] if i % 50 == 0 else [i])) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id string, content string, heading_path string, seq bigint").withColumn("category", F.lit("general"))
    phrases = {"q1": "er", "q2": "The text", "q3": "rare er thing", "q4": "one", "q5": "none", "q6": "er"}
    queries = spark.createDataFrame(list(phrases.items()), "query_id string, query string")
    sure = lambda r: r[3] is not None
    want = {}
    for q, p in phrases.items():
        held = sorted((r for r in rows if p.lower() in r[1].lower() or p.lower() in (r[2] or "")), key=lambda r: (r[2] or "", sure(r), r[3] or 0))
        want[q] = [r[0] for r in held[:3]]
    rows_of = lambda got: {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in phrases}
    assert rows_of(S.search_text(chunks, queries, None, 3).collect()) == want
    monkeypatch.setattr(S, "FIRST_ROWS", 40)
    asked = []
    inner = S.phrase_matches
    monkeypatch.setattr(S, "phrase_matches", lambda p, t, c: asked.append(({r["phrase"] for r in p.collect()}, t.count())) or inner(p, t, c))
    assert rows_of(S.search_text(chunks, queries, None, 3).collect()) == want
    (every, few), (rest, others) = asked
    assert few + others == 400 and few < 80 and "er" in every and "er" not in rest and {"one", "none"} <= rest


def test_phrases_are_compared_without_moving_texts(spark):
    texts = spark.createDataFrame([(i, f"some text {i} of many words") for i in range(50)], "id bigint, t string")
    found = M.phrase_matches(spark.createDataFrame([("text 7 of",), ("many",)], "phrase string"), texts, ["t"])
    assert {(r["phrase"], r["id"]) for r in found.collect()} == {("text 7 of", 7), *(("many", i) for i in range(50))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
