"""Retrieval as composed jobs: many questions answered in one pass over the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.operators import aggregates as A, conversation, graph as G, media, scoring as S, traversal as TR
from quillgraph.operators.graph import both_ways
from quillgraph.operators.ordering import cut_lineage, position_in_group


@dataclass(frozen=True)
class GraphTables:
    """What search needs from a built graph."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame
    communities: DataFrame | None = None


def prepare_graph(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> GraphTables:
    """Fix nodes, edges, communities and per-node features for repeated use."""
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    if communities is None:
        communities = TR.connected_components(nodes, edges)
    features = S.node_features(nodes, G.node_degree(nodes, edges), communities,
                               G.community_cohesion(edges, communities))
    return GraphTables(nodes, edges, cut_lineage(features), communities)


def resolve_nodes(ranked: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked nodes to chunk rows; nodes without a row are dropped, rank order is kept."""
    once = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    keyed = once.join(nodes.select("id", "chunk_id"), "id").select("query_id", "rank", F.col("chunk_id").alias("id"))
    return keyed.join(chunks, "id")


def top_k_hits(ranked: DataFrame, k: int = 5) -> DataFrame:
    return S.top_k_nodes(ranked, k)


def graph_search(queries: DataFrame, graph: GraphTables, chunks: DataFrame, top_k: int = 5,
                 start_nodes: int = 10, max_depth: int = 3, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """(hits, summary) for ``queries`` (query_id, query[, standalone_query]).

    A step from a node with ``max_nodes`` neighbours or more is not written out: it names the node, and the neighbours are
    scored in blocks that keep the best ``top_k``.  Questions without a matching node are answered by phrase search on their raw text.
    """
    if "standalone_query" not in queries.columns:
        queries = queries.withColumn("standalone_query", F.trim("query"))
    asked = cut_lineage(queries.select("query_id", "query", "standalone_query"))
    alone = asked.select("query_id", F.col("standalone_query").alias("query"))
    starts = cut_lineage(S.find_nodes(alone, graph.nodes, start_nodes).select("query_id", "id"))
    near = cut_lineage(both_ways(graph.edges).select("node", "neighbor").distinct())
    hubs = cut_lineage(near.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= max_nodes))
    visited, steps = TR.bounded_bfs(near, hubs, starts, max_depth, max_nodes)
    cell_of_node, hubs_of_cell = TR.hub_cells(near, hubs)
    cells = cut_lineage(steps.join(hubs_of_cell, "hub").select("query_id", "cell").distinct())
    used = cell_of_node.join(cells.select("cell").distinct(), "cell", "left_semi")
    ranked = top_k_hits(S.rank_with_hubs(visited, cells, S.cell_texts(used, graph.features, top_k), alone, graph.features, top_k), top_k)
    found = resolve_nodes(ranked, graph.nodes, chunks).withColumn("router_source", F.lit("graph_traversal"))
    missed = asked.join(starts.select("query_id").distinct(), "query_id", "left_anti")
    fallback = text_search_fallback(missed, chunks, top_k)
    hits = cut_lineage(found.unionByName(fallback))
    return hits, summarize(asked, hits, missed)


def text_search_fallback(queries: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    return S.search_text(chunks, queries, None, top_k).withColumn("router_source", F.lit("text_search_fallback"))


def summarize(asked: DataFrame, hits: DataFrame, missed: DataFrame) -> DataFrame:
    """One row per question: category, route, validity, hit count and heading paths."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    miss = missed.select("query_id", F.lit(True).alias("_missed"))
    joined = asked.join(miss, "query_id", "left").join(counts, "query_id", "left").join(
        A.dominant_category(hits).withColumnRenamed("category", "_dom"), "query_id", "left").join(
        A.hit_heading_paths(hits), "query_id", "left")
    fell = F.col("_missed").isNotNull()
    return joined.select(
        "query_id", "query", "standalone_query",
        F.when(fell, T.heuristic_category("query")).otherwise(F.coalesce("_dom", F.lit("general"))).alias("category"),
        F.when(fell, "text_search_fallback").otherwise("graph_traversal").alias("router_source"),
        F.lit(1).alias("attempts"), (~fell).alias("validated"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("heading_paths", F.array().cast("array<string>")).alias("heading_paths"))


def tag_hits(hits: DataFrame, summary: DataFrame) -> DataFrame:
    """Hits with the route category and where the searched text came from."""
    s = summary.select("query_id", F.col("category").alias("route_category"), "standalone_query", F.when(
        F.col("standalone_query") == F.trim("query"), "raw_query").otherwise("standalone_query").alias("query_source"))
    return hits.join(s, "query_id")


def search(turns: DataFrame, graph: GraphTables, chunks: DataFrame, bindings: DataFrame, clips: DataFrame,
           top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversation turns to tagged hits with bound clips; (hits, summary)."""
    queries = conversation.condense_queries(turns)
    hits, summary = graph_search(queries, graph, chunks, top_k)
    tagged = tag_hits(hits, summary)
    return media.augment_with_clips(tagged, bindings, clips), summary


def exclude_edited(hits: DataFrame, invalid_ids: DataFrame) -> DataFrame:
    return hits.join(invalid_ids.select("id").distinct(), "id", "left_anti")


def hits_by_headings(selected: DataFrame, chunks: DataFrame, category: str | None = None) -> DataFrame:
    """Chunks below each selected heading path, in selection order.

    Selected prefixes meet the distinct paths, which are spelled out from their first character on, by an equi-join; chunks are
    attached last, by their whole path, so no chunk is copied per prefix.  A chunk's rank is the number of chunks on the paths
    before its own and its position on its path, which is the same for every question; both come from range partitions, so
    neither a question nor a path with very many chunks stays in one task.
    """
    rows = chunks if category is None else chunks.filter(F.col("category") == category)
    sel = cut_lineage(selected.withColumn("_p", T.ascii_lower("selected_path")))
    paths = cut_lineage(rows.select("heading_path").filter("heading_path is not null").groupBy("heading_path").agg(F.count("*").alias("_size")))
    low = T.ascii_lower("heading_path")
    spelled = paths.select("heading_path", "_size", F.explode(F.sequence(F.lit(0), F.length("heading_path"))).alias("_n")).select(
        "heading_path", "_size", F.substring(low, F.lit(1), F.col("_n")).alias("_p"))
    below = spelled.join(sel.select("_p").distinct(), "_p", "left_semi")
    blocks = position_in_group(sel.join(below, "_p").drop("_p"), ["query_id"], ["sel_no", "heading_path", "selected_path"], "_before", "_size")
    used = rows.join(blocks.select("heading_path").distinct(), "heading_path", "left_semi")
    placed = position_in_group(used, ["heading_path"], ["seq"], "_at")
    return blocks.drop("_size").join(placed, "heading_path").withColumn(
        "rank", (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_before", "_at")


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Every ``[n]`` of an answer with its link target; numbers without a hit stay plain."""
    cited = answers.select("query_id", F.posexplode(F.regexp_extract_all(
        "answer", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("cite_no", "_n")).withColumn("rank", F.col("_n").cast("bigint"))
    h = hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "anchor_id", "source_type",
                    F.lit(True).alias("_hit"))
    anchor = F.when(F.coalesce("anchor_id", F.lit("")) != "", F.col("anchor_id")).otherwise(F.coalesce("id", F.lit("")))
    is_video = F.lower(F.coalesce("source_type", F.lit(""))) == "video"
    return cited.join(h, ["query_id", "rank"], "left").select(
        "query_id", "cite_no", F.col("_n").alias("number"),
        F.when(F.col("_hit").isNull(), F.lit(None).cast("string"))
        .when(is_video, F.concat(F.lit("video://"), "id"))
        .when(anchor != "", F.concat(F.lit("anchor://"), anchor)).alias("target"))
