"""Iterative graph operators.  Each round ends in a reliable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.operators.graph import both_ways
from quillgraph.operators.ordering import cut_lineage, position_in_group, release


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int = 3,
        max_nodes: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Level-by-level search of all queries in one job.

    ``starts`` has (query_id, id).  A query stops growing once it holds ``max_nodes`` nodes; the
    test is made between levels, so a level is always taken whole.  Returns
    visited (query_id, id, depth) and edges (query_id, from_id, to_id, depth).
    """
    near = cut_lineage(both_ways(edges).select("node", "neighbor").distinct())
    visited = cut_lineage(starts.select("query_id", "id").distinct().withColumn("depth", F.lit(0)))
    frontier, walked = visited, None
    for level in range(1, max_depth + 1):
        grow = frontier
        if max_nodes is not None:
            full = visited.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max_nodes)
            grow = frontier.join(full, "query_id", "left_anti")
        step = grow.select("query_id", F.col("id").alias("node")).join(near, "node").join(
            visited.select("query_id", F.col("id").alias("neighbor")), ["query_id", "neighbor"], "left_anti")
        step = cut_lineage(step.select("query_id", F.col("node").alias("from_id"),
                                       F.col("neighbor").alias("to_id"), F.lit(level).alias("depth")))
        walked = step if walked is None else walked.unionByName(step)
        frontier = cut_lineage(step.select("query_id", F.col("to_id").alias("id"), "depth").distinct())
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited, walked


def bounded_bfs(near: DataFrame, hubs: DataFrame, starts: DataFrame, max_depth: int = 3,
                max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """The same search with bounded levels: (visited, hub steps).

    ``near`` has each neighbour of each node once (node, neighbor), ``hubs`` the nodes (node) with at least ``max_nodes``.  A step from
    a hub fills the question's quota, so it is its last; it is kept as (query_id, hub) and stands for all neighbours
    of the hub.  Other steps bring fewer than ``max_nodes`` nodes each, from fewer than ``max_nodes`` nodes.  Nodes reached
    through a hub are not listed in ``visited`` unless another step reaches them.
    """
    visited = cut_lineage(starts.select("query_id", "id").distinct())
    frontier, steps = visited, None
    for _ in range(max_depth):
        done = visited.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= max_nodes).select("query_id")
        if steps is not None:
            done = done.unionByName(steps.select("query_id")).distinct()
        grow = cut_lineage(frontier.join(done, "query_id", "left_anti").withColumnRenamed("id", "node"))
        at_hub = cut_lineage(grow.join(hubs.select("node"), "node", "left_semi").select("query_id", F.col("node").alias("hub")))
        steps = at_hub if steps is None else steps.unionByName(at_hub)
        frontier = cut_lineage(grow.join(hubs.select("node"), "node", "left_anti").join(near, "node").select(
            "query_id", F.col("neighbor").alias("id")).distinct().join(visited, ["query_id", "id"], "left_anti"))
        release(grow)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited, steps


def hub_cells(near: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, hubs of cells): nodes next to the same set of hubs form a cell; (id, cell) and (hub, cell).

    Cells share no node, so a question that steps from several hubs of a group looks at the group once.
    """
    sets = near.join(hubs.select(F.col("node")), "node", "left_semi").groupBy(F.col("neighbor").alias("id")).agg(
        F.sort_array(F.collect_set("node")).alias("_hubs")).withColumn("_key", F.to_json("_hubs"))
    named = cut_lineage(sets.groupBy("_key").agg(F.first("_hubs").alias("_hubs")).withColumn("cell", F.monotonically_increasing_id()))
    return sets.join(named.select("_key", "cell"), "_key").select("id", "cell"), named.select(F.explode("_hubs").alias("hub"), "cell")


def known_starts(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    return starts.join(nodes.select("id"), "id", "left_semi")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 6) -> DataFrame:
    """Every node within ``max_depth`` hops and its smallest hop count, per query."""
    return bfs(edges, starts, max_depth, None)[0]


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One star step over directed links (node, near), with near the smaller end.

    Large: every node links its larger neighbours to the smallest node it knows, itself included.  Small: every node links its
    smaller neighbours, and itself, to the smallest of them.  The smallest neighbour is a minimum per node, combined
    before the shuffle, and has one row per node in the join behind it.
    """
    if small:
        around = links
    else:
        around = links.select(F.explode(F.array(F.struct("node", "near"), F.struct(
            F.col("near").alias("node"), F.col("node").alias("near")))).alias("e")).select("e.node", "e.near")
    least = around.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    met = around.join(least, "node")
    if small:
        ends = F.array(F.struct(F.col("near").alias("node"), F.col("least").alias("near")),
                       F.struct(F.col("node"), F.col("least").alias("near")))
        met = met.select(F.explode(ends).alias("e")).select("e.node", "e.near")
    else:
        met = met.filter("near > node").select(F.col("near").alias("node"), F.col("least").alias("near"))
    return met.filter("node <> near").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of the component, for every node of ``edges`` (src, dst) with a neighbour.

    Alternating large-star and small-star steps, until a pair of steps changes nothing; then every node links
    straight to the smallest of its component.  A step is a minimum per node and a join on it; each one ends in a
    written table, and the tables of earlier steps are removed.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("near")).distinct())
    marks = [F.count("*"), F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))]
    seen = tuple(links.agg(*marks).first())
    while seen[0]:
        large = cut_lineage(_stars(links, small=False))
        after = cut_lineage(_stars(large, small=True))
        now = tuple(after.agg(*marks).first())
        release(links, large)
        links, seen, before = after, now, seen
        if now == before:
            break
    roots = links.select(F.col("near").alias("node"), F.col("near").alias("label")).distinct()
    return links.select("node", F.col("near").alias("label")).unionByName(roots)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community_id): smallest node id of the component; a node without edges is its own."""
    labels = component_labels(edges.select("src", "dst"))
    return nodes.select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("label", "id").alias("community_id"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Weighted modularity of a partition."""
    c = communities.select("id", "community_id")
    ends = edges.join(c.select(F.col("id").alias("src"), F.col("community_id").alias("ca")), "src").join(
        c.select(F.col("id").alias("dst"), F.col("community_id").alias("cb")), "dst")
    total = edges.agg(F.sum("weight").alias("m"))
    inner = ends.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("w_in"))
    degree = ends.select(F.explode(F.array(
        F.struct(F.col("ca").alias("c"), "weight"), F.struct(F.col("cb").alias("c"), "weight"))).alias("e")).groupBy(
        "e.c").agg(F.sum("e.weight").alias("w_tot"))
    m = total.first()["m"] or 1.0
    return degree.join(inner, "c", "left").agg(F.sum(
        F.coalesce("w_in", F.lit(0.0)) / m - F.pow(F.col("w_tot") / (2 * m), 2)).alias("modularity"))


def _totals(state: DataFrame) -> DataFrame:
    return state.groupBy("community_id").agg(F.sum("k").alias("tot"))


def _move_half(near: DataFrame, state: DataFrame, two_m: float, sweep: int, half: int) -> DataFrame:
    """``state`` (id, community_id, k) after one half of the nodes, drawn anew in each sweep, took their best community.

    Only edges of the nodes that may move are read.  The strength of a community travels with its members, so options are weighed
    where a node's edges meet, in one shuffle by neighbour and one by node.
    """
    mine = lambda c: F.pmod(F.xxhash64(c, F.lit(sweep)), F.lit(2)) == half
    placed = state.join(_totals(state), "community_id").select("id", "community_id", "k", "tot")
    own = placed.filter(mine("id")).withColumnsRenamed({"community_id": "own", "tot": "own_tot"})
    links = near.filter(mine("node")).join(placed.select(F.col("id").alias("neighbor"), "community_id", "tot"), "neighbor").select(
        F.col("node").alias("id"), "community_id", "tot", "weight").repartition("id").groupBy("id", "community_id").agg(
        F.sum("weight").alias("w"), F.first("tot").alias("tot"))
    options = links.join(own, "id")
    is_own = F.col("community_id") == F.col("own")
    gain = F.col("w") - F.col("k") * F.when(is_own, F.col("tot") - F.col("k")).otherwise(F.col("tot")) / F.lit(two_m)
    # leaving a community without links inside it gains what its strength costs there
    unlinked = -F.col("k") * (F.col("own_tot") - F.col("k")) / F.lit(two_m)
    best = options.withColumn("gain", gain).groupBy("id").agg(
        F.max_by("community_id", F.struct("gain", "community_id")).alias("best"), F.max("gain").alias("best_gain"),
        F.coalesce(F.max(F.when(is_own, F.col("gain"))), F.max(unlinked)).alias("own_gain"))
    better = best.filter(F.col("best_gain") > F.col("own_gain") + 1e-12).select("id", "best")
    return state.join(better, "id", "left").select(
        "id", F.coalesce("best", "community_id").alias("community_id"), "k", F.col("community_id").alias("old"))


def _state_modularity(graph: DataFrame, state: DataFrame, two_m: float) -> float:
    """Weighted modularity of a state: one pass over the edges for the weight inside, the rest from the strengths."""
    of = lambda end: state.select(F.col("id").alias(end), F.col("community_id").alias(f"_{end}"))
    inside = graph.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").agg(F.sum("weight").alias("w"))
    spread = _totals(state).agg(F.sum(F.pow(F.col("tot") / F.lit(two_m), 2)).alias("s"))
    row = inside.join(spread).first()
    return 2.0 * (row["w"] or 0.0) / two_m - row["s"]


def _local_moves(graph: DataFrame, two_m: float, start: float) -> tuple[DataFrame, float]:
    """Move nodes of ``graph`` until none wants to, or until two sweeps in a row raise modularity no more."""
    loops = graph.filter("src = dst").select(F.col("src").alias("id"), (2 * F.col("weight")).alias("w"))
    near = cut_lineage(both_ways(graph.filter("src <> dst")))
    state = best = cut_lineage(near.select(F.col("node").alias("id"), F.col("weight").alias("w")).unionByName(
        loops).groupBy("id").agg(F.sum("w").alias("k")).select("id", F.col("id").alias("community_id"), "k"))
    best_q, idle, sweep = start, 0, 0
    while idle < 2:
        moved = False
        for half in (0, 1):
            before, state = state, cut_lineage(_move_half(near, state.select("id", "community_id", "k"), two_m, sweep, half))
            moved = not state.filter("old <> community_id").isEmpty() or moved
            if before is not best:
                release(before)
        if not moved:
            break
        q = _state_modularity(graph, state, two_m)
        idle = 0 if q > best_q + 1e-9 else idle + 1
        if not idle:
            if best is not state:
                release(best)
            best, best_q = state, q
        sweep += 1
    release(near)
    return best.select("id", "community_id"), best_q


def _alone(edges: DataFrame, two_m: float) -> float:
    """Modularity when every node is a community of its own: only loops are inside."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k"))
    spread = ends.agg(F.sum(F.pow(F.col("k") / F.lit(two_m), 2))).first()[0]
    return 2.0 * (edges.filter("src = dst").agg(F.sum("weight")).first()[0] or 0.0) / two_m - spread


def modularity_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community_id): communities by local moving and contraction, both as joins and sums, run to their end.

    In a half sweep half of the nodes move, each to the neighbouring community it gains most by.  Communities are then
    contracted to nodes, and levels follow until one doesn't raise modularity.  Every step kept raises modularity, so the
    search ends.  Communities that are not connected are split at last, which can only raise it further.

    The search works on numbers in the order of ids, which are less to move and compare than texts; the smallest number of a community is
    that of its smallest id.
    """
    ids = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    numbers = cut_lineage(position_in_group(ids, [], ["id"], "n"))
    of = lambda name: numbers.select(F.col("id").alias(name), F.col("n").alias(f"_{name}"))
    own = cut_lineage(edges.join(of("src"), "src").join(of("dst"), "dst").select(
        F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.col("weight").cast("double").alias("weight")))
    members = cut_lineage(nodes.select("id").join(numbers, "id").select(F.col("n").alias("id")))
    found = _communities(members, own).withColumnsRenamed({"id": "_id", "community_id": "_community_id"})
    return found.join(of("id"), "_id").join(of("community_id"), "_community_id").select("id", "community_id")


def _communities(members: DataFrame, own: DataFrame) -> DataFrame:
    """``modularity_communities`` of written tables (id) and (src, dst, weight)."""
    result = cut_lineage(members.select("id", F.col("id").alias("community_id")))
    two_m = 2.0 * (own.agg(F.sum("weight")).first()[0] or 0.0)
    if two_m == 0.0:
        return result
    graph, best_q = own, _alone(own, two_m)
    while True:
        comm, q = _local_moves(graph, two_m, best_q)
        if q <= best_q + 1e-9:
            break
        best_q = q
        merged = cut_lineage(result.join(comm.select(
            F.col("id").alias("community_id"), F.col("community_id").alias("to")), "community_id", "left").select(
            "id", F.coalesce("to", "community_id").alias("community_id")))
        smaller = cut_lineage(graph.join(comm.select(F.col("id").alias("src"), F.col("community_id").alias("a")), "src").join(
            comm.select(F.col("id").alias("dst"), F.col("community_id").alias("b")), "dst").groupBy(
            F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")))
        release(result, *([graph] if graph is not own else []))
        result, graph = merged, smaller
    of = lambda end: result.select(F.col("id").alias(end), F.col("community_id").alias(f"_{end}"))
    inner = own.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst")
    return connected_components(members, inner)
