"""The chunk graph: nodes, undirected edges (src < dst), communities.

Edge rules link chunks by heading hierarchy, by bindings, by category inside a source and by
order inside a source.  Every rule is a join or a bounded choice per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import markdown as M
from quillgraph.functions.text import strip
from quillgraph.operators.filters import known_category_nodes
from quillgraph.operators.ordering import cut_lineage, join_hot, position_in_group, with_previous

FANOUT = 5                       # category links a node adds
HEAD = 2 * FANOUT + 1            # positions that decide the category rule
CATEGORY_ORDER_SHIFT = 1 << 50   # node order: category rank first, then row order

EDGE_COLUMNS = ["src", "dst", "relation", "confidence", "confidence_score", "source_file", "weight"]


def node_label(heading_path, content, category, fallback="chunk") -> Column:
    snippet = F.replace(strip(F.substring(F.coalesce(content, F.lit("")), 1, 60)), F.lit("\n"), F.lit(" "))
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    head = (F.when(heading_path != "", heading_path)
            .when(snippet != "", F.concat(snippet, F.lit("..."))).otherwise(other))
    return F.concat(head, F.lit(" ["), category, F.lit("]"))


def build_nodes(chunks: DataFrame, incremental: bool = False) -> DataFrame:
    """Nodes in order: by category and row for a full build; by row, and of every category, when sources are added."""
    path = F.coalesce("heading_path", F.lit(""))
    source = strip(F.coalesce("payload_file", F.lit("")))
    label = node_label(path, F.col("content"), F.col("category"), source if incremental else "chunk")
    # only what a node needs travels to the choice of the first row, not the content
    chunks = chunks.select("id", "seq", "category", label.alias("label"), source.alias("source_file"), path.alias("heading_path"))
    if incremental:
        first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
        rows = chunks.filter("id <> ''").withColumn("_rn", first).filter("_rn <= 1")
        order = F.col("seq").cast("bigint")
    else:
        rows = known_category_nodes(chunks)
        order = F.col("cat_rank") * F.lit(CATEGORY_ORDER_SHIFT) + F.col("seq")
    return rows.select(
        "id", "label", F.lit("document").alias("file_type"), "source_file", F.col("heading_path").alias("source_location"),
        F.col("id").alias("chunk_id"), "category", "heading_path", order.alias("node_seq"))


def _edges(df: DataFrame, a, b, relation: str, weight: float, source_file=None) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.filter(col(a) != col(b)).select(
        F.least(col(a), col(b)).alias("src"), F.greatest(col(a), col(b)).alias("dst"),
        F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.lit(1.0).alias("confidence_score"),
        (F.lit("") if source_file is None else col(source_file)).alias("source_file"),
        F.lit(weight).alias("weight"))


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ">"), strip), lambda p: p != "")


def heading_edges(nodes: DataFrame, per_file: bool = False) -> DataFrame:
    """Parent path to child path, between the first chunk of each path; ``per_file`` looks inside one source only."""
    keys = ["source_file", "heading_path"] if per_file else ["heading_path"]
    first = nodes.filter(F.col("heading_path") != "").groupBy(*keys).agg(F.min_by("id", "node_seq").alias("id"))
    child = first.withColumn("_parts", path_parts(F.col("heading_path"))).filter(
        (F.size("_parts") > 1) & (F.array_join("_parts", M.PATH_SEP) == F.col("heading_path")))
    child = child.select(F.col("id").alias("child"), *keys[:-1], F.array_join(
        F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))), M.PATH_SEP).alias("heading_path"))
    joined = child.join(first.withColumnRenamed("id", "parent"), keys)
    return _edges(joined, "parent", "child", "references", 1.0)


def cross_modal_edges(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings whose anchor and clip are both nodes."""
    pairs = bindings.select(strip("pdf_anchor_id").alias("a"), strip("video_clip_id").alias("b"))
    ids = nodes.select("id")
    both = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(
        ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return _edges(both, "a", "b", "shares_data_with", 1.0).dropDuplicates(["src", "dst"])


def _group_heads(nodes: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("category", "source_file").orderBy("node_seq")
    return nodes.select("category", "source_file", "id", "node_seq").withColumn(
        "_k", F.row_number().over(w)).filter(F.col("_k") <= size).withColumn("_k", F.col("_k") - 1)


def category_edges(nodes: DataFrame, existing: DataFrame | None = None,
                   hot_rows: int = 1_000_000) -> DataFrame:
    """Each node links to the first five others of its category and source not yet adjacent.

    Without earlier edges the greedy result is known: with positions a < b in node order, a pair is
    linked iff a < 5 or b <= 10.  So only the first eleven nodes of a group matter, and the
    rest of the group joins the first five.  Groups that hold earlier edges take the exact
    fixpoint in ``_category_edges_with_prior``.
    """
    keys = ["category", "source_file"]
    if existing is not None:
        prior = _prior_in_groups(nodes, existing)
        dirty = prior.select(*keys).distinct()
        free = nodes.join(dirty, keys, "left_anti")
        return category_edges(free, None, hot_rows).unionByName(
            _category_edges_with_prior(nodes.join(dirty, keys, "left_semi"), prior))
    heads = _group_heads(nodes, HEAD).filter(F.col("_k") < FANOUT).select(
        *keys, F.col("id").alias("a"), F.col("node_seq").alias("a_seq"))
    pairs = join_hot(nodes.select(*keys, "id", "node_seq"), heads, keys, hot_rows).filter(
        F.col("node_seq") > F.col("a_seq"))
    head_rows = _group_heads(nodes, HEAD).filter(F.col("_k") >= FANOUT)
    # the few pairs among positions 5 .. 10
    left = head_rows.select(*keys, F.col("id").alias("a"), F.col("_k").alias("ka"))
    inner = left.join(head_rows.select(*keys, "id", "_k"), keys).filter(F.col("_k") > F.col("ka"))
    cols = [*keys, "a", "id"]
    return _edges(pairs.select(*cols).unionByName(inner.select(*cols)), "a", "id",
                  "conceptually_related_to", 0.5, "source_file")


def _prior_in_groups(nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Earlier edges whose two ends share category and source."""
    n = nodes.select("id", "category", "source_file")
    a = n.select(F.col("id").alias("src"), F.col("category").alias("ca"), F.col("source_file").alias("sa"))
    b = n.select(F.col("id").alias("dst"), F.col("category"), F.col("source_file"))
    return existing.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter(
        (F.col("ca") == F.col("category")) & (F.col("sa") == F.col("source_file"))).select(
        "category", "source_file", "src", "dst")


def _category_edges_with_prior(nodes: DataFrame, prior: DataFrame, spare: int = 16) -> DataFrame:
    """Greedy category links when some pairs of a group are already adjacent.

    A node's choice depends on its earlier edges and on earlier nodes that chose it.  Only a node
    with fewer than five free places before it can choose forward; with edges of a
    heading tree those are the first places and a handful of parents.  These few are folded in
    order inside one row per group; every other node then chooses on its own.  Each node brings
    its first ``5 + spare`` places free of earlier edges; if more than ``spare`` nodes chose one
    node, the step is repeated with more places.
    """
    keys = ["category", "source_file"]
    pos = cut_lineage(position_in_group(nodes.select(*keys, "id", "node_seq"), keys, ["node_seq"], "i"))
    size = pos.groupBy(*keys).agg(F.count("*").alias("n"))
    at = lambda name, p: pos.select(*keys, F.col("id").alias(name), F.col("i").alias(p))
    both = prior.join(at("src", "ps"), [*keys, "src"]).join(at("dst", "pd"), [*keys, "dst"])
    excluded = cut_lineage(both.select(*keys, F.explode(F.array(
        F.struct(F.col("ps").alias("i"), F.col("pd").alias("x")), F.struct(F.col("pd").alias("i"), F.col("ps").alias("x")),
        F.struct(F.col("ps").alias("i"), F.col("ps").alias("x")), F.struct(F.col("pd").alias("i"), F.col("pd").alias("x")),
    )).alias("e")).select(*keys, "e.i", "e.x").distinct())
    ranked = with_previous(position_in_group(excluded, [*keys, "i"], ["x"], "r"), [*keys, "i"], "r", 1, ["x"], "_p")
    before = F.coalesce(F.get("_p", F.lit(0))["x"], F.lit(-1).cast("bigint"))
    gaps = ranked.select(*keys, "i", (before + 1).alias("lo"), F.col("x").alias("hi"), (before + 1 - F.col("r")).alias("free"))
    tails = excluded.groupBy(*keys, "i").agg(F.max("x").alias("x"), F.count("*").alias("c")).join(size, keys).select(
        *keys, "i", (F.col("x") + 1).alias("lo"), F.col("n").alias("hi"), (F.col("x") + 1 - F.col("c")).alias("free"))
    gaps = cut_lineage(gaps.unionByName(tails).filter("lo < hi"))
    tied = pos.join(size, keys)
    ends = None
    while ends is None:
        want = FANOUT + spare
        places = gaps.filter(F.col("free") < want).select(*keys, "i", F.explode(F.sequence(
            F.col("lo"), F.least(F.col("hi") - 1, F.col("lo") + (want - 1 - F.col("free"))))).alias("j")).groupBy(
            *keys, "i").agg(F.sort_array(F.collect_list("j")).alias("_c"))
        bound = excluded.select(*keys, "i").distinct().withColumn("_bound", F.lit(True))
        plain = F.slice(F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(want).cast("bigint")),
                                 lambda x: (x != F.col("i")) & (x < F.col("n"))), 1, want)
        free = cut_lineage(tied.join(bound, [*keys, "i"], "left").join(places, [*keys, "i"], "left").select(
            *keys, "i", "id", F.when(F.col("_bound").isNull(), plain).otherwise(
                F.coalesce("_c", F.array().cast("array<bigint>"))).alias("free")))
        early = free.filter(F.exists("free", lambda j: j > F.col("i")))
        step = lambda acc, e: F.concat(acc, F.transform(
            F.filter(F.slice(F.filter(e["free"], lambda j: ~F.exists(acc, lambda a: (a["i"] == j) & (a["x"] == e["i"]))
                                      & ~F.exists(acc, lambda a: (a["x"] == j) & (a["i"] == e["i"]))), 1, FANOUT),
                     lambda j: j > e["i"]),
            lambda j: F.struct(e["i"].alias("x"), j.alias("i"))))
        forward = cut_lineage(early.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "free"))).alias("_e")).select(
            *keys, F.explode(F.aggregate("_e", F.array().cast("array<struct<x:bigint,i:bigint>>"), step)).alias("f")).select(
            *keys, "f.i", "f.x").groupBy(*keys, "i").agg(F.collect_set("x").alias("_f")))
        if forward.filter(F.size("_f") > spare).isEmpty():
            chosen = free.join(forward, [*keys, "i"], "left").select(*keys, F.col("id").alias("a"), F.explode(F.slice(F.filter(
                "free", lambda j: ~F.coalesce(F.array_contains("_f", j), F.lit(False))), 1, FANOUT)).alias("j"))
            ends = chosen.join(at("b", "j"), [*keys, "j"])
        spare *= 4
    return _edges(ends, "a", "b", "conceptually_related_to", 0.5, "source_file").dropDuplicates(["src", "dst"])


def category_edges_incremental(nodes: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Rule without adjacency test: every node is linked to the first five of its group (six in all)."""
    keys = ["category", "source_file"]
    heads = _group_heads(nodes, FANOUT + 1).select(
        *keys, F.col("id").alias("a"), F.col("_k").alias("ka"), F.col("node_seq").alias("a_seq"))
    pairs = join_hot(nodes.select(*keys, "id", "node_seq"), heads, keys, hot_rows).filter(
        (F.col("ka") < FANOUT) & (F.col("node_seq") > F.col("a_seq")))
    return _edges(pairs, "a", "id", "conceptually_related_to", 0.5, "source_file")


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """Neighbours in heading-path order inside each source."""
    rows = nodes.filter(F.col("source_file") != "").select("source_file", "heading_path", "node_seq", "id")
    placed = position_in_group(rows, ["source_file"], ["heading_path", "node_seq"], "pos")
    near = with_previous(placed, ["source_file"], "pos", 1, ["id"], "_prev").filter(F.size("_prev") > 0)
    return _edges(near, F.col("_prev")[0]["id"], "id", "references", 0.3, "source_file")


def resolve_precedence(ranked: DataFrame, precedence: str = "first") -> DataFrame:
    """One edge per pair: the earliest or the latest written one (by ``prio``)."""
    order = F.asc("prio") if precedence == "first" else F.desc("prio")
    rn = F.row_number().over(Window.partitionBy("src", "dst").orderBy(order))
    return ranked.withColumn("_rn", rn).filter("_rn <= 1").select(*EDGE_COLUMNS)


def build_graph(chunks: DataFrame, bindings: DataFrame | None = None, precedence: str = "first",
                hot_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole chunk table."""
    nodes = cut_lineage(build_nodes(chunks, incremental=precedence == "last"))
    heads = heading_edges(nodes, per_file=precedence == "last")
    if precedence == "first":
        prior = heads
        steps = [heads]
        if bindings is not None:
            links = cross_modal_edges(nodes, bindings)
            steps.append(links)
            prior = prior.unionByName(links)
        steps.append(category_edges(nodes, cut_lineage(prior), hot_rows))
    else:
        steps = [heads, category_edges_incremental(nodes, hot_rows)]
    steps.append(sequence_edges(nodes))
    ranked = None
    for prio, step in enumerate(steps):
        tagged = step.withColumn("prio", F.lit(prio))
        ranked = tagged if ranked is None else ranked.unionByName(tagged)
    return nodes, resolve_precedence(ranked, precedence)


def remove_source(nodes: DataFrame, edges: DataFrame, sources: DataFrame):
    """(nodes, edges, removed count per source) without the nodes of ``sources`` (source_file)."""
    gone = nodes.join(sources.select("source_file").distinct(), "source_file", "left_semi")
    kept = nodes.join(gone.select("id"), "id", "left_anti")
    ids = kept.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, left.select(*EDGE_COLUMNS), gone.groupBy("source_file").agg(F.count("*").alias("removed"))


def update_graph(nodes: DataFrame, edges: DataFrame, added_chunks: DataFrame, replace: bool = True):
    """Add the chunks of some sources; with ``replace`` their old nodes go first.

    New edges overwrite old ones between the same nodes.
    """
    new_nodes, new_edges = build_graph(added_chunks, precedence="last")
    if replace:
        nodes, edges, _ = remove_source(nodes, edges, new_nodes.select("source_file"))
    all_nodes = nodes.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes.select(*nodes.columns))
    ranked = edges.withColumn("prio", F.lit(0)).unionByName(new_edges.withColumn("prio", F.lit(1)))
    return all_nodes, resolve_precedence(ranked, "last")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.col("weight")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbor"), F.col("weight")))).alias("e")).select("e.*")


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id", "node_seq").join(ends, "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0)))


def hub_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return node_degree(nodes, edges).orderBy(F.desc("degree"), "node_seq").limit(n)


def community_cohesion(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Size, inner edges and density of each community."""
    c = communities.select("id", "community_id")
    sizes = c.groupBy("community_id").agg(F.count("*").alias("n_nodes"))
    inner = edges.select("src", "dst").join(
        c.select(F.col("id").alias("src"), F.col("community_id").alias("ca")), "src").join(
        c.select(F.col("id").alias("dst"), F.col("community_id")), "dst").filter(
        F.col("ca") == F.col("community_id")).groupBy("community_id").agg(F.count("*").alias("n_edges"))
    n = F.col("n_nodes").cast("double")
    return sizes.join(inner, "community_id", "left").select(
        "community_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        F.when(F.col("n_nodes") <= 1, F.lit(0.0)).otherwise(
            F.coalesce("n_edges", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"))
