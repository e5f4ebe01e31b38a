"""Graph construction and traversal queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.functions import vocab as V
from quillgraph.operators import graph as G, traversal as TR
from quillgraph.operators.ordering import cut_lineage

EDGE = ["src", "dst", "relation", "source_file", "weight"]


def _nodes(s, d):
    return G.build_nodes(X.chunks_t(s, d))


def _graph(s, d, precedence="first"):
    return G.build_graph(X.chunks_t(s, d), None, precedence)


def _starts(s, d):
    """First line of every labelled document, one question per document."""
    return X.table(s, d, "labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-0")).alias("id"))


def _path_edges(nodes):
    """Neighbouring lines of a document: many paths, one per document."""
    return G.sequence_edges(nodes.withColumn("source_file", F.regexp_extract("id", "^c[0-9]+", 0)).withColumn(
        "heading_path", F.lit("")))


def _paths(s, d):
    """Paths and the questions that start on them; the nodes are made once."""
    nodes = cut_lineage(_nodes(s, d))
    return _path_edges(nodes), TR.known_starts(_starts(s, d), nodes)


def _components(s, d):
    nodes = cut_lineage(_nodes(s, d))
    edges = cut_lineage(G.heading_edges(nodes).unionByName(_path_edges(nodes)))
    return nodes, edges, TR.connected_components(nodes, edges)


def _with_prior(s, d):
    nodes = cut_lineage(_nodes(s, d))
    return G.category_edges(nodes, cut_lineage(G.heading_edges(nodes)))


def _cohesion(s, d):
    nodes = _nodes(s, d)
    by_source = nodes.select("id", F.concat_ws("/", "source_file", "category").alias("community_id"))
    return G.community_cohesion(_graph(s, d, "last")[1], by_source)


def _removed(s, d):
    nodes, edges = _graph(s, d, "last")
    sources = X.table(s, d, "documents").filter("lang = 'es'").select(
        F.concat("source", F.lit(".md")).alias("source_file")).distinct().filter("source_file like 'src1%'")
    return G.remove_source(nodes, edges, sources)


def _updated(s, d):
    old = X.chunks_t(s, d).filter("lang <> 'de'")
    nodes, edges = G.build_graph(old, None, "last")
    return G.update_graph(nodes, edges, X.chunks_t(s, d).filter("payload_file like 'src1%'"))


QUERIES = {
    "build_nodes": lambda s, d: _nodes(s, d).select("id", "label", "source_file", "category", "heading_path"),
    "heading_edges": lambda s, d: G.heading_edges(_nodes(s, d)).select(*EDGE),
    "cross_modal_edges": lambda s, d: G.cross_modal_edges(_nodes(s, d), X.bindings_t(s, d).withColumn(
        "video_clip_id", F.concat(F.lit("c"), F.regexp_extract("video_clip_id", "[0-9]+", 0), F.lit("-0")))).select(*EDGE),
    "category_edges": lambda s, d: G.category_edges(_nodes(s, d)).select(*EDGE),
    "category_edges_incremental": lambda s, d: G.category_edges_incremental(_nodes(s, d)).select(*EDGE),
    "category_edges_with_prior": lambda s, d: _with_prior(s, d).select(*EDGE),
    "sequence_edges": lambda s, d: G.sequence_edges(_nodes(s, d)).select(*EDGE),
    "graph_edges_first": lambda s, d: _graph(s, d)[1].select(*EDGE),
    "graph_edges_last": lambda s, d: _graph(s, d, "last")[1].select(*EDGE),
    "remove_source_edges": lambda s, d: _removed(s, d)[1].select(*EDGE),
    "remove_source_counts": lambda s, d: _removed(s, d)[2],
    "update_graph_nodes": lambda s, d: _updated(s, d)[0].select("id", "label"),
    "update_graph_edges": lambda s, d: _updated(s, d)[1].select(*EDGE),
    "node_degree": lambda s, d: G.node_degree(*_graph(s, d, "last")).select("id", "degree"),
    "hub_nodes": lambda s, d: G.hub_nodes(*_graph(s, d, "last")).select("id", "degree"),
    "community_cohesion": lambda s, d: _cohesion(s, d).withColumn("cohesion", F.round("cohesion", 6)),
    "connected_components": lambda s, d: _components(s, d)[2],
    "bfs_visited": lambda s, d: TR.bfs(*_paths(s, d), 3, 3)[0],
    "bfs_edges": lambda s, d: TR.bfs(*_paths(s, d), 3, 3)[1],
    "reachable": lambda s, d: TR.reachable(*_paths(s, d), 6),
    "modularity_communities": lambda s, d: TR.modularity_communities(*_graph(s, d, "last")),
}

NODES = X.CHUNKS_SQL + f""",
nodes AS (
  SELECT id, CASE WHEN heading_path <> '' THEN heading_path
      WHEN {X.sql_strip('substr(content, 1, 60)')} <> '' THEN replace({X.sql_strip('substr(content, 1, 60)')}, chr(10), ' ') || '...'
      ELSE 'chunk' END || ' [' || category || ']' AS label,
    payload_file AS source_file, category, heading_path,
    list_position({V.CATEGORIES}, category) * 1125899906842624 + seq AS node_seq, doc_id, seq FROM chunks_t)
"""
RANKED = NODES + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY category, source_file ORDER BY node_seq) - 1 AS p FROM nodes)
"""


def _und(a, b):
    return f"least({a}, {b}) AS src, greatest({a}, {b}) AS dst"


HEADING = NODES + f""",
firsts AS (SELECT heading_path, arg_min(id, node_seq) AS id FROM nodes WHERE heading_path <> '' GROUP BY 1),
heading_e AS (
  SELECT {_und('p.id', 'c.id')}, 'references' AS relation, '' AS source_file, 1.0::DOUBLE AS weight
  FROM firsts c JOIN firsts p ON p.heading_path = array_to_string(string_split(c.heading_path, ' > ')[:-2], ' > ')
  WHERE contains(c.heading_path, ' > '))
"""


def _cat(nodes: str, name: str, cond: str) -> str:
    return f"""
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY category, source_file ORDER BY node_seq) - 1 AS p FROM {nodes}),
{name} AS (
  SELECT {_und('a.id', 'b.id')}, 'conceptually_related_to' AS relation, a.source_file, 0.5::DOUBLE AS weight
  FROM {name}_p a JOIN {name}_p b ON a.category = b.category AND a.source_file = b.source_file AND a.p < b.p
  WHERE {cond})"""


def _seq(nodes: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {_und('id', 'nxt')}, 'references' AS relation, source_file, 0.3::DOUBLE AS weight FROM (
    SELECT id, source_file, lead(id) OVER (PARTITION BY source_file ORDER BY heading_path, node_seq) AS nxt FROM {nodes})
  WHERE nxt IS NOT NULL)"""


def _heads(nodes: str, name: str) -> str:
    return f"""
{name}_f AS (SELECT heading_path, arg_min(id, node_seq) AS id FROM {nodes} WHERE heading_path <> '' GROUP BY 1),
{name} AS (
  SELECT {_und('p.id', 'c.id')}, 'references' AS relation, '' AS source_file, 1.0::DOUBLE AS weight
  FROM {name}_f c JOIN {name}_f p ON p.heading_path = array_to_string(string_split(c.heading_path, ' > ')[:-2], ' > ')
  WHERE contains(c.heading_path, ' > '))"""


def _heads_per_file(nodes: str, name: str) -> str:
    return f"""
{name}f AS (SELECT source_file, heading_path, arg_min(id, node_seq) AS id FROM {nodes} WHERE heading_path <> '' GROUP BY 1, 2),
{name} AS (
  SELECT {_und('p.id', 'c.id')}, 'references' AS relation, '' AS source_file, 1.0::DOUBLE AS weight
  FROM {name}f c JOIN {name}f p ON p.source_file = c.source_file
    AND p.heading_path = regexp_replace(c.heading_path, ' > [^>]*$', '') AND p.heading_path <> c.heading_path
  WHERE p.id <> c.id)"""


def _last_graph(nodes: str, tag: str) -> str:
    """Later rules overwrite earlier ones."""
    return (_heads_per_file(nodes, f"{tag}_h") + "," + _cat(nodes, f"{tag}_c", "a.p < 5") + "," + _seq(nodes, f"{tag}_s") + f""",
{tag} AS (
  SELECT src, dst, relation, source_file, weight FROM (
    SELECT *, 0 AS prio FROM {tag}_h UNION ALL SELECT *, 1 FROM {tag}_c UNION ALL SELECT *, 2 FROM {tag}_s)
  QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY prio DESC) = 1)""")


# added sources: nodes in file order, headings of one file
ADDED = NODES.replace("nodes AS (", "all_nodes AS (", 1) + ", nodes AS (SELECT * REPLACE (seq AS node_seq) FROM all_nodes)"
LAST = ADDED + "," + _last_graph("nodes", "g")
_PATHS = NODES + f""",
path_e AS (
  SELECT {_und('id', 'nxt')} FROM (SELECT id, lead(id) OVER (PARTITION BY doc_id ORDER BY node_seq) AS nxt FROM nodes) WHERE nxt IS NOT NULL),
sym AS (SELECT src AS a, dst AS b FROM path_e UNION ALL SELECT dst, src FROM path_e),
starts AS (SELECT 'q' || doc_id AS query_id, 'c' || doc_id || '-0' AS id FROM labels WHERE 'c' || doc_id || '-0' IN (SELECT id FROM nodes))
"""
# on a path the level of a node is its distance from the start
_LEVELS = _PATHS + """,
walk AS (
  SELECT query_id, id, 0 AS depth FROM starts
  UNION SELECT w.query_id, s.b, w.depth + 1 FROM walk w JOIN sym s ON s.a = w.id WHERE w.depth < {limit}),
levels AS (SELECT query_id, id, min(depth) AS depth FROM walk GROUP BY 1, 2),
sizes AS (SELECT query_id, depth, sum(count(*)) OVER (PARTITION BY query_id ORDER BY depth) AS upto FROM levels GROUP BY 1, 2),
open_levels AS (SELECT l.query_id, l.depth FROM (SELECT DISTINCT query_id, depth FROM levels) l
  WHERE NOT EXISTS (SELECT 1 FROM sizes z WHERE z.query_id = l.query_id AND z.depth < l.depth AND z.upto >= 3))
"""
_REMOVE = LAST + """,
gone AS (SELECT DISTINCT source || '.md' AS source_file FROM documents WHERE lang = 'es' AND source LIKE 'src1%'),
kept AS (SELECT id FROM nodes WHERE source_file NOT IN (SELECT source_file FROM gone))
"""
_UPDATE = ADDED + """,
oldn AS (SELECT n.* FROM nodes n JOIN chunks_t c USING (id) WHERE c.lang <> 'de'),
newn AS (SELECT * FROM nodes WHERE source_file LIKE 'src1%'),""" + _last_graph("oldn", "og") + "," + _last_graph("newn", "ng") + """,
keepn AS (SELECT * FROM oldn WHERE source_file NOT LIKE 'src1%')
"""

ORACLE = {
    "build_nodes": "WITH " + NODES + "SELECT id, label, source_file, category, heading_path FROM nodes",
    "heading_edges": "WITH " + HEADING + "SELECT * FROM heading_e",
    "cross_modal_edges": "WITH " + NODES + "," + X.MEDIA_SQL + f""",
        b AS (SELECT pdf_anchor_id AS a, 'c' || regexp_extract(video_clip_id, '[0-9]+') || '-0' AS b FROM bindings_t)
        SELECT DISTINCT {_und('a', 'b')}, 'shares_data_with' AS relation, '' AS source_file, 1.0::DOUBLE AS weight FROM b
        WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes) AND a <> b""",
    "category_edges": "WITH " + NODES + "," + _cat("nodes", "cat_e", "a.p < 5 OR b.p <= 10") + "SELECT * FROM cat_e",
    "category_edges_incremental": "WITH " + NODES + "," + _cat("nodes", "cat_e", "a.p < 5") + "SELECT * FROM cat_e",
    "sequence_edges": "WITH " + NODES + "," + _seq("nodes", "seq_e") + "SELECT * FROM seq_e",
    "graph_edges_last": "WITH " + LAST + "SELECT * FROM g",
    "remove_source_edges": "WITH " + _REMOVE + "SELECT * FROM g WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)",
    "remove_source_counts": "WITH " + _REMOVE + """SELECT source_file, count(*) AS removed FROM nodes
        WHERE source_file IN (SELECT source_file FROM gone) GROUP BY 1""",
    "update_graph_nodes": "WITH " + _UPDATE + "SELECT id, label FROM keepn UNION ALL SELECT id, label FROM newn",
    "update_graph_edges": "WITH " + _UPDATE + """SELECT src, dst, relation, source_file, weight FROM (
        SELECT *, 0 AS prio FROM og WHERE src IN (SELECT id FROM keepn) AND dst IN (SELECT id FROM keepn)
        UNION ALL SELECT *, 1 FROM ng) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY prio DESC) = 1""",
    "node_degree": "WITH " + LAST + """, ends AS (SELECT src AS id FROM g UNION ALL SELECT dst FROM g)
        SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id""",
    "hub_nodes": "WITH " + LAST + """, ends AS (SELECT src AS id FROM g UNION ALL SELECT dst FROM g)
        SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id, n.node_seq
        ORDER BY degree DESC, n.node_seq LIMIT 10""",
    "community_cohesion": "WITH " + LAST + """,
        com AS (SELECT id, source_file || '/' || category AS community_id FROM nodes),
        sz AS (SELECT community_id, count(*) AS n_nodes FROM com GROUP BY 1),
        inn AS (SELECT a.community_id, count(*) AS n_edges FROM g JOIN com a ON a.id = src JOIN com b ON b.id = dst
          WHERE a.community_id = b.community_id GROUP BY 1)
        SELECT community_id, n_nodes, coalesce(n_edges, 0) AS n_edges,
          CASE WHEN n_nodes <= 1 THEN 0.0 ELSE round(coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2.0), 6) END AS cohesion
        FROM sz LEFT JOIN inn USING (community_id)""",
    # documents are paths; heading edges join documents, so labels spread over documents first
    "connected_components": "WITH RECURSIVE " + HEADING + """,
        dn AS (SELECT id, doc_id FROM nodes), droot AS (SELECT doc_id, min(id) AS lbl FROM nodes GROUP BY 1),
        de AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM heading_e JOIN dn a ON a.id = src JOIN dn b ON b.id = dst WHERE a.doc_id <> b.doc_id),
        ds AS (SELECT x, y FROM de UNION SELECT y, x FROM de),
        reach AS (SELECT doc_id AS r, doc_id AS x FROM droot UNION SELECT r, ds.y FROM reach JOIN ds ON ds.x = reach.x),
        dcom AS (SELECT reach.r AS doc_id, min(lbl) AS community_id FROM reach JOIN droot ON droot.doc_id = reach.x GROUP BY 1)
        SELECT dn.id, community_id FROM dn JOIN dcom USING (doc_id)""",
    "bfs_visited": "WITH RECURSIVE " + _LEVELS.replace("{limit}", "3") + """SELECT l.query_id, l.id, l.depth FROM levels l
        JOIN open_levels o ON o.query_id = l.query_id AND o.depth = l.depth""",
    "bfs_edges": "WITH RECURSIVE " + _LEVELS.replace("{limit}", "3") + """SELECT a.query_id, a.id AS from_id, b.id AS to_id, b.depth
        FROM levels a JOIN sym s ON s.a = a.id JOIN levels b ON b.query_id = a.query_id AND b.id = s.b AND b.depth = a.depth + 1
        JOIN open_levels o ON o.query_id = b.query_id AND o.depth = b.depth""",
    "reachable": "WITH RECURSIVE " + _LEVELS.replace("{limit}", "6") + "SELECT query_id, id, depth FROM levels",
}
