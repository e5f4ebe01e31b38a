"""Column functions, filters, aggregates and chunk-table changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.functions import text as T, vocab as V
from quillgraph.operators import aggregates as A, conversation as CV, filters as P, review as R, store as U
from quillgraph.sources import chunk_json as J

NOW = F.lit  # timestamps of the test store are plain text


def _now():
    return F.lit("2024-06-01T00:00:00")


def _ascii(name):
    """Other characters as a question mark each: the SQL counts bytes."""
    return F.regexp_replace(name, r"[^\x00-\x7F]", "?")


def _labels_ids(s, d):
    """Ids of the first line of labelled toxic documents: the ids edited since the last search."""
    return X.table(s, d, "labels").filter("toxic = 1").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-0")).alias("id"))


def _edits(s, d):
    """Edits for the first lines of all labelled documents."""
    return X.table(s, d, "labels").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-0")).alias("id"),
        F.concat(F.lit("edited "), F.col("quality").cast("string")).alias("content"),
        F.when(F.col("quality") == 1, F.lit("parameter")).otherwise(F.lit("")).alias("category"),
        F.col("doc_id").alias("seq"))


def _sync(s, d, delete=False):
    return U.sync_chunks(X.l2_t(s, d), X.store_t(s, d), delete, _now())


SYNC_COLS = ["id", "content", "category", "heading_path", "is_manual", "version"]
STORE_COLS = ["id", "content", "category", "heading_path", "is_manual", "version"]


def _hits_like(s, d):
    """Chunks of a source as ranked hits of one question per language."""
    return CV.position_in_group(X.chunks_t(s, d).select("lang", "id", "seq", "category", "heading_path"),
                                ["lang"], ["seq"], "rank").withColumnRenamed("lang", "query_id")


QUERIES = {
    "filter_category": lambda s, d: P.filter_category(X.chunks_t(s, d), "general").select("id", "content"),
    "filter_heading_prefix": lambda s, d: P.filter_heading_prefix(X.chunks_t(s, d), "SRC1 > e").select("id", "heading_path"),
    "filter_by_source": lambda s, d: P.filter_by_source(X.chunks_t(s, d), "dir/src3.md").select("id"),
    "filter_by_source_contains": lambda s, d: P.filter_by_source(X.chunks_t(s, d), "SRC1", "contains").select("id"),
    "filter_any_column": lambda s, d: P.filter_any_column(
        X.chunks_t(s, d).select("id", "heading_path", "category"), " P3 GEN").select("id"),
    "exclude_ids": lambda s, d: P.exclude_ids(X.chunks_t(s, d), _labels_ids(s, d)).select("id"),
    "known_category_nodes": lambda s, d: P.known_category_nodes(X.chunks_t(s, d)).select("id", "cat_rank"),
    "list_headings": lambda s, d: A.list_headings(X.chunks_t(s, d)),
    "count_chunks": lambda s, d: A.count_chunks(X.chunks_t(s, d)),
    "chunk_type_counts": lambda s, d: A.chunk_type_counts(X.chunks_t(s, d)),
    "dominant_category": lambda s, d: A.dominant_category(_hits_like(s, d)),
    "hit_heading_paths": lambda s, d: A.hit_heading_paths(_hits_like(s, d)).select(
        "query_id", F.array_join("heading_paths", ";").alias("paths")),
    "diff_status": lambda s, d: U.diff_chunks(X.l2_t(s, d), X.store_t(s, d)).select("chunk_id", "status"),
    "diff_counts": lambda s, d: U.diff_counts(X.l2_t(s, d), X.store_t(s, d)),
    "sync_actions": lambda s, d: _sync(s, d, True)[1].select("source_file", "id", "action"),
    "sync_counts": lambda s, d: A.sync_counts(_sync(s, d, True)[1]),
    "sync_store": lambda s, d: _sync(s, d, True)[0].select(*SYNC_COLS),
    "sync_store_keep": lambda s, d: _sync(s, d, False)[0].select(*SYNC_COLS),
    "upsert_chunks": lambda s, d: U.upsert_chunks(
        X.store_t(s, d), X.chunks_t(s, d).filter(F.col("lang") == "fr").select(*X.store_t(s, d).columns), _now()).select(*STORE_COLS),
    "update_chunks": lambda s, d: U.update_chunks(X.store_t(s, d), _edits(s, d)).select(*STORE_COLS),
    "delete_chunks": lambda s, d: U.delete_chunks(X.store_t(s, d), _labels_ids(s, d)).select("id"),
    "edit_chunks_l2": lambda s, d: U.edit_chunks_l2(
        X.l2_t(s, d), _edits(s, d).withColumnRenamed("id", "chunk_id").select("chunk_id", "content")).select(
        "chunk_id", "content", "display_content", "is_manual"),
    "upsert_chunks_all": lambda s, d: U.upsert_chunks(
        X.store_all(s, d), X.chunks_t(s, d).filter(F.col("lang") == "fr").select(*X.store_all(s, d).columns), _now()).select(*STORE_COLS),
    "update_chunks_all": lambda s, d: U.update_chunks(X.store_all(s, d), _edits(s, d)).select(*STORE_COLS),
    "delete_chunks_all": lambda s, d: U.delete_chunks(X.store_all(s, d), _labels_ids(s, d)).select("id"),
    "edit_chunks_l2_all": lambda s, d: U.edit_chunks_l2(
        X.l2_all(s, d), _edits(s, d).withColumnRenamed("id", "chunk_id").select("chunk_id", "content")).select(
        "chunk_id", "content", "display_content", "is_manual"),
    "read_with_evolution": lambda s, d: J.read_with_evolution(
        X.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
                                          F.col("source").alias("source_type"), F.col("n_chars").alias("embedding")))
        .select("id", "source_type", "category", "heading_path", "version", F.length("content").alias("n")),
    # column functions over whole texts
    "heuristic_category": lambda s, d: X.table(s, d, "documents").select("doc_id", T.heuristic_category("text").alias("category")),
    "collapse_and_preview": lambda s, d: X.table(s, d, "documents").select(
        "doc_id", T.collapse_ws("text").alias("flat"), T.preview("text", 90).alias("preview"),
        T.truncate("text", 1200).alias("cut")),
    "time_labels": lambda s, d: X.segments_t(s, d).select(
        "video_file", "seq", T.time_range("start_sec", "end_sec").alias("range"), T.mm_ss("start_sec").alias("at")),
    "safe_names": lambda s, d: X.table(s, d, "pages").select(
        "page_id", T.safe_label("url").alias("label"), T.safe_stem("url").alias("stem"), T.safe_type("url").alias("kind"),
        T.basename("url").alias("base")),
    "query_terms": lambda s, d: X.queries_t(s, d).select(
        "query_id", F.array_join(T.query_terms("query"), "¦").alias("terms"),
        F.array_join(T.rank_terms("query"), "¦").alias("rank_terms")),
    "char_bigrams": lambda s, d: X.queries_t(s, d).select(
        "query_id", F.array_join(T.char_bigrams(T.query_terms("query")), "¦").alias("grams")),
    "levenshtein_pairs": lambda s, d: X.table(s, d, "nation").alias("a").join(
        X.table(s, d, "nation").alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(
        F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"),
        F.levenshtein(F.col("a.n_name"), F.col("b.n_name")).alias("dist")),
    "levenshtein_turns": lambda s, d: X.turns_t(s, d).select(
        "conv_id", "turn", F.levenshtein(_ascii("query"), _ascii("answer")).alias("dist")),
    "is_followup": lambda s, d: X.turns_t(s, d).select("conv_id", "turn", T.is_followup("query").alias("followup")),
    "rich_content": lambda s, d: X.docs_md(s, d).select("doc_id", T.has_rich_content("text").alias("rich")),
    "page_rich_content": lambda s, d: X.table(s, d, "pages").select("page_id", T.has_rich_content("html").alias("rich")),
    "extract_links": lambda s, d: R.extract_links(X.docs_md(s, d), "doc_id", "text"),
    "highlight": lambda s, d: X.table(s, d, "documents").select(
        "doc_id", T.highlight(F.col("text"), F.concat_ws(" ", F.col("lang"), F.lit("the"), F.col("source"))).alias("html")),
    "json_payloads": lambda s, d: X.table(s, d, "events").select(
        "event_id", T.json_or_empty("props", "k int")["k"].alias("k"),
        T.first_json_object(F.concat(F.lit("answer: "), F.col("props"), F.lit(" done")), "k int")["k"].alias("k2")),
}

_EVOLVED = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_type, 'general' AS category, '' AS heading_path, 1 AS version, length(text) AS n FROM documents"
_TOK = r"[A-Za-z0-9_.:/\\-]{2,}|[\x{4e00}-\x{9fff}]{2,}"


def _uniq(lst: str) -> str:
    return f"list_filter({lst}, lambda t, i: list_position({lst}, t) = i)"


_QT = _uniq(f"list_concat(CASE WHEN {X.sql_collapse('lower(query)')} = '' THEN [] ELSE [{X.sql_collapse('lower(query)')}] END, "
            f"list_transform(regexp_extract_all(query, '{_TOK}'), lambda t: lower(t)))")
_RT = _uniq(f"list_concat(list_transform(list_filter(regexp_split_to_array(query, '[{X.SQL_WS}]+'), lambda t: length(t) > 1), "
            f"lambda t: lower(t)), list_transform(regexp_extract_all(query, '{_TOK}'), lambda t: lower(t)))")
_GRAMS = "flatten(list_transform(terms, lambda t: list_transform(range(1, length(t)), lambda i: substr(t, i, 2))))"

_HITS = X.CHUNKS_SQL + """,
hits AS (SELECT lang AS query_id, id, category, heading_path, row_number() OVER (PARTITION BY lang ORDER BY seq) - 1 AS rank FROM chunks_t)
"""
_LAB = ", gone AS (SELECT 'c' || doc_id || '-0' AS id FROM labels WHERE toxic = 1)"
_EDIT_CTE = """, edits AS (SELECT 'c' || doc_id || '-0' AS id, 'edited ' || quality AS content,
  CASE WHEN quality = 1 THEN 'parameter' ELSE '' END AS category FROM labels)"""
_DIFF = X.L2_SQL + f""",
diff AS (
  SELECT l.*, o.version AS o_version, o.id IS NULL AS isnew, o.is_manual AS o_manual,
    {X.sql_strip('l.content')} <> {X.sql_strip('o.content')} OR (l.heading_path <> '' AND l.heading_path <> o.heading_path) AS chg
  FROM l2_t l LEFT JOIN store_t o ON l.chunk_id = o.id)
"""
_ACT = _DIFF + """,
act AS (SELECT source_file, chunk_id AS id, CASE WHEN isnew THEN 'inserted' WHEN chg THEN 'updated' ELSE 'skipped' END AS action FROM diff),
orphan AS (SELECT s.payload_file AS source_file, s.id FROM store_t s WHERE s.payload_file IN (SELECT source_file FROM l2_t)
  AND s.id NOT IN (SELECT chunk_id FROM l2_t)),
actions AS (SELECT * FROM act UNION ALL SELECT source_file, id, 'deleted' FROM orphan)
"""
_SYNCED = _ACT + f""",
synced AS (
  SELECT d.chunk_id AS id, d.content, {X.sql_category("d.source_file || ' ' || d.heading_path || ' ' || substr(d.content, 1, 300)")} AS category,
    d.heading_path, d.is_manual, CASE WHEN isnew THEN 1 ELSE o_version + 1 END AS version FROM diff d WHERE isnew OR chg
  UNION ALL SELECT id, content, category, heading_path, is_manual, version FROM store_t
    WHERE id NOT IN (SELECT chunk_id FROM diff WHERE isnew OR chg))
"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLE = {
    "filter_category": "WITH " + X.CHUNKS_SQL + "SELECT id, content FROM chunks_t WHERE category = 'general'",
    "filter_heading_prefix": "WITH " + X.CHUNKS_SQL + "SELECT id, heading_path FROM chunks_t WHERE starts_with(lower(heading_path), 'src1 > e')",
    "filter_by_source": "WITH " + X.CHUNKS_SQL + "SELECT id FROM chunks_t WHERE payload_file IN ('src3.md', 'dir/src3.md')",
    "filter_by_source_contains": "WITH " + X.CHUNKS_SQL + """SELECT id FROM chunks_t WHERE contains(payload_file, 'src1')
        OR regexp_matches(content, '[sS][rR][cC]1')""",
    "filter_any_column": "WITH " + X.CHUNKS_SQL + """SELECT id FROM chunks_t
        WHERE contains(lower(id || ' ' || heading_path || ' ' || category), 'p3 gen')""",
    "exclude_ids": "WITH " + X.CHUNKS_SQL + _LAB + "SELECT id FROM chunks_t WHERE id NOT IN (SELECT id FROM gone)",
    "known_category_nodes": "WITH " + X.CHUNKS_SQL + f"""SELECT id, list_position({V.CATEGORIES}, category) AS cat_rank FROM chunks_t""",
    "list_headings": "WITH " + X.CHUNKS_SQL + """SELECT heading_path, count(*) AS chunk_count, min(category) AS category
        FROM chunks_t WHERE heading_path <> '' GROUP BY heading_path""",
    "count_chunks": "WITH " + X.CHUNKS_SQL + "SELECT count(*) AS chunk_count FROM chunks_t",
    "chunk_type_counts": "WITH " + X.CHUNKS_SQL + "SELECT source_type, count(*) AS chunk_count FROM chunks_t GROUP BY 1",
    "dominant_category": "WITH " + _HITS + """SELECT query_id, category FROM (SELECT query_id, category,
        row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS r FROM hits GROUP BY 1, 2) WHERE r = 1""",
    "hit_heading_paths": "WITH " + _HITS + """SELECT query_id, string_agg(heading_path, ';' ORDER BY r) AS paths FROM (
        SELECT query_id, heading_path, min(rank) AS r FROM hits WHERE heading_path <> '' GROUP BY 1, 2) GROUP BY 1""",
    "diff_status": "WITH " + _DIFF + """SELECT chunk_id, CASE WHEN isnew THEN 'new' WHEN chg THEN 'changed' ELSE 'unchanged' END
        AS status FROM diff""",
    "diff_counts": "WITH " + _DIFF + """SELECT source_file, count(*) FILTER (isnew) AS new, count(*) FILTER (NOT isnew AND chg) AS changed,
        count(*) FILTER (NOT isnew AND NOT chg) AS unchanged, count(*) AS total FROM diff GROUP BY 1""",
    "sync_actions": "WITH " + _ACT + "SELECT * FROM actions",
    "sync_counts": "WITH " + _ACT + "SELECT source_file, " + ", ".join(
        f"count(*) FILTER (action = '{a}') AS {a}" for a in ("inserted", "updated", "deleted", "skipped", "errors"))
        + " FROM actions GROUP BY 1",
    "sync_store": "WITH " + _SYNCED + "SELECT * FROM synced WHERE id NOT IN (SELECT id FROM orphan)",
    "sync_store_keep": "WITH " + _SYNCED + "SELECT * FROM synced",
    "upsert_chunks": "WITH " + X.L2_SQL + """SELECT id, content, category, heading_path, is_manual, version FROM chunks_t WHERE lang = 'fr'
        UNION ALL SELECT id, content, category, heading_path, is_manual, version FROM store_t
        WHERE id NOT IN (SELECT id FROM chunks_t WHERE lang = 'fr')""",
    "update_chunks": "WITH " + X.L2_SQL + _EDIT_CTE + """SELECT s.id, coalesce(e.content, s.content) AS content,
        coalesce(nullif(e.category, ''), s.category) AS category, heading_path, e.id IS NOT NULL OR is_manual AS is_manual,
        version + CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS version FROM store_t s LEFT JOIN edits e ON s.id = e.id""",
    "delete_chunks": "WITH " + X.L2_SQL + _LAB + "SELECT id FROM store_t WHERE id NOT IN (SELECT id FROM gone)",
    "edit_chunks_l2": "WITH " + X.L2_SQL + _EDIT_CTE + """SELECT chunk_id, coalesce(e.content, l.content) AS content,
        coalesce(e.content, l.content) AS display_content, e.id IS NOT NULL OR is_manual AS is_manual
        FROM l2_t l LEFT JOIN edits e ON l.chunk_id = e.id""",
    "upsert_chunks_all": "WITH " + X.ALL_SQL + """SELECT id, content, category, heading_path, is_manual, version FROM chunks_t WHERE lang = 'fr'
        UNION ALL SELECT id, content, category, heading_path, is_manual, version FROM store_all
        WHERE id NOT IN (SELECT id FROM chunks_t WHERE lang = 'fr')""",
    "update_chunks_all": "WITH " + X.ALL_SQL + _EDIT_CTE + """SELECT s.id, coalesce(e.content, s.content) AS content,
        coalesce(nullif(e.category, ''), s.category) AS category, heading_path, e.id IS NOT NULL OR is_manual AS is_manual,
        version + CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS version FROM store_all s LEFT JOIN edits e ON s.id = e.id""",
    "delete_chunks_all": "WITH " + X.ALL_SQL + _LAB + "SELECT id FROM store_all WHERE id NOT IN (SELECT id FROM gone)",
    "edit_chunks_l2_all": "WITH " + X.ALL_SQL + _EDIT_CTE + """SELECT chunk_id, coalesce(e.content, l.content) AS content,
        coalesce(e.content, l.content) AS display_content, e.id IS NOT NULL OR is_manual AS is_manual
        FROM l2_all l LEFT JOIN edits e ON l.chunk_id = e.id""",
    "read_with_evolution": _EVOLVED,
    "heuristic_category": f"SELECT doc_id, {X.sql_category('text')} AS category FROM documents",
    "collapse_and_preview": f"""SELECT doc_id, f AS flat, CASE WHEN length(f) > 90 THEN substr(f, 1, 90) || '...' ELSE f END AS preview,
        CASE WHEN length(t) > 1200 THEN regexp_replace(substr(t, 1, 1200), '[{X.SQL_WS}]+$', '') || '...' ELSE t END AS cut
        FROM (SELECT doc_id, {X.sql_collapse('text')} AS f, {X.sql_strip('text')} AS t FROM documents)""",
    "time_labels": "WITH " + X.SEGMENTS_SQL + """SELECT video_file, seq, format('{:.1f}s-{:.1f}s', start_sec, end_sec) AS range,
        CASE WHEN start_sec >= 6000 THEN CAST(floor(start_sec / 60) AS BIGINT)::VARCHAR
             ELSE lpad(CAST(floor(start_sec / 60) AS BIGINT)::VARCHAR, 2, '0') END
        || ':' || lpad((CAST(floor(start_sec) AS BIGINT) % 60)::VARCHAR, 2, '0') AS at FROM segments_t""",
    "safe_names": """SELECT page_id, coalesce(nullif(lower(trim(substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 1, 36), '._-')), ''), 'item') AS label,
        coalesce(nullif(trim(regexp_replace(regexp_replace(b, '^(.+)\\.[^.]+$', '\\1'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'pdf') AS stem,
        coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') AS kind, b AS base
        FROM (SELECT *, regexp_extract(url, '([^/]*)/*$', 1) AS b FROM pages)""".replace("\\\\", "\\"),
    "query_terms": "WITH " + X.QUERIES_SQL + f"SELECT query_id, array_to_string({_QT}, '¦') AS terms, array_to_string({_RT}, '¦') AS rank_terms FROM queries_t",
    "char_bigrams": "WITH " + X.QUERIES_SQL + f"SELECT query_id, array_to_string({_GRAMS}, '¦') AS grams FROM (SELECT query_id, {_QT} AS terms FROM queries_t)",
    "levenshtein_pairs": """SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS dist
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""",
    "levenshtein_turns": "WITH " + X.TURNS_SQL + r"""SELECT conv_id, turn, levenshtein(
        regexp_replace(query, '[^\x00-\x7F]', '?', 'g'), regexp_replace(answer, '[^\x00-\x7F]', '?', 'g')) AS dist FROM turns_t""",
    "is_followup": "WITH " + X.TURNS_SQL + f"SELECT conv_id, turn, regexp_matches(query, '{'|'.join(V.FOLLOWUP_MARKERS)}') AS followup FROM turns_t",
    "rich_content": "WITH " + X.DOCS_MD_SQL + rf"""SELECT doc_id, regexp_matches(text, '{V.RICH_TAG}')
        OR regexp_matches(text, '\[[^\]]+\]\([^)\s]+(\s+"[^"]*")?\)') OR regexp_matches(text, '!\[[^\]]*\]\([^)\s]+(\s+"[^"]*")?\)') AS rich FROM docs_md""",
    "page_rich_content": rf"""SELECT page_id, regexp_matches(html, '{V.RICH_TAG}') OR regexp_matches(html, '\[[^\]]+\]\([^)\s]+\)') AS rich FROM pages""",
    "extract_links": "WITH " + X.DOCS_MD_SQL + r"""
        SELECT doc_id, pos, kind, label, target FROM (
          SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS tag,
            CASE WHEN starts_with(unnest(m), '!') THEN 'image' ELSE 'link' END AS kind,
            regexp_extract(unnest(m), '!?\[([^\]]*)\]\(([^)\s]+)', 1) AS label,
            regexp_extract(unnest(m), '!?\[([^\]]*)\]\(([^)\s]+)', 2) AS target
          FROM (SELECT doc_id, regexp_extract_all(text, '!\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)|\[[^\]]+\]\([^)\s]+(?:\s+"[^"]*")?\)') AS m FROM docs_md))""",
    "highlight": "SELECT doc_id, replace(replace(" + _ESC.format(
        r"regexp_replace(text, '(?i)(' || lang || ' the ' || source || '|' || source || '|the|' || lang || ')', "
        r"chr(57344) || '\1' || chr(57345), 'g')")
        + ", chr(57344), '<mark>'), chr(57345), '</mark>') AS html FROM documents",
    "json_payloads": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) AS k2 FROM events",
}
