"""Review documents, exports, correction loop and log queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.catalog import chunking as CC
from quillgraph.catalog.streams import _qa_rows
from quillgraph.operators import aggregates as A, chunking as C, conversation as CV, graph as G, review as R, traversal as TR
from quillgraph.operators.ordering import cut_lineage, scratch_path
from quillgraph.plans import ingest as I, optimize as O, prompts as P
from quillgraph.sources import chunk_json as J, files as FS

AT = "2024-01-01T00:00:00"


def _lines(s, d, chunks=None):
    """Document lines as the chunks of one file per document."""
    c = X.chunks_t(s, d) if chunks is None else chunks
    return c.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), "source_type",
        F.col("id").alias("chunk_id"), "anchor_id", "content", F.col("content").alias("display_content"),
        F.concat(F.lit("[Type: text]\n\n"), "content").alias("embedding_text"), "heading_path", "is_manual",
        (F.col("seq") % 100000).cast("int").alias("page"), F.lit("text").alias("block_type"), F.lit(True).alias("stored"),
        "seq", "lang", "doc_id")


def _files(s, d, variant, lines=None):
    """Review documents put together per document."""
    pieces = R.render_review_markdown(_lines(s, d, cut_lineage(X.chunks_t(s, d))) if lines is None else lines, AT, variant)
    return pieces.groupBy(F.col("source_file").alias("file")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("piece", "markdown"))), lambda p: p["markdown"]), "\n").alias("text"))


def _careless(lines):
    """Lines after edits that a round trip must notice: every second French line altered, the last line of Spanish documents lost."""
    lost = cut_lineage(lines.filter("lang = 'es'").groupBy("doc_id").agg(F.max("seq").alias("seq")))
    altered = (F.col("lang") == "fr") & (F.col("page") % 2 == 0)
    return lines.join(lost, ["doc_id", "seq"], "left_anti").withColumn(
        "content", F.when(altered, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))).withColumn(
        "display_content", F.col("content"))


def _roundtrip(s, d):
    lines = _lines(s, d, cut_lineage(X.chunks_t(s, d)))
    return R.roundtrip_check(*(R.parse_review_text(_files(s, d, variant, rows)) for variant, rows in (
        ("edit", lines), ("export", _careless(lines)))))


def _review_rows(s, d):
    """Parsed rows after hand edits: French lines rewritten, German ones without their id."""
    base = CV.position_in_group(_lines(s, d), ["source_file"], ["seq"], "ordinal")
    return base, base.select(
        "source_file", "source_type", "ordinal", (F.col("ordinal") + 1).alias("chunk_no"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("lang") == "fr", F.concat("content", F.lit(" !"))).otherwise(F.col("content")).alias("content"),
        F.when(F.col("page") == 0, "New > Path").otherwise("").alias("heading_path"), F.lit("").alias("block_type"),
        F.when(F.col("page") == 1, "checked").otherwise("").alias("notes"))


def _suggestions(s, d):
    """Suggestions for lines by their number: updates, deletions and chains of merges."""
    c = _lines(s, d)
    k = F.col("seq") % 100000 % 7
    return c.select(
        "chunk_id", F.col("seq").alias("pos"),
        F.when(k == 1, "update").when(k == 2, "delete").when(k.isin(3, 4), "merge_with_next").otherwise("keep").alias("action"),
        F.when(F.col("lang") == "en", F.concat(F.lit("better "), "chunk_id")).otherwise("  ").alias("optimized_content"),
        F.concat(F.regexp_extract("chunk_id", "^(c[0-9]+-)", 1), (F.col("seq") % 100000 + 1).cast("string")).alias("merge_target_id"),
        F.lit("r").alias("reason"))


def _qa_log(s, d, whole=False):
    """The QA log with some rows reviewed."""
    n = F.length("query")
    return _qa_rows(s, d, whole).withColumn("human_review", F.struct(
        F.lit("").alias("expected_answer"), F.when(n % 2 == 0, "correct").otherwise("unreviewed").alias("verdict"),
        F.lit(None).cast("double").alias("accuracy_score"), F.lit(None).cast("double").alias("retrieval_score"),
        F.lit("n").alias("notes"), F.lit("").alias("chunking_action"))).withColumn(
        "created_at", F.concat(F.lpad(n.cast("string"), 6, "0"), F.lit("/"), F.sha1("query")))


def _requests(s, d):
    return O.optimization_requests(_lines(s, d), O.recent_reviewed(_qa_log(s, d)), 10)


def _responses(s, d):
    """Model responses per document: fenced JSON that deletes the first line; broken for French documents."""
    first = _lines(s, d).groupBy("source_file", "lang").agg(F.min_by("chunk_id", "seq").alias("chunk_id"))
    body = F.to_json(F.struct(
        F.array(F.struct("chunk_id", F.lit("delete").alias("action"), F.lit("x").alias("reason"))).alias("optimized_chunks"),
        F.array(F.lit("split"), F.concat(F.lit("lang "), "lang"), F.lit("split")).alias("global_suggestions")))
    return first.select("source_file", F.lit(0).cast("bigint").alias("batch_no"), F.when(
        F.col("lang") == "fr", F.lit("no json")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("raw"))


def _ingested(s, d):
    docs = X.docs_md(s, d)
    store = s.createDataFrame([], ", ".join(f"{n} {t}" for n, t in J.STORE_FIELDS.items()))
    nodes, edges = (s.createDataFrame([], FS.GRAPH_SCHEMAS[n]) for n in ("nodes", "edges"))
    return I.ingest(docs, store, nodes, edges, F.lit(AT), recluster=False)


def _rebuilt(s, d):
    chunks = cut_lineage(X.chunks_t(s, d))
    return I.rebuild(X.l2_all(s, d, chunks), X.store_all(s, d, chunks), X.bindings_t(s, d), F.lit(AT))


def _json_files(s, d):
    path = scratch_path(s, "json")
    J.write_chunk_json(_lines(s, d), path, AT)
    return J.read_chunk_json(s, path)


def _review_files(s, d):
    path = scratch_path(s, "review")
    FS.write_review_chunks(_lines(s, d), path, AT)
    return FS.read_review_markdown(s, path)


def _graph_files(s, d):
    path = scratch_path(s, "graph")
    nodes, edges = G.build_graph(X.chunks_t(s, d), None, "last")
    FS.write_graph(path, nodes=nodes, edges=edges)
    back = FS.read_graph(s, path)
    return back["edges"].select("src", "dst", "relation", "source_file", "weight"), back["communities"]


def _csv_files(s, d):
    path = scratch_path(s, "csv")
    FS.write_benchmark_rows(X.runs_t(s, d).withColumnRenamed("run_id", "run_index"), path)
    return s.read.option("header", True).csv(path)


QUERIES = {
    "chunk_envelopes": lambda s, d: J.chunk_envelopes(_lines(s, d).withColumn("source_file", F.concat("lang", F.lit(".md"))), AT, 500).select(
        "source_file", "part", "chunk_count", F.size(F.from_json("json", J.ENVELOPE)["chunks"]).alias("n")),
    "chunk_json_roundtrip": lambda s, d: _json_files(s, d).select(
        "source_file", "chunk_id", "page", "heading_path", "content", "embedding_text", "stored"),
    "export_store_rows": lambda s, d: J.export_store_rows(X.store_t(s, d), "dir/src3.md").select(
        "source_file", "chunk_id", "stored", "heading_path", "content"),
    "export_store_rows_all": lambda s, d: J.export_store_rows(X.store_all(s, d), "dir/src3.md").select(
        "source_file", "chunk_id", "stored", "heading_path", "content"),
    "review_markdown": lambda s, d: R.render_review_markdown(_lines(s, d), AT, "export"),
    "review_markdown_edit": lambda s, d: R.render_review_markdown(_lines(s, d), AT, "edit"),
    "review_parsed": lambda s, d: R.parse_review_text(_files(s, d, "export")).select(
        "source_file", "source_type", "ordinal", "chunk_no", "chunk_id", "page", "stored", "block_type", "content"),
    "review_files_roundtrip": lambda s, d: _review_files(s, d).select(
        "source_file", "source_type", "ordinal", "chunk_no", "chunk_id", "page", "stored", "block_type", "content"),
    "merge_review": lambda s, d: R.merge_review_edits(*reversed(_review_rows(s, d))).select(
        "source_file", "ordinal", "chunk_id", "heading_path", "content", "embedding_text", "is_manual", "notes"),
    "roundtrip_check": lambda s, d: _roundtrip(s, d),
    "apply_suggestions": lambda s, d: R.apply_suggestions(_lines(s, d), _suggestions(s, d)).select(
        "chunk_id", "content", "is_manual"),
    "number_batches": lambda s, d: CV.number_batches(X.chunks_t(s, d), 10, ("payload_file",)).select(
        "id", "batch_no", "pos_in_batch"),
    "opt_requests": lambda s, d: _requests(s, d).select("source_file", "batch_no", "n_chunks", F.array_join(F.transform(
        F.from_json("request", "chunks array<struct<chunk_id:string>>")["chunks"], lambda c: c["chunk_id"]), ",").alias("ids"),
        F.size(F.from_json("request", "qa_samples array<struct<question:string>>")["qa_samples"]).alias("n_samples")),
    "opt_apply": lambda s, d: O.optimization_apply(_lines(s, d), _responses(s, d))[0].select("chunk_id", "content"),
    "opt_suggestions": lambda s, d: O.optimization_apply(_lines(s, d), _responses(s, d))[1].select("source_file", "text"),
    "qa_samples": lambda s, d: O.recent_reviewed(_qa_log(s, d)).select(
        "question", "answer", "verdict", F.array_join("retrieved_chunks", "¦").alias("chunks")),
    "filter_reviewed": lambda s, d: _qa_log(s, d).transform(_reviewed).select("query"),
    "qa_review_text": lambda s, d: P.render_qa_review(_qa_rows(s, d)).select(F.expr("substr(markdown, instr(markdown, '### Question'))").alias("text")),
    "qa_samples_all": lambda s, d: O.recent_reviewed(_qa_log(s, d, True)).select(
        "question", "answer", "verdict", F.array_join("retrieved_chunks", "¦").alias("chunks")),
    "filter_reviewed_all": lambda s, d: _qa_log(s, d, True).transform(_reviewed).select(
        "query", F.size("retrieved_context").alias("n"), F.array_join(F.transform("retrieved_context", lambda h: h["document"]), "¦").alias("hits")),
    "qa_review_text_all": lambda s, d: P.render_qa_review(_qa_rows(s, d, True)).select(F.col("markdown").alias("text")),
    "trace_rows": lambda s, d: _trace(s, d),
    "graph_files": lambda s, d: _graph_files(s, d)[0],
    "benchmark_csv": lambda s, d: _csv_files(s, d).select(
        F.col("run_index").cast("bigint").alias("run_index"), "parser", F.col("seconds").cast("double").alias("seconds"),
        F.col("is_warmup").cast("boolean").alias("is_warmup")),
    "summary_markdown": lambda s, d: FS.summary_markdown(A.summarize_runs(X.runs_t(s, d))).select("line"),
    "ingest_store": lambda s, d: _ingested(s, d).store.select("id", "content", "category", "heading_path", "payload_file", "version"),
    "ingest_actions": lambda s, d: A.sync_counts(_ingested(s, d).actions),
    "rebuild_edges": lambda s, d: _rebuilt(s, d).edges.groupBy("relation").agg(F.count("*").alias("n")),
}


def _reviewed(df):
    from quillgraph.operators.filters import filter_reviewed
    return filter_reviewed(df)


def _trace(s, d):
    from quillgraph.catalog.search import _text_hits
    q, hits = X.queries_t(s, d), cut_lineage(_text_hits(s, d))
    prompts = P.build_prompts(q, hits)
    return P.trace_rows(q, hits, prompts, P.retrieval_answers(q, hits)).select(
        "query_id", "prompt_chars", F.length("answer").alias("answer_chars"), F.coalesce(F.size("hits"), F.lit(0)).alias("n"),
        F.array_join(F.transform("hits", lambda h: h["content"]), "¦").alias("contents"))


LINES = X.CHUNKS_SQL + """,
lines_t AS (SELECT 'doc_' || doc_id || '.md' AS source_file, source_type, id AS chunk_id, anchor_id, content,
  '[Type: text]' || chr(10) || chr(10) || content AS embedding_text, heading_path, seq % 100000 AS page, seq, lang, doc_id,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM chunks_t)
"""
_HEAD = ("'# Markdown Chunk Export' || chr(10) || chr(10) || '- Source file: ' || source_file || chr(10) || '- Source type: markdown' || chr(10) || "
         "'- Chunk count: ' || count(*) || chr(10) || '- Exported at: 2024-01-01T00:00:00' || chr(10)")
_FENCE = "CASE WHEN contains(content, '```') THEN '````' ELSE '```' END"


def _piece(edit: bool) -> str:
    meta = ("'## Chunk ' || n || chr(10) || chr(10) || '- chunk_id: ' || chunk_id || chr(10) || '- anchor_id: ' || anchor_id || chr(10) || '- page: ' || page "
            "|| chr(10) || '- vector_dim: None' || chr(10) || '- stored: true' || chr(10)"
            + (" || '- is_manual: false' || chr(10)" if edit else "")
            + " || '- block_type: text' || chr(10) || CASE WHEN heading_path <> '' THEN '- heading_path: ' || heading_path || chr(10) ELSE '' END || chr(10)")
    block = lambda t: f"{_FENCE} || 'text' || chr(10) || {t} || chr(10) || {_FENCE} || chr(10)"
    if edit:
        return meta + " || " + block("content")
    return (meta + " || '### Display Content' || chr(10) || chr(10) || " + block("content")
            + " || chr(10) || '### Embedding Text' || chr(10) || chr(10) || " + block("embedding_text"))


def _render(edit: bool) -> str:
    return "WITH " + LINES + f"""SELECT source_file, source_type, 0 AS piece, {_HEAD} AS markdown FROM lines_t GROUP BY 1, 2
        UNION ALL SELECT source_file, source_type, n, {_piece(edit)} FROM lines_t"""


_QA = X.TURNS_SQL + "," + X.CHUNKS_SQL + f""",
hd AS (SELECT doc_id, seq % 100000 + 1 AS rank, id, CASE WHEN length(content) > 160 THEN regexp_replace(substr(content, 1, 160), '[{X.SQL_WS}]+$', '') || '...'
  ELSE content END AS doc FROM chunks_t WHERE heading_path <> ''),
log AS (SELECT conv_id, turn, query, answer, CASE WHEN answer = '' THEN 'no_results' ELSE 'llm' END AS mode,
  CASE WHEN length(query) % 2 = 0 THEN 'correct' ELSE 'unreviewed' END AS verdict, lpad(length(query)::VARCHAR, 6, '0') || '/' || sha1(query) AS created_at FROM turns_t)
"""
_SAMPLES = _QA + """, tail AS (SELECT * FROM log ORDER BY created_at DESC LIMIT 40),
smp AS (SELECT * FROM tail WHERE verdict <> 'unreviewed' ORDER BY created_at DESC LIMIT 20)
"""

ORACLE = {
    "chunk_envelopes": "WITH " + LINES + """, p AS (SELECT lang || '.md' AS source_file, row_number() OVER (PARTITION BY lang ORDER BY seq) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS chunk_count FROM lines_t)
        SELECT source_file, pos // 500 AS part, chunk_count, count(*) AS n FROM p GROUP BY ALL""",
    "chunk_json_roundtrip": "WITH " + LINES + "SELECT source_file, chunk_id, page, heading_path, content, embedding_text, true AS stored FROM lines_t",
    "export_store_rows": "WITH " + X.L2_SQL + """SELECT 'src3.md' AS source_file, id AS chunk_id, true AS stored, heading_path, content
        FROM store_t WHERE payload_file = 'src3.md'""",
    "export_store_rows_all": "WITH " + X.ALL_SQL + """SELECT 'src3.md' AS source_file, id AS chunk_id, true AS stored, heading_path, content
        FROM store_all WHERE payload_file = 'src3.md'""",
    "review_markdown": _render(False),
    "review_markdown_edit": _render(True),
    "review_parsed": "WITH " + LINES + """SELECT source_file, source_type, n - 1 AS ordinal, n AS chunk_no, chunk_id, page, true AS stored,
        'text' AS block_type, content FROM lines_t""",
    "review_files_roundtrip": "WITH " + LINES + """SELECT source_file, source_type, n - 1 AS ordinal, n AS chunk_no, chunk_id, page, true AS stored,
        'text' AS block_type, content FROM lines_t""",
    "merge_review": "WITH " + LINES + """SELECT source_file, n - 1 AS ordinal, chunk_id,
        CASE WHEN page = 0 THEN 'New > Path' ELSE heading_path END AS heading_path,
        CASE WHEN lang = 'fr' THEN content || ' !' ELSE content END AS content,
        CASE WHEN lang = 'fr' THEN content || ' !' ELSE embedding_text END AS embedding_text, lang = 'fr' AS is_manual,
        CASE WHEN page = 1 THEN 'checked' END AS notes FROM lines_t""",
    "roundtrip_check": "WITH " + LINES + """, last AS (SELECT doc_id, max(n) AS m FROM lines_t GROUP BY 1)
        SELECT source_file, n - 1 AS ordinal, content AS a, CASE WHEN lang = 'fr' THEN content || ' (edited)' END AS b
        FROM lines_t JOIN last USING (doc_id) WHERE (lang = 'fr' AND page % 2 = 0) OR (lang = 'es' AND n = m)""",
    "apply_suggestions": "WITH RECURSIVE " + LINES + """,
        sg AS (SELECT *, CASE page % 7 WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'merge' WHEN 4 THEN 'merge' ELSE 'keep' END AS act,
          lead(page) OVER w = page + 1 AS has_next, lead(content) OVER w AS next_content FROM lines_t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
        st AS (SELECT doc_id, n, false AS skip, act = 'merge' AND has_next AS runs FROM sg WHERE n = 1
          UNION ALL SELECT g.doc_id, g.n, st.runs, NOT st.runs AND g.act = 'merge' AND coalesce(g.has_next, false) FROM st JOIN sg g ON g.doc_id = st.doc_id AND g.n = st.n + 1)
        SELECT chunk_id, CASE WHEN act = 'update' AND lang = 'en' THEN 'better ' || chunk_id
            WHEN act = 'merge' AND has_next THEN content || chr(10) || chr(10) || next_content ELSE content END AS content,
          (act = 'update' AND lang = 'en') OR (act = 'merge' AND coalesce(has_next, false)) AS is_manual
        FROM sg JOIN st USING (doc_id, n) WHERE NOT coalesce(skip, false) AND act <> 'delete'""",
    "number_batches": "WITH " + X.CHUNKS_SQL + """SELECT id, p // 10 AS batch_no, p % 10 AS pos_in_batch FROM (
        SELECT id, row_number() OVER (PARTITION BY payload_file ORDER BY seq) - 1 AS p FROM chunks_t)""",
    "opt_requests": "WITH " + LINES + "," + _SAMPLES.replace(X.CHUNKS_SQL + ",", "", 1) + """SELECT source_file, (n - 1) // 10 AS batch_no, count(*) AS n_chunks,
        string_agg(chunk_id, ',' ORDER BY n) AS ids, (SELECT count(*) FROM smp) AS n_samples FROM lines_t GROUP BY 1, 2""",
    "opt_apply": "WITH " + LINES + "SELECT chunk_id, content FROM lines_t WHERE n > 1 OR lang = 'fr'",
    "opt_suggestions": "WITH " + LINES + """, l AS (SELECT DISTINCT source_file, lang FROM lines_t WHERE lang <> 'fr')
        SELECT source_file, 'split' AS text FROM l UNION ALL SELECT source_file, 'lang ' || lang FROM l""",
    "qa_samples": "WITH " + _SAMPLES + """SELECT query AS question, substr(answer, 1, 400) AS answer, verdict,
        coalesce((SELECT string_agg(substr(doc, 1, 300), '¦' ORDER BY rank) FROM hd WHERE hd.doc_id = smp.conv_id AND rank <= 3), '') AS chunks FROM smp""",
    "filter_reviewed": "WITH " + _QA + "SELECT query FROM log WHERE verdict <> 'unreviewed'",
    "qa_review_text": "WITH " + _QA + """SELECT '### Question' || chr(10) || chr(10) || query || chr(10) || chr(10) || '### Answer' || chr(10) || chr(10) || answer
        || chr(10) || chr(10) || '### Retrieved Chunks' || chr(10) || chr(10) || coalesce((SELECT string_agg('#### Hit ' || rank || chr(10) || chr(10) || '- id: ' || id
          || chr(10) || '- anchor_id: ' || id || chr(10) || '- source_type: markdown' || chr(10) || '- distance: None' || chr(10) || chr(10) || '```text' || chr(10) || doc
          || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY rank) FROM hd WHERE hd.doc_id = log.conv_id), '')
        || '### Human Review' || chr(10) || chr(10) || '- Expected answer: ' || chr(10) || '- Notes: ' || chr(10) AS text FROM log""",
    "qa_samples_all": None,
    "filter_reviewed_all": None,
    "qa_review_text_all": None,
    "graph_files": None,
    "benchmark_csv": "WITH " + X.RUNS_SQL + "SELECT run_id AS run_index, parser, seconds, is_warmup FROM runs_t",
    "ingest_store": None,
    "ingest_actions": None,
}


def _fill() -> None:
    from quillgraph.catalog import graph as GC, media as MC, search as SC
    ORACLE["summary_markdown"] = "WITH " + X.RUNS_SQL + ", r AS (" + MC._SUM.replace("WHERE_MORE", "") + """)
        SELECT '| ' || parser || ' | ' || ok_count || '/' || total || ' (' || format('{:.1f}', success_rate) || '%) | ' || format('{:.3f}', avg_time)
          || ' | ' || format('{:.3f}', p50_time) || ' | ' || format('{:.3f}', p95_time) || ' | ' || format('{:.3f}', avg_blocks) || ' |' AS line FROM r"""
    answers = SC.ORACLE["retrieval_answers"].replace("'模型不可用' || chr(10) || chr(10) || ", "")
    ORACLE["trace_rows"] = SC.ORACLE["prompts"].replace("SELECT query_id, n_hits, prompt FROM prompts", "") + (
        ", ans AS (" + answers[answers.index("SELECT q.query_id, coalesce("):] + """)
        SELECT q.query_id, length(p.prompt) AS prompt_chars, length(a.answer) AS answer_chars, coalesce(h.n, 0) AS n, h.contents
        FROM queries_t q LEFT JOIN prompts p USING (query_id) LEFT JOIN ans a USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(substr(content, 1, 240), '¦' ORDER BY rank) AS contents FROM found
          WHERE rank <= 5 GROUP BY 1) h USING (query_id)""")
    # all lines are hits, of 1200 characters at most
    whole = lambda sql: sql.replace("content) > 160", "content) > 1200").replace("content, 1, 160)", "content, 1, 1200)").replace(
        "AS doc FROM chunks_t WHERE heading_path <> '')", "AS doc FROM chunks_t)")
    ORACLE["qa_samples_all"] = whole(ORACLE["qa_samples"])
    ORACLE["filter_reviewed_all"] = "WITH " + whole(_QA) + """, ha AS (
        SELECT doc_id, count(*) AS n, string_agg(doc, '¦' ORDER BY rank) AS hits FROM hd GROUP BY doc_id)
        SELECT query, coalesce(n, 0) AS n, coalesce(hits, '') AS hits FROM log LEFT JOIN ha ON doc_id = conv_id WHERE verdict <> 'unreviewed'"""
    # ahead of the question: the entry's id and time, mode and blank marks
    ident = "sha256(conv_id || '-' || turn || '|2024-01-01T00:00:00')"
    ORACLE["qa_review_text_all"] = whole(ORACLE["qa_review_text"]).replace("SELECT '### Question'", f"""SELECT chr(10) || '## QA 2024-01-01T00:00:00  `' || {ident}
        || '`' || chr(10) || chr(10) || '- Mode: ' || mode || chr(10) || '- Verdict: unreviewed' || chr(10) || '- Accuracy score: ' || chr(10)
        || '- Retrieval score: ' || chr(10) || '- Chunking action: ' || chr(10) || chr(10) || '### Question'""", 1)
    ORACLE["graph_files"] = "WITH " + GC.LAST + "SELECT * FROM g"
    base = CC.ORACLE["chunk_documents_md"]
    name = "regexp_extract(source_file, '([^/]*)$', 1)"
    ORACLE["ingest_store"] = base[:base.rindex("SELECT doc_id, seq, id, page")] + (
        f"SELECT id, content, category, heading_path, {name} AS payload_file, 1 AS version FROM final")
    ORACLE["ingest_actions"] = base[:base.rindex("SELECT doc_id, seq, id, page")] + (
        f"SELECT {name} AS source_file, count(*) AS inserted, 0 AS updated, 0 AS deleted, 0 AS skipped, 0 AS errors FROM final GROUP BY 1")


_fill()
