"""Stream queries: the given tables written as files, read as a stream to the end, compared as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.catalog.search import _condense_sql
from quillgraph.operators.ordering import scratch_path
from quillgraph.plans import prompts as P
from quillgraph.sources import files as FS
from quillgraph.streaming import asr, conversation as SC, ingest as SI


def _asr_lines(s, d):
    """Speech events of all videos as JSON lines, with a diagnostic line per video."""
    seg = X.segments_t(s, d)
    one = seg.select(F.to_json(F.struct(
        F.lit("segment").alias("type"), "video_file", F.struct(
            F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text",
            F.lit(0.5).alias("confidence")).alias("segment"))).alias("value"))
    twice = one.unionByName(seg.filter("is_clip").select(F.to_json(F.struct(
        F.lit("segment").alias("type"), "video_file", F.struct(
            F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text",
            F.lit(0.5).alias("confidence")).alias("segment"))).alias("value")))
    videos = seg.groupBy("video_file").agg(F.count("*").alias("n"))
    meta = videos.select(F.to_json(F.struct(
        F.lit("meta").alias("type"), "video_file", (F.col("n") * 40000.0).alias("duration"))).alias("value"))
    noise = videos.select(F.concat(F.lit("loading "), "video_file").alias("value"))
    # a third of the videos end, a third fail, the others are still running
    ends = videos.filter("n % 3 < 2").select(F.to_json(F.struct(
        F.when(F.col("n") % 3 == 0, "done").otherwise("error").alias("type"), "video_file", F.lit("m").alias("message"))).alias("value"))
    path = scratch_path(s, "asr")
    # three files in no order, so some segments arrive after the end of their video
    twice.unionByName(meta).unionByName(noise).unionByName(ends).repartition(3).write.text(path)
    return path


def _run_to_end(s, rows, mode="append"):
    out, ck = scratch_path(s, "out"), scratch_path(s, "ck")
    asr.write_stream(rows, out, ck, mode).awaitTermination()
    return s.read.parquet(out)


def _stream_asr(s, d):
    return _run_to_end(s, asr.segments(asr.asr_events(asr.read_lines(s, _asr_lines(s, d), 1))))


def _stream_dedup(s, d):
    return _run_to_end(s, asr.dedup_segments(asr.segments(asr.asr_events(asr.read_lines(s, _asr_lines(s, d), 1))), "1 hour"))


def _stream_progress(s, d):
    steps = _run_to_end(s, asr.live_progress(asr.asr_events(asr.read_lines(s, _asr_lines(s, d), 1))))
    return steps.groupBy("video_file").agg(F.max_by("progress", "step").alias("progress"), F.max_by("status", "step").alias("status"))


def _stream_condense(s, d):
    path = scratch_path(s, "turns")
    turns = X.turns_t(s, d)
    # three files, one after the other
    for part in ("turn <= 1", "turn between 2 and 3", "turn > 3"):
        turns.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _run_to_end(s, SC.conversation_state(stream))


def _qa_rows(s, d, whole=False):
    """Log rows; ``whole`` takes every line of a document as a hit, up to the operator's own length."""
    t = X.turns_t(s, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "query", "answer", F.when(
            F.col("answer") == "", "no_results").otherwise("llm").alias("mode"), "conv_id")
    lines = X.chunks_t(s, d)
    first = (lines if whole else lines.filter(F.col("heading_path") != "")).select(
        "doc_id", "id", "anchor_id", "source_type", "content", (F.col("seq") % 100000 + 1).alias("rank"))
    hits = first.join(t.select("query_id", "conv_id"), first.doc_id == F.col("conv_id")).drop("doc_id", "conv_id")
    return P.qa_log_rows(t.drop("conv_id"), hits, F.lit("2024-01-01T00:00:00"), *([] if whole else [160]))


def _stream_qa_log(s, d, whole=False):
    src, out = scratch_path(s, "qa"), scratch_path(s, "log")
    rows = _qa_rows(s, d, whole)
    rows.write.parquet(src)
    SI.qa_log_stream(s.readStream.schema(rows.schema).parquet(src), out, scratch_path(s, "ck")).awaitTermination()
    return FS.read_qa_log(s, out)


def _stream_ingest(s, d):
    src, root = scratch_path(s, "docs"), scratch_path(s, "corpus")
    docs = X.docs_md(s, d)
    docs.repartition(3).write.parquet(src)
    stream = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    SI.incremental_ingest(stream, root, scratch_path(s, "ck")).awaitTermination()
    return SI.snapshot(s, root)


def _log_columns(log):
    return log.select(
        "mode", "query", "answer", F.col("human_review.verdict").alias("verdict"), F.array_join(F.transform(
            "retrieved_context", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["document"])), "¦").alias("hits"))


QUERIES = {
    "stream_qa_log_all": lambda s, d: _log_columns(_stream_qa_log(s, d, True)),
    "stream_asr": lambda s, d: _stream_asr(s, d),
    "stream_dedup": lambda s, d: _stream_dedup(s, d),
    "stream_progress": lambda s, d: _stream_progress(s, d).withColumn("progress", F.round("progress", 6)),
    "stream_condense": lambda s, d: _stream_condense(s, d).select(
        "conv_id", "turn", "standalone_query", F.array_join(F.transform(
            "history", lambda h: F.concat(h["query"], F.lit("="), h["answer"])), "¦").alias("history")),
    "stream_qa_log": lambda s, d: _stream_qa_log(s, d).select(
        "mode", "query", "answer", F.col("human_review.verdict").alias("verdict"), F.array_join(F.transform(
            "retrieved_context", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["document"])), "¦").alias("hits")),
    "stream_ingest_store": lambda s, d: _stream_ingest(s, d)["store"].select(
        "id", "content", "category", "heading_path", "payload_file", "version"),
    "stream_ingest_edges": lambda s, d: _stream_ingest(s, d)["edges"].select("src", "dst", "relation", "source_file", "weight"),
    "stream_ingest_communities": lambda s, d: _stream_ingest(s, d)["communities"],
}

ORACLE = {
    "stream_qa_log_all": "WITH " + X.TURNS_SQL + "," + X.CHUNKS_SQL + f""",
        h AS (SELECT doc_id, string_agg((seq % 100000 + 1) || ':' || CASE WHEN length(content) > 1200
            THEN regexp_replace(substr(content, 1, 1200), '[{X.SQL_WS}]+$', '') || '...' ELSE content END, '¦' ORDER BY seq) AS hits
          FROM chunks_t GROUP BY 1)
        SELECT CASE WHEN answer = '' THEN 'no_results' ELSE 'llm' END AS mode, query, answer, 'unreviewed' AS verdict, coalesce(hits, '') AS hits
        FROM turns_t LEFT JOIN h ON h.doc_id = conv_id""",
    "stream_asr": "WITH " + X.SEGMENTS_SQL + """SELECT video_file, start_sec, end_sec, text, 0.5 AS confidence FROM segments_t
        UNION ALL SELECT video_file, start_sec, end_sec, text, 0.5 FROM segments_t WHERE is_clip""".replace("0.5", "0.5::DOUBLE"),
    "stream_dedup": "WITH " + X.SEGMENTS_SQL + "SELECT DISTINCT video_file, start_sec, end_sec, text, 0.5::DOUBLE AS confidence FROM segments_t",
    "stream_progress": "WITH " + X.SEGMENTS_SQL + """SELECT video_file, round(least(max(end_sec) / (count(*) * 40000.0::DOUBLE), 1.0), 6) AS progress,
        CASE count(*) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'running' END AS status FROM segments_t GROUP BY 1""",
    "stream_condense": "WITH RECURSIVE " + _condense_sql('"', '"') + """SELECT c.conv_id, c.turn, c.standalone_query,
        coalesce(string_agg(b.query || '=' || b.answer, '¦' ORDER BY b.p), '') AS history FROM cond c LEFT JOIN tn b ON b.conv_id = c.conv_id
        AND b.p BETWEEN c.p - 5 AND c.p - 1 GROUP BY 1, 2, 3""",
    "stream_qa_log": "WITH " + X.TURNS_SQL + "," + X.CHUNKS_SQL + f""",
        h AS (SELECT doc_id, string_agg((seq % 100000 + 1) || ':' || CASE WHEN length(content) > 160
            THEN regexp_replace(substr(content, 1, 160), '[{X.SQL_WS}]+$', '') || '...' ELSE content END, '¦' ORDER BY seq) AS hits
          FROM chunks_t WHERE heading_path <> '' GROUP BY 1)
        SELECT CASE WHEN answer = '' THEN 'no_results' ELSE 'llm' END AS mode, query, answer, 'unreviewed' AS verdict, coalesce(hits, '') AS hits
        FROM turns_t LEFT JOIN h ON h.doc_id = conv_id""",
}


def _fill() -> None:
    from quillgraph.catalog import chunking as CC, graph as GC
    base = CC.ORACLE["chunk_documents_md"]
    ORACLE["stream_ingest_store"] = base[:base.rindex("SELECT doc_id, seq, id, page")] + (
        "SELECT id, content, category, heading_path, regexp_extract(source_file, '([^/]*)$', 1) AS payload_file, "
        "1 AS version FROM final")
    # every file is one document, and its chunks are linked in a row
    graph = base[:base.rindex("SELECT doc_id, seq, id, page")] + """,
nodes AS (SELECT id, regexp_extract(source_file, '([^/]*)$', 1) AS source_file, category, heading_path, doc_id * 1000000 + seq AS node_seq FROM final),"""
    ORACLE["stream_ingest_edges"] = graph + GC._last_graph("nodes", "g") + "SELECT src, dst, relation, source_file, weight FROM g"
    ORACLE["stream_ingest_communities"] = graph.rstrip(",") + """
        SELECT id, min(id) OVER (PARTITION BY source_file) AS community_id FROM nodes"""


_fill()
