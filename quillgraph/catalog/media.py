"""Transcripts, clips, bindings and benchmark runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.operators import aggregates as A, media as M


def _points(s, d):
    """Every event as a point in time of some other user's video."""
    e = X.table(s, d, "events")
    return e.select(
        F.col("event_id").alias("point_id"),
        F.concat(F.lit("video_"), ((F.col("user_id") * 7 + 1) % 150).cast("string"), F.lit(".mp4")).alias("video_file"),
        F.round(X._seconds(F.col("ts")), 3).alias("t"))


def _anchors(s, d):
    c = X.chunks_t(s, d)
    return c.select("anchor_id", F.col("payload_file").alias("source_file"), "content",
                    F.col("content").alias("display_content"))


def _hits(s, d):
    """First two lines of every document as its hits."""
    c = X.chunks_t(s, d).filter(F.col("heading_path") != "")
    return c.select(F.col("doc_id").alias("query_id"), "id", "anchor_id", "source_type", "content",
                    (F.col("seq") % 100000 + 1).alias("rank"))


def _all_hits(s, d):
    """All lines of every document as its hits."""
    return X.chunks_t(s, d).select(F.col("doc_id").alias("query_id"), "id", "anchor_id", "source_type", "content",
                                   (F.col("seq") % 100000 + 1).alias("rank"))


def _pairs(s, d):
    """Labels as wanted bindings of clips and chunks."""
    return X.table(s, d, "labels").select(
        F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("clip-"), F.col("doc_id").cast("string")).alias("video_clip_id"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("quality").cast("string")).alias("pdf_anchor_id"),
        F.lit("").alias("note"), F.col("doc_id").alias("created_at"))


def _moves(s, d):
    return X.bindings_t(s, d).filter(F.col("note") != "").select("id", F.lit("c0-0").alias("pdf_anchor_id"))


QUERIES = {
    "list_bindings": lambda s, d: M.list_bindings(X.bindings_t(s, d), X.clips_t(s, d)).select(
        "id", "pdf_anchor_id", "video_file", "start_sec", "semantic_summary"),
    "binding_status": lambda s, d: M.binding_status(X.bindings_t(s, d), X.clips_t(s, d), _anchors(s, d)).select(
        "id", "status", "anchor_source", "anchor_preview"),
    "augment_with_clips": lambda s, d: M.augment_with_clips(_hits(s, d), X.bindings_t(s, d), X.clips_t(s, d)).select(
        "query_id", "rank", "id", "anchor_id", "source_type", "content", "video_file"),
    "augment_with_clips_all": lambda s, d: M.augment_with_clips(_all_hits(s, d), X.bindings_t(s, d), X.clips_t(s, d)).select(
        "query_id", "rank", "id", "anchor_id", "source_type", "content", "video_file"),
    "transcript_at": lambda s, d: M.transcript_at(_points(s, d), X.segments_t(s, d)).select(
        "point_id", "video_file", "start_sec", "text"),
    "bind": lambda s, d: M.bind(X.bindings_t(s, d), _pairs(s, d)).select("id", "video_clip_id", "pdf_anchor_id"),
    "rebind": lambda s, d: M.rebind(X.bindings_t(s, d), _moves(s, d)).select("id", "pdf_anchor_id"),
    "unbind": lambda s, d: M.unbind(X.bindings_t(s, d), _moves(s, d)).select("id", "pdf_anchor_id"),
    "register_clips": lambda s, d: M.register_clips(X.clips_t(s, d))[1].select(
        "id", "content", "source_type", "anchor_id", "is_manual"),
    "list_clips": lambda s, d: M.list_clips(X.clips_t(s, d), "video_7.mp4").select("id", "start_sec"),
    "transcript": lambda s, d: M.transcript(X.segments_t(s, d), "video_7.mp4").select("seq", "start_sec", "text"),
    "transcript_stats": lambda s, d: A.transcript_stats(X.segments_t(s, d)),
    "segment_progress": lambda s, d: M.segment_progress(X.segments_t(s, d), X.table(s, d, "events").groupBy(
        F.concat(F.lit("video_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("video_file")).agg(
        F.max("value").alias("duration")).withColumn("duration", F.col("duration") * 1000)).select(
        "video_file", "seq", F.round("progress", 6).alias("progress")),
    "run_summary": lambda s, d: A.summarize_runs(X.runs_t(s, d)),
    "run_deltas": lambda s, d: A.compare_runs(
        A.summarize_runs(X.runs_t(s, d)), A.summarize_runs(X.runs_t(s, d).filter("block_count < 50 and parser <> 'view'"))),
}

def _r3(x: str) -> str:
    return f"CAST(format('{{:.3f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _pct(p: float) -> str:
    """Linear interpolation between the two neighbouring ranks."""
    rank = f"((len(l) - 1) * {p}::DOUBLE)"
    low = f"CAST(floor({rank}) AS BIGINT)"
    return (f"(l[{low} + 1] * (1 - ({rank} - {low})) + l[least({low} + 2, len(l))] * ({rank} - {low}))")


_SUM = f"""
  SELECT parser, total, ok_count, {_r3('ok_count * 100.0::DOUBLE / total')} AS success_rate, {_r3('a')} AS avg_time,
    {_r3('lo')} AS min_time, {_r3('hi')} AS max_time, {_r3('b')} AS avg_blocks, {_r3(_pct(0.5))} AS p50_time,
    {_r3(_pct(0.95))} AS p95_time
  FROM (SELECT parser, count(*) AS total, count(*) FILTER (ok) AS ok_count, avg(seconds) AS a, min(seconds) AS lo,
      max(seconds) AS hi, avg(block_count) AS b, list(seconds ORDER BY seconds) AS l
    FROM runs_t WHERE NOT is_warmup WHERE_MORE GROUP BY parser)"""
_ANCH = X.CHUNKS_SQL + "," + X.MEDIA_SQL
_PAIRS = """, pairs AS (SELECT 'n-' || doc_id AS id, 'clip-' || doc_id AS video_clip_id,
  'c' || doc_id || '-' || quality AS pdf_anchor_id FROM labels)"""
_MEASURES = ["success_rate", "avg_time", "p95_time", "avg_blocks"]

ORACLE = {
    "list_bindings": "WITH " + X.MEDIA_SQL + """SELECT b.id, pdf_anchor_id, video_file, start_sec, semantic_summary
        FROM bindings_t b LEFT JOIN clips_t c ON c.id = b.video_clip_id""",
    "binding_status": "WITH " + _ANCH + """SELECT b.id, coalesce(a.payload_file, '') AS anchor_source, coalesce(a.content, '') AS anchor_preview,
        CASE WHEN a.id IS NULL AND c.id IS NULL THEN 'Anchor缺失 / Clip缺失' WHEN a.id IS NULL THEN 'Anchor缺失'
             WHEN c.id IS NULL THEN 'Clip缺失' ELSE 'OK' END AS status
        FROM bindings_t b LEFT JOIN clips_t c ON c.id = b.video_clip_id LEFT JOIN chunks_t a ON a.anchor_id = b.pdf_anchor_id""",
    "augment_with_clips": "WITH " + _ANCH + """,
        hits AS (SELECT doc_id AS query_id, id, anchor_id, source_type, content, seq % 100000 + 1 AS rank FROM chunks_t WHERE heading_path <> ''),
        x AS (SELECT h.query_id, b.video_clip_id AS id, b.pdf_anchor_id AS anchor_id, b.note, b.created_at, b.id AS map_id,
            c.video_file, c.semantic_summary
          FROM (SELECT DISTINCT query_id, anchor_id FROM hits) h JOIN bindings_t b ON b.pdf_anchor_id = h.anchor_id
          LEFT JOIN clips_t c ON c.id = b.video_clip_id
          QUALIFY row_number() OVER (PARTITION BY h.query_id, b.video_clip_id ORDER BY b.created_at DESC, b.id) = 1)
        SELECT query_id, rank, id, anchor_id, source_type, content, NULL AS video_file FROM hits
        UNION ALL SELECT x.query_id, m + row_number() OVER (PARTITION BY x.query_id ORDER BY created_at DESC, map_id), id, anchor_id, 'video',
          coalesce(nullif(trim(semantic_summary), ''), '已绑定视频片段') || CASE WHEN note <> '' THEN chr(10) || '备注: ' || note ELSE '' END,
          coalesce(video_file, '') FROM x JOIN (SELECT query_id, max(rank) AS m FROM hits GROUP BY 1) USING (query_id)""",
    "transcript_at": "WITH " + X.SEGMENTS_SQL + """,
        pts AS (SELECT event_id AS point_id, 'video_' || ((user_id * 7 + 1) % 150) || '.mp4' AS video_file,
          round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 3) AS t FROM events),
        hit AS (SELECT p.point_id, s.start_sec, s.text FROM pts p JOIN segments_t s ON s.video_file = p.video_file
          AND p.t BETWEEN s.start_sec AND s.end_sec AND NOT s.is_clip
          QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY s.seq) = 1)
        SELECT p.point_id, p.video_file, h.start_sec, h.text FROM pts p LEFT JOIN hit h USING (point_id)""",
    "bind": "WITH " + X.MEDIA_SQL + _PAIRS + """SELECT id, video_clip_id, pdf_anchor_id FROM bindings_t
        UNION ALL SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM bindings_t b WHERE b.video_clip_id = p.video_clip_id
          AND b.pdf_anchor_id = p.pdf_anchor_id)""",
    "rebind": "WITH " + X.MEDIA_SQL + "SELECT id, CASE WHEN note <> '' THEN 'c0-0' ELSE pdf_anchor_id END AS pdf_anchor_id FROM bindings_t",
    "unbind": "WITH " + X.MEDIA_SQL + """SELECT id, pdf_anchor_id FROM bindings_t
        WHERE id NOT IN (SELECT id FROM bindings_t WHERE note <> '')""",
    "register_clips": "WITH " + X.MEDIA_SQL + """SELECT id, '[视频切片] 文件: ' || video_file || chr(10) || '时间: ' || format('{:.2f}', start_sec)
        || 's - ' || format('{:.2f}', end_sec) || 's' || chr(10) || '摘要: ' || trim(semantic_summary) AS content, 'video' AS source_type,
        id AS anchor_id, true AS is_manual FROM clips_t WHERE start_sec < end_sec AND trim(semantic_summary) <> ''""",
    "list_clips": "WITH " + X.MEDIA_SQL + "SELECT id, start_sec FROM clips_t WHERE video_file = 'video_7.mp4'",
    "transcript": "WITH " + X.SEGMENTS_SQL + "SELECT seq, start_sec, text FROM segments_t WHERE video_file = 'video_7.mp4'",
    "transcript_stats": "WITH " + X.SEGMENTS_SQL + """SELECT video_file, count(*) AS segment_count, min(start_sec) AS first_start,
        max(end_sec) AS last_end FROM segments_t GROUP BY 1""",
    "segment_progress": "WITH " + X.SEGMENTS_SQL + """SELECT video_file, seq, round(least(end_sec / CASE WHEN d = 0 THEN 1 ELSE d END, 1.0), 6) AS progress
        FROM segments_t JOIN (SELECT 'video_' || user_id || '.mp4' AS video_file, max(value) * 1000 AS d FROM events GROUP BY 1) USING (video_file)""",
    "run_summary": "WITH " + X.RUNS_SQL + _SUM.replace("WHERE_MORE", ""),
    "run_deltas": "WITH " + X.RUNS_SQL + ", cur AS (" + _SUM.replace("WHERE_MORE", "") + "), prev AS ("
        + _SUM.replace("WHERE_MORE", "AND block_count < 50 AND parser <> 'view'") + ") SELECT c.parser, "
        + ", ".join(f"c.{m}, {_r3(f'c.{m} - p.{m}')} AS delta_{m}" for m in _MEASURES)
        + ", CASE WHEN p.parser IS NULL THEN 'new' ELSE 'compared' END AS status FROM cur c LEFT JOIN prev p ON p.parser = c.parser",
}

ORACLE["augment_with_clips_all"] = ORACLE["augment_with_clips"].replace("FROM chunks_t WHERE heading_path <> ''),", "FROM chunks_t),")
