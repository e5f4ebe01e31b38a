"""Transcripts, clips and document-to-clip bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as T, vocab as V
from quillgraph.functions.text import strip


def list_bindings(bindings: DataFrame, clips: DataFrame) -> DataFrame:
    """Bindings with their clip, newest first; missing clips leave nulls."""
    c = clips.select(F.col("id").alias("video_clip_id"), "video_file", "start_sec", "end_sec", "semantic_summary")
    return bindings.join(c, "video_clip_id", "left").orderBy(F.desc("created_at"), "id")


def binding_status(bindings: DataFrame, clips: DataFrame, anchors: DataFrame) -> DataFrame:
    c = clips.select(F.col("id").alias("video_clip_id"), "video_file", "start_sec", "end_sec", "semantic_summary")
    a = anchors.select(
        F.col("anchor_id").alias("pdf_anchor_id"), F.col("source_file").alias("anchor_source"),
        F.coalesce(F.when(F.coalesce("display_content", F.lit("")) != "", F.col("display_content")),
                   F.col("content")).alias("anchor_preview"), F.lit(True).alias("_anchor"))
    joined = bindings.join(c, "video_clip_id", "left").join(a, "pdf_anchor_id", "left")
    no_anchor = F.col("_anchor").isNull()
    no_clip = (F.coalesce("video_clip_id", F.lit("")) == "") | (F.coalesce("video_file", F.lit("")) == "")
    status = (F.when(no_anchor & no_clip, "Anchor缺失 / Clip缺失").when(no_anchor, "Anchor缺失")
              .when(no_clip, "Clip缺失").otherwise("OK"))
    return joined.withColumn("status", status).withColumn(
        "anchor_source", F.coalesce("anchor_source", F.lit(""))).withColumn(
        "anchor_preview", F.coalesce("anchor_preview", F.lit(""))).drop("_anchor")


def clip_hits(hits: DataFrame, bindings: DataFrame, clips: DataFrame) -> DataFrame:
    """Bound clips of each query's hits: one row per query and clip, newest binding first."""
    anchors = hits.select("query_id", strip(F.coalesce(
        F.when(F.coalesce("anchor_id", F.lit("")) != "", F.col("anchor_id")), F.col("id"))).alias("anchor_id")
    ).filter(F.col("anchor_id") != "").distinct()
    c = clips.select(F.col("id").alias("clip_id"), "video_file", "start_sec", "end_sec", "semantic_summary")
    bound = bindings.select(
        F.col("id").alias("map_id"), strip("video_clip_id").alias("clip_id"),
        strip("pdf_anchor_id").alias("anchor_id"), "note", "created_at").filter(F.col("clip_id") != "")
    joined = anchors.join(bound, "anchor_id").join(c, "clip_id", "left")
    newest = Window.partitionBy("query_id", "clip_id").orderBy(F.desc("created_at"), "map_id")
    first = joined.withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 1").drop("_rn")
    summary = strip(F.coalesce("semantic_summary", F.lit("")))
    note = strip(F.coalesce("note", F.lit("")))
    body = F.when(summary != "", summary).otherwise(F.lit(V.NO_SUMMARY))
    body = F.when(note != "", F.concat(body, F.lit("\n" + V.NOTE_PREFIX), note)).otherwise(body)
    return first.select(
        "query_id", F.col("clip_id").alias("id"), "anchor_id", F.lit("video").alias("source_type"),
        body.alias("content"), strip(F.coalesce("video_file", F.lit(""))).alias("video_file"),
        F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", F.lit(0.0)).alias("end_sec"),
        "created_at", "map_id")


def augment_with_clips(hits: DataFrame, bindings: DataFrame, clips: DataFrame) -> DataFrame:
    """Hits followed by their bound clips; clip ranks continue after the hits."""
    extra = clip_hits(hits, bindings, clips)
    sizes = hits.groupBy("query_id").agg(F.max("rank").alias("_last"))
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "map_id")
    ranked = extra.withColumn("_k", F.row_number().over(order)).join(sizes, "query_id").withColumn(
        "rank", (F.col("_last") + F.col("_k")).cast("bigint")).drop("_k", "_last", "created_at", "map_id")
    return hits.withColumn("rank", F.col("rank").cast("bigint")).unionByName(ranked, allowMissingColumns=True)


def transcript_at(points: DataFrame, segments: DataFrame, unit_sec: float = 60.0) -> DataFrame:
    """First segment (by ``seq``) that covers each point in time; clip marks do not count.

    An interval join on buckets whose size follows the segment: ``unit_sec`` doubled until it is no shorter than the segment.
    So a segment, however long, lies in at most two buckets of its own level, and a point is looked up once
    for every level that its video has.  A long video still spreads over many tasks by its short segments.
    """
    real = segments.filter(~F.coalesce("is_clip", F.lit(False))) if "is_clip" in segments.columns else segments
    units = F.greatest((F.col("end_sec") - F.col("start_sec")) / F.lit(float(unit_sec)), F.lit(1.0))
    width = F.lit(float(unit_sec)) * F.pow(F.lit(2.0), F.col("_level"))
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = real.filter(F.col("start_sec") <= F.col("end_sec")).withColumn("_level", F.ceil(F.log2(units)).cast("int")).select(
        "video_file", "start_sec", "end_sec", "text", F.col("seq").alias("segment_seq"), "_level",
        F.explode(F.sequence(bucket("start_sec"), bucket("end_sec"))).alias("_b"))
    levels = spread.groupBy("video_file").agg(F.collect_set("_level").alias("_levels"))
    pts = points.join(levels, "video_file").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_b", bucket("t"))
    hit = pts.join(spread, ["video_file", "_level", "_b"]).filter(F.col("t").between(F.col("start_sec"), F.col("end_sec")))
    first = hit.groupBy("point_id").agg(F.min_by(
        F.struct("start_sec", "end_sec", F.col("text")), "segment_seq").alias("_s"))
    return points.join(first, "point_id", "left").select(
        *points.columns, F.col("_s.start_sec").alias("start_sec"), F.col("_s.end_sec").alias("end_sec"),
        strip("_s.text").alias("text"))


def bind(bindings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add (clip, anchor) pairs that are not bound yet; the first of equal new pairs wins."""
    pair = ["video_clip_id", "pdf_anchor_id"]
    rn = F.row_number().over(Window.partitionBy(*pair).orderBy("id"))
    new = pairs.withColumn("_rn", rn).filter("_rn <= 1").drop("_rn").join(
        bindings.select(*pair).distinct(), pair, "left_anti")
    return bindings.unionByName(new.select(*bindings.columns))


def rebind(bindings: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, pdf_anchor_id) move bindings to another anchor."""
    c = changes.select("id", F.col("pdf_anchor_id").alias("_new"))
    return bindings.join(c, "id", "left").withColumn(
        "pdf_anchor_id", F.coalesce("_new", "pdf_anchor_id")).select(*bindings.columns)


def unbind(bindings: DataFrame, ids: DataFrame) -> DataFrame:
    return bindings.join(ids.select("id").distinct(), "id", "left_anti")


def valid_clips(clips: DataFrame) -> DataFrame:
    return clips.filter((F.col("start_sec") < F.col("end_sec"))
                        & (strip(F.coalesce("semantic_summary", F.lit(""))) != ""))


def clip_chunk_text(video_file, start, end, summary) -> Column:
    return F.concat(F.lit("[视频切片] 文件: "), video_file, F.lit("\n时间: "), T.fixed(start, 2), F.lit("s - "),
                    T.fixed(end, 2), F.lit("s\n摘要: "), summary)


def register_clips(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with chroma_id set, chunk rows of the valid clips)."""
    ok = valid_clips(clips).withColumn("semantic_summary", strip("semantic_summary"))
    rows = ok.select(
        "id", clip_chunk_text(F.col("video_file"), F.col("start_sec"), F.col("end_sec"),
                              F.col("semantic_summary")).alias("content"),
        F.lit("video").alias("source_type"), F.col("id").alias("anchor_id"), F.lit("general").alias("category"),
        F.lit("").alias("heading_path"), F.lit("").alias("payload_file"), "video_file", "start_sec", "end_sec",
        F.lit(True).alias("is_manual"), F.lit(1).alias("version"))
    return ok.withColumn("chroma_id", F.col("id")), rows


def list_clips(clips: DataFrame, video_file: str | None = None) -> DataFrame:
    rows = clips if video_file is None else clips.filter(F.col("video_file") == video_file)
    return rows.orderBy("video_file", "start_sec", "created_at")


def transcript(segments: DataFrame, video_file: str) -> DataFrame:
    return segments.filter(F.col("video_file") == video_file).orderBy("start_sec")


def segment_progress(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Share of the video done when each segment arrives; unknown durations count as 1 second."""
    d = durations.select("video_file", F.when(F.coalesce("duration", F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(
        F.col("duration")).alias("_d"))
    joined = segments.join(d, "video_file", "left")
    return joined.withColumn("progress", F.least(F.col("end_sec") / F.coalesce("_d", F.lit(1.0)), F.lit(1.0))).drop(
        "_d")
