"""Fields of a search hit.  A hit is a chunk row with optional payload columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions import text as T, vocab as V
from quillgraph.functions.text import strip

OPTIONAL = {
    "display_content": "string", "document": "string", "content": "string", "block_type": "string",
    "heading_path": "string", "payload_heading_path": "string", "description": "string", "payload_file": "string",
    "source_file": "string", "anchor_id": "string", "id": "string", "source_type": "string", "video_file": "string",
    "page": "string", "route_category": "string",
}


def with_hit_fields(hits: DataFrame) -> DataFrame:
    """Add the fallback columns a hit may lack, as nulls."""
    for name, kind in OPTIONAL.items():
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    return hits


def _first(*names: str) -> Column:
    return F.coalesce(*[F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)) for n in names], F.lit(""))


def hit_content() -> Column:
    return strip(_first("display_content", "document", "content"))


def hit_type() -> Column:
    t = strip(_first("block_type"))
    return F.when(t == "", F.lit("text")).otherwise(t)


def hit_path() -> Column:
    own = strip(F.coalesce("heading_path", F.lit("")))
    return F.when(own != "", own).otherwise(strip(F.coalesce("payload_heading_path", F.lit(""))))


def hit_description() -> Column:
    return strip(_first("description"))


def hit_source() -> Column:
    return F.lower(strip(_first("payload_file", "source_file")))


def hit_anchor() -> Column:
    return _first("anchor_id", "id")


def result_title() -> Column:
    """Last heading, else the first text line, else the video or file name."""
    path = strip(_first("payload_heading_path", "heading_path"))
    lines = F.transform(T.split_lines(hit_content()), lambda l: strip(F.ltrim(strip(l), F.lit("#"))))
    line = F.get(F.filter(lines, lambda l: l != ""), F.lit(0))
    is_video = F.lower(_first("source_type")) == "video"
    video = strip(_first("video_file"))
    name = strip(_first("payload_file"))
    return (F.when(path != "", F.substring(F.element_at(F.split(path, " > "), -1), 1, 80))
            .when(line.isNotNull(), F.substring(line, 1, 80))
            .when(is_video, F.when(video != "", video).otherwise(F.lit("视频片段")))
            .when(name != "", T.stem(name)).otherwise(F.lit("知识卡")))


def result_meta() -> Column:
    kind = F.lower(_first("source_type"))
    name = strip(_first("payload_file"))
    page = F.col("page").cast("string")
    block = strip(_first("block_type"))
    none = F.lit(None).cast("string")
    return F.concat_ws(
        "  ·  ", F.upper(F.when(kind == "", F.lit("doc")).otherwise(kind)),
        F.when(name != "", T.basename(name)).otherwise(none),
        F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit("第 "), page, F.lit(" 页"))).otherwise(none),
        F.when(block != "", block).otherwise(none))


def preview_rows(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Title, meta line and highlighted body per hit; hits without content are left out."""
    h = with_hit_fields(hits).join(queries.select("query_id", "query"), "query_id")
    return h.filter(hit_content() != "").select(
        "query_id", "rank", "id", result_title().alias("title"), result_meta().alias("meta"),
        T.highlight(hit_content(), F.col("query")).alias("body"))
