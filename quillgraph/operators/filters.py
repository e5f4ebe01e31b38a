"""Projections, filters and predicates over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as T, vocab as V


def filter_category(chunks: DataFrame, category: str) -> DataFrame:
    return chunks.filter(F.col("category") == category)


def filter_heading_prefix(chunks: DataFrame, prefix: str, category: str | None = None) -> DataFrame:
    """String prefix of the heading path, ASCII case ignored, ordered by path."""
    hit = T.ascii_lower("heading_path").startswith(T.ascii_lower(F.lit(prefix)))
    if category:
        hit = hit & (F.col("category") == category)
    return chunks.filter(hit).orderBy("heading_path", "seq")


def filter_by_source(chunks: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    """Rows of one source: exact file name (base or full), or a substring anywhere."""
    if mode == "exact":
        base = name.rsplit("/", 1)[-1]
        return chunks.filter(F.col("payload_file").isin(base, name))
    anywhere = [F.col(c) for c in ("payload_file", "video_file", "content") if c in chunks.columns]
    hit = F.lit(False)
    needle = T.ascii_lower(F.lit(name))
    for c in anywhere:
        hit = hit | F.coalesce(T.ascii_lower(c).contains(needle), F.lit(False))
    return chunks.filter(hit)


def filter_any_column(df: DataFrame, needle: str) -> DataFrame:
    """Needle inside the blank-joined lower-case text of all columns; empty keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns])
    return df.filter(F.lower(joined).contains(wanted))


def exclude_ids(hits: DataFrame, invalid_ids: DataFrame) -> DataFrame:
    return hits.join(invalid_ids.select("id").distinct(), "id", "left_anti")


def filter_reviewed(qa_log: DataFrame) -> DataFrame:
    return qa_log.filter(F.coalesce("human_review.verdict", F.lit("unreviewed")) != "unreviewed")


def category_rank() -> F.Column:
    return F.array_position(F.array(*[F.lit(c) for c in V.CATEGORIES]), F.col("category"))


def known_category_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks that may become graph nodes: known category, first row per id.

    ``node_seq`` is the insertion order of the graph: category by category.
    """
    ranked = chunks.filter(F.col("category").isin(V.CATEGORIES) & (F.col("id") != "")).withColumn(
        "_cat", category_rank().cast("bigint"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("_cat", "seq"))
    return ranked.withColumn("_rn", first).filter("_rn <= 1").drop("_rn").withColumnRenamed("_cat", "cat_rank")
