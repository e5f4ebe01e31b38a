"""Grouped summaries.  All of them combine on the map side before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions.text import py_round
from quillgraph.operators.ordering import position_in_group


def list_headings(chunks: DataFrame, category: str | None = None) -> DataFrame:
    rows = chunks.filter(F.coalesce("heading_path", F.lit("")) != "")
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("heading_path").agg(
        F.count("*").alias("chunk_count"), F.min("category").alias("category")).orderBy("heading_path")


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunk_count"))


def dominant_category(hits: DataFrame) -> DataFrame:
    """Most frequent category per query; ties go to the earliest ranked hit."""
    per = hits.groupBy("query_id", "category").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return per.groupBy("query_id").agg(
        F.max_by("category", F.struct(F.col("n"), -F.col("first"))).alias("category"))


def hit_heading_paths(hits: DataFrame) -> DataFrame:
    """Distinct non-empty heading paths of a query's hits, in rank order."""
    paths = hits.filter(F.coalesce("heading_path", F.lit("")) != "").groupBy("query_id", "heading_path").agg(
        F.min("rank").alias("rank"))
    return paths.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "heading_path"))), lambda s: s["heading_path"])
        .alias("heading_paths"))


def sync_counts(actions: DataFrame, keys: tuple[str, ...] = ("source_file",)) -> DataFrame:
    names = ["inserted", "updated", "deleted", "skipped", "errors"]
    return actions.groupBy(*keys).agg(*[
        F.count_if(F.col("action") == n).cast("bigint").alias(n) for n in names])


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count("*").alias("chunk_count"))


def transcript_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_file").agg(
        F.count("*").alias("segment_count"), F.min("start_sec").alias("first_start"),
        F.max("end_sec").alias("last_end"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, tie: str,
                      points: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact percentiles per group, without gathering a group.

    Rows get their position in value order (spread over range partitions); only the two
    rows next to each percentile are then aggregated.
    """
    ranked = position_in_group(df.select(*keys, value, tie), keys, [value, tie], "_pos")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = ranked.join(sizes, keys)
    out = []
    for name, p in points.items():
        exact = (F.col("_n") - 1) * F.lit(p)
        low = F.floor(exact)
        weight = exact - low
        high = F.least(low + 1, F.col("_n") - 1)
        at = lambda where: F.max(F.when(F.col("_pos") == where, F.col(value)))
        out.append((at(low) * (1 - F.max(weight)) + at(high) * F.max(weight)).alias(name))
    return joined.groupBy(*keys).agg(*out)


def summarize_runs(runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """Benchmark summary per parser without warm-up rows."""
    rows = runs.filter(~F.col("is_warmup"))
    basic = rows.groupBy("parser").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("ok_count"),
        py_round(F.count_if("ok") * 100.0 / F.count("*"), 3).alias("success_rate"),
        py_round(F.avg("seconds"), 3).alias("avg_time"),
        py_round(F.min("seconds"), 3).alias("min_time"), py_round(F.max("seconds"), 3).alias("max_time"),
        py_round(F.avg("block_count"), 3).alias("avg_blocks"))
    pct = exact_percentiles(rows, ["parser"], "seconds", tie, {"p50_time": 0.5, "p95_time": 0.95})
    return basic.join(pct, "parser").withColumn("p50_time", py_round("p50_time", 3)).withColumn(
        "p95_time", py_round("p95_time", 3))


def compare_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change of each measure against the previous summary; parsers without one are new."""
    measures = ["success_rate", "avg_time", "p95_time", "avg_blocks"]
    prev = previous.select("parser", *[F.col(m).alias(f"prev_{m}") for m in measures], F.lit(True).alias("_had"))
    joined = current.join(prev, "parser", "left")
    return joined.select(
        "parser", *measures,
        *[py_round(F.col(m) - F.col(f"prev_{m}"), 3).alias(f"delta_{m}") for m in measures],
        F.when(F.col("_had").isNull(), F.lit("new")).otherwise(F.lit("compared")).alias("status"))


def distinct_suggestions(suggestions: DataFrame, n: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """First ``n`` distinct texts in order of appearance."""
    first = suggestions.groupBy(*keys, "text").agg(F.min("pos").alias("pos"))
    if not keys:
        return first.orderBy("pos").limit(n)
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter(
        F.col("_rn") <= n).drop("_rn")
