"""Review-driven correction of chunks: request batches out, suggestions in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import text as T
from quillgraph.operators import aggregates as A, conversation as CV, review as R

RESPONSE = ("struct<optimized_chunks:array<struct<chunk_id:string,action:string,optimized_content:string,"
            "merge_target_id:string,reason:string>>,global_suggestions:array<string>>")


def recent_reviewed(qa_log: DataFrame, n: int = 20, order: str = "created_at") -> DataFrame:
    """Newest reviewed rows among the last ``2n`` log rows, at most ``n``; texts shortened."""
    tail = qa_log.orderBy(F.desc(order), F.desc("id")).limit(2 * n)
    reviewed = tail.filter(F.coalesce("human_review.verdict", F.lit("unreviewed")) != "unreviewed")
    return reviewed.orderBy(F.desc(order), F.desc("id")).limit(n).select(
        "id", order, F.coalesce("query", F.lit("")).alias("question"),
        F.transform(F.slice("retrieved_context", 1, 3), lambda h: F.substring(
            F.coalesce(h["document"], F.lit("")), 1, 300)).alias("retrieved_chunks"),
        F.substring(F.coalesce("answer", F.lit("")), 1, 400).alias("answer"), F.col("human_review.verdict").alias("verdict"),
        F.coalesce("human_review.notes", F.lit("")).alias("notes"))


def optimization_requests(chunks: DataFrame, samples: DataFrame, batch_size: int = 10) -> DataFrame:
    """One JSON request per source and batch of ``batch_size`` chunks; samples ride along (at most 20)."""
    batched = CV.number_batches(chunks, batch_size)
    block = F.coalesce("block_type", F.lit("text")) if "block_type" in chunks.columns else F.lit("text")
    entry = F.struct(
        "pos_in_batch", F.struct(
            F.col("chunk_id"), F.coalesce("heading_path", F.lit("")).alias("heading_path"), block.alias("block_type"),
            F.substring(F.coalesce("content", F.lit("")), 1, 1500).alias("content"),
            F.coalesce("is_manual", F.lit(False)).alias("is_manual")).alias("c"))
    grouped = batched.groupBy("source_file", "batch_no").agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    # at most 20 samples, the same for every request
    rows = F.collect_list(F.struct("created_at", F.struct(
        "question", "retrieved_chunks", "answer", "verdict", "notes").alias("s")))
    qa = samples.agg(F.to_json(F.transform(F.sort_array(rows, asc=False), lambda x: x["s"])).alias("j")).first()["j"]
    shape = "array<struct<question:string,retrieved_chunks:array<string>,answer:string,verdict:string,notes:string>>"
    return grouped.select("source_file", "batch_no", F.size("_c").alias("n_chunks"), F.to_json(F.struct(
        F.lit("1.0").alias("task_version"), "source_file", F.from_json(F.lit(qa or "[]"), shape).alias("qa_samples"),
        F.transform("_c", lambda x: x["c"]).alias("chunks"))).alias("request"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses (source_file, batch_no, raw) with the parsed object; unparsable batches are dropped."""
    body = T.unfenced("raw")
    return responses.withColumn("r", F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, RESPONSE))).filter(
        F.col("r").isNotNull())


def optimization_apply(chunks: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated chunks, first ten distinct general suggestions per source)."""
    ok = parse_responses(responses)
    each = ok.select("source_file", "batch_no", F.posexplode("r.optimized_chunks").alias("k", "s"))
    suggestions = each.select(F.struct("batch_no", "k").alias("pos"), "s.*")
    general = ok.select("source_file", "batch_no", F.posexplode("r.global_suggestions").alias("k", "text")).withColumn(
        "pos", F.struct("batch_no", "k"))
    return R.apply_suggestions(chunks, suggestions), A.distinct_suggestions(general, 10, ("source_file",))
