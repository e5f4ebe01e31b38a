"""Prompt, answer, trace and log tables built from hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions import hits as H, text as T
from quillgraph.functions.text import strip

# --- fixed values: prompt and answer texts ---
PROMPT_HEAD = "以下是从知识库中检索到的相关内容（共 %d 条，编号 [1]-[%d]）：\n\n"
PROMPT_RULES = (
    "\n\n---\n请严格遵守以下规则回答问题：\n"
    "1. 只能使用上方检索内容作答，不得引入检索内容之外的知识补充关键事实。\n"
    "2. 回答时用 [序号] 标注来源，例如\"根据 [1] ...\"。\n"
    "3. 如果上方内容不足以回答，请直接说\"当前知识库中没有找到足够的相关信息\"，不要猜测。\n"
    "4. 对操作步骤类问题，请输出编号分步答案（第1步、第2步...）。\n"
    "5. 对参数类问题，请优先结合参数表、术语定义和图片上下文来解释。\n"
    "6. 如果检索内容中包含图片引用（如 ![](_page_X_Picture_Y.jpeg)），请在回答中原样保留该图片引用，不要省略。\n"
    "7. 回答文案必须忠实于检索内容原文，不得随意改写或概括原始文案的具体数值、路径、参数名称。\n"
    "8. 用中文回答。\n"
    "9. 如果问题包含代词（它、这个、那个等），请结合对话历史理解指代。\n\n问题：")
PROMPT_TAIL = "\n\n回答："
SYSTEM_MESSAGE = (
    "你是一个知识库问答助手。用户会提供检索到的文档片段和问题，"
    "请严格依据文档内容用中文作答，不要重复问题本身，直接输出答案。")
ANSWER_INTRO = "以下是当前检索到的相关内容："
HISTORY_HEAD = "以下是最近 %d 轮对话历史：\n"

HIT_LIST_LIMIT = 900
HISTORY_ANSWER = 200


def history_section(history: Column) -> Column:
    """Numbered last turns, or an empty text.  ``history`` is an array of (query, answer, …)."""
    recent = F.slice(history, F.greatest(F.size(history) - 4, F.lit(1)), 5)
    lines = F.transform(recent, lambda t, i: F.concat(
        (i + 1).cast("string"), F.lit(". Q: "), F.coalesce(t["query"], F.lit("")), F.lit("\n   A: "),
        F.substring(F.coalesce(t["answer"], F.lit("")), 1, HISTORY_ANSWER)))
    return F.when(F.size(recent) > 0, F.concat(
        F.format_string(HISTORY_HEAD, F.size(recent)), F.array_join(lines, "\n"), F.lit("\n\n---\n\n"))).otherwise(F.lit(""))


def _ordered(hits: DataFrame, text: Column, name: str) -> DataFrame:
    """Per-question list of hit texts in rank order.  A question has at most top-k hits and clips."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("_n"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]).alias(name))


def context_entry() -> Column:
    none = F.lit(None).cast("string")
    tag = lambda name, value: F.when(value != "", F.concat(F.lit(f"[{name}: "), value, F.lit("]"))).otherwise(none)
    tags = F.concat_ws(" ", F.concat(F.lit("[Category: "), F.coalesce("route_category", F.lit("general")), F.lit("]")),
                       tag("File", H.hit_source()), tag("Path", H.hit_path()), tag("Type", H.hit_type()))
    keep = lambda x: F.when(x != "", x).otherwise(none)
    return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "),
                    F.concat_ws("\n", tags, keep(H.hit_description()), keep(H.hit_content())),
                    F.lit("\n    （来源 chunk: "), H.hit_anchor(), F.lit("）"))


def build_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One prompt per question that has hits; ``queries`` may carry a ``history`` array."""
    ctx = _ordered(H.with_hit_fields(hits), context_entry(), "_ctx")
    joined = queries.join(ctx, "query_id")
    past = history_section(F.col("history")) if "history" in queries.columns else F.lit("")
    prompt = F.concat(past, F.format_string(PROMPT_HEAD, F.col("_n"), F.col("_n")), F.array_join("_ctx", "\n\n"),
                      F.lit(PROMPT_RULES), F.col("query"), F.lit(PROMPT_TAIL))
    return joined.select("query_id", F.col("_n").alias("n_hits"), prompt.alias("prompt"))


def prompt_messages(prompts: DataFrame) -> DataFrame:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return prompts.withColumn("messages", F.array(
        message("system", F.lit(SYSTEM_MESSAGE)), message("user", F.col("prompt"))))


def chat_messages(queries: DataFrame, n_turns: int) -> DataFrame:
    """Last ``2n`` history messages followed by the prompt as a user message."""
    pair = lambda t: F.array(
        F.struct(F.lit("user").alias("role"), t["query"].alias("content")),
        F.struct(F.lit("assistant").alias("role"), t["answer"].alias("content")))
    past = F.flatten(F.transform("history", pair))
    kept = F.slice(past, F.greatest(F.size(past) - 2 * n_turns + 1, F.lit(1)), 2 * n_turns)
    return queries.withColumn("messages", F.concat(kept, F.array(
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))))


def retrieval_answers(queries: DataFrame, hits: DataFrame, reason: str = "",
                      empty_text: str = "当前知识库中没有找到相关内容") -> DataFrame:
    """Answer texts without a model: numbered hits; questions without hits get a fixed text."""
    none = F.lit(None).cast("string")
    body = H.hit_content()
    cut = F.when(F.length(body) > HIT_LIST_LIMIT, F.concat(
        T.rstrip(F.substring(body, 1, HIT_LIST_LIMIT)), F.lit("..."))).otherwise(body)
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"- {name}: "), value)).otherwise(none)
    entry = F.concat_ws(
        "\n", F.concat(F.lit("## 结果 "), F.col("rank").cast("string")), F.concat(F.lit("- 来源: "), H.hit_anchor()),
        F.concat(F.lit("- 路由分类: "), F.coalesce("route_category", F.lit("general"))), line("Path", H.hit_path()),
        line("Type", H.hit_type()), line("描述", H.hit_description()), F.lit(""), cut, F.lit(""))
    listed = _ordered(H.with_hit_fields(hits), entry, "_list")
    head = (f"{reason}\n\n" if reason else "") + ANSWER_INTRO + "\n\n"
    return queries.join(listed, "query_id", "left").select("query_id", F.when(
        F.col("_n").isNull(), F.lit(empty_text)).otherwise(
        strip(F.concat(F.lit(head), F.array_join("_list", "\n")))).alias("answer"))


def trace_rows(summary: DataFrame, hits: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """One structured trace per question: route, hits (first 240 characters), prompt size, answer."""
    h = H.with_hit_fields(hits)
    entry = F.struct("rank", H.hit_type().alias("type"), F.coalesce("route_category", F.lit("general")).alias("category"),
                     H.hit_path().alias("path"), F.substring(H.hit_content(), 1, 240).alias("content"))
    per = h.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    answer = strip(F.coalesce("answer", F.lit("")))
    return (summary.join(per, "query_id", "left")
            .join(prompts.select("query_id", F.length("prompt").alias("prompt_chars")), "query_id", "left")
            .join(answers, "query_id", "left")
            .withColumn("answer", F.when(answer != "", answer).otherwise(F.lit("(空回答)"))))


def qa_log_rows(answers: DataFrame, hits: DataFrame, created_at: Column | None = None,
                max_context_chars: int = 1200, enabled: bool = True) -> DataFrame:
    """Log rows for ``answers`` (query_id, query, answer, mode) with ranked, shortened hits."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if created_at is None else created_at
    h = H.with_hit_fields(hits)
    document = T.truncate(H._first("document", "content"), max_context_chars)
    distance = F.col("distance").cast("double") if "distance" in hits.columns else F.lit(None).cast("double")
    entry = F.struct(
        F.col("rank").cast("int").alias("rank"), F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("anchor_id", F.lit("")).alias("anchor_id"), F.coalesce("source_type", F.lit("")).alias("source_type"),
        distance.alias("distance"), document.alias("document"))
    per = h.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("retrieved_context"))
    rows = answers.join(per, "query_id", "left")
    if not enabled:
        rows = rows.filter(F.lit(False))
    empty = F.array().cast("array<struct<rank:int,id:string,anchor_id:string,source_type:string,distance:double,document:string>>")
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), stamp), 256).alias("id"), stamp.alias("created_at"),
        "mode", "query", "answer", F.coalesce("retrieved_context", empty).alias("retrieved_context"),
        F.struct(F.lit("").alias("expected_answer"), F.lit("unreviewed").alias("verdict"),
                 F.lit(None).cast("double").alias("accuracy_score"), F.lit(None).cast("double").alias("retrieval_score"),
                 F.lit("").alias("notes"), F.lit("").alias("chunking_action")).alias("human_review"))


def render_qa_review(qa_log: DataFrame) -> DataFrame:
    """Review text per log row, hits in rank order."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    hit = lambda h: F.concat(
        F.lit("#### Hit "), h["rank"].cast("string"), F.lit("\n\n- id: "), h["id"], F.lit("\n- anchor_id: "), h["anchor_id"],
        F.lit("\n- source_type: "), h["source_type"], F.lit("\n- distance: "), text(h["distance"]),
        F.lit("\n\n```text\n"), h["document"], F.lit("\n```\n\n"))
    return qa_log.select("id", F.concat(
        F.lit("\n## QA "), F.col("created_at").cast("string"), F.lit("  `"), F.col("id"), F.lit("`\n\n- Mode: "), F.col("mode"),
        F.lit("\n- Verdict: "), F.col("human_review.verdict"),
        F.lit("\n- Accuracy score: \n- Retrieval score: \n- Chunking action: \n\n### Question\n\n"), F.col("query"),
        F.lit("\n\n### Answer\n\n"), F.col("answer"), F.lit("\n\n### Retrieved Chunks\n\n"),
        F.array_join(F.transform(F.array_sort("retrieved_context"), hit), ""),
        F.lit("### Human Review\n\n- Expected answer: \n- Notes: \n")).alias("markdown"))
