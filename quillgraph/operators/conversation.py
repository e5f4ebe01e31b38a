"""Conversation history as ordered steps over turns (conv_id, turn, query, answer, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.functions.text import strip
from quillgraph.operators.ordering import last_marked_position, position_in_group, with_previous


def number_turns(turns: DataFrame) -> DataFrame:
    """Dense 0-based ``pos`` inside each conversation, by ``turn``."""
    return turns if "pos" in turns.columns else position_in_group(turns, ["conv_id"], ["turn"], "pos")


def recent_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """Add ``history``: the last ``n`` turns before this one, oldest first."""
    fields = [c for c in ("turn", "query", "answer", "category", "standalone_query") if c in turns.columns]
    return with_previous(number_turns(turns), ["conv_id"], "pos", n, fields, "history").drop("pos")


def condense_queries(turns: DataFrame, quotes: tuple[str, str] = ('"', '"')) -> DataFrame:
    """Add ``standalone_query``: follow-ups are anchored to the previous standalone query.

    The recursion has a closed form: inside a run of follow-ups the k-th one is k opening
    phrases, the query the run started from, and the k follow-ups one after the other.
    """
    opening = F.lit(f"基于{quotes[0]}")
    rows = number_turns(turns).withColumn("_q", strip(F.coalesce("query", F.lit(""))))
    rows = with_previous(rows, ["conv_id"], "pos", 1, ["_q"], "_prev")
    chained = T.is_followup(F.col("_q")) & (F.size("_prev") > 0) & (F.col("_prev")[0]["_q"] != "")
    rows = rows.withColumn("_chained", F.coalesce(chained, F.lit(False))).drop("_prev")
    rows = last_marked_position(rows, ["conv_id"], "pos", ~F.col("_chained"), "_base")
    # a run is as long as its follow-ups; the text of each one holds all before it
    run = Window.partitionBy("conv_id", "_base").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.collect_list("_q").over(run)
    depth = (F.col("pos") - F.col("_base")).cast("int")
    text = F.concat(F.repeat(opening, depth), F.array_join("_parts", f"{quotes[1]}："))
    return rows.withColumn("_parts", parts).withColumn("standalone_query", text).drop(
        "_q", "_chained", "_base", "_parts", "pos")


def number_batches(chunks: DataFrame, size: int = 10, keys: tuple[str, ...] = ("source_file",),
                   order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Add consecutive batch numbers (from 0) of ``size`` rows in order."""
    numbered = position_in_group(chunks, list(keys), list(order), "_pos")
    return numbered.withColumn("batch_no", F.floor(F.col("_pos") / size)).withColumn(
        "pos_in_batch", F.col("_pos") % size).drop("_pos")
