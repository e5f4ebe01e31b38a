"""Live conversations: last turns and standalone query per conversation, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions import vocab as V

OUTPUT = ("conv_id bigint, turn bigint, query string, standalone_query string, "
          "history array<struct<turn:bigint,query:string,answer:string>>")
STATE = "standalone string, last_query string, turns array<bigint>, queries array<string>, answers array<string>"


def _turn_fold(window: int, quotes: tuple[str, str], keep_ms: int):
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        alone, last, *held = state.get if state.exists else (None, None, [], [], [])
        recent = list(zip(*map(list, held)))
        turns = sorted((row for rows in batches for row in zip(rows["turn"], rows["query"], rows["answer"], rows["arrived"])), key=lambda row: row[0])
        out = []
        for turn, raw, answer, _ in turns:
            query = (raw or "").strip()
            anchor = alone or last or ""
            follows = any(m in query for m in V.FOLLOWUP_MARKERS)
            text = f"基于{quotes[0]}{anchor}{quotes[1]}：{query}" if query and follows and anchor.strip() else query
            out.append((key[0], turn, query, text, [{"turn": t, "query": q, "answer": a} for t, q, a in recent]))
            alone, last, recent = text, query, (recent + [(int(turn), query, answer or "")])[-window:]
        state.update((alone, last, *([list(c) for c in zip(*recent)] or [[], [], []])))
        state.setTimeoutTimestamp(max(int(row[3]) for row in turns) + keep_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "query", "standalone_query", "history"])

    return fold


def conversation_state(turns: DataFrame, window: int = 5, quotes: tuple[str, str] = ('"', '"'), keep_ms: int = 86_400_000) -> DataFrame:
    """Stream of turns (conv_id, turn, query, answer) with their standalone query and the last ``window`` turns before them.

    State per conversation is one standalone query and ``window`` turns with their answers; it goes ``keep_ms`` after the conversation's
    last turn, and a conversation that goes on later starts anew.  Turns of a batch are taken in turn order.
    """
    arrived = turns.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    return arrived.select("conv_id", "turn", "query", "answer", "_arrived", F.unix_millis("_arrived").alias("arrived")).groupBy("conv_id").applyInPandasWithState(
        _turn_fold(window, quotes, keep_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
