"""Speech event streams: JSON lines of type meta, segment, done and error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = ("type string, video_file string, duration double, message string, "
         "segment struct<start:double,end:double,text:string,confidence:double>")


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def asr_events(lines: DataFrame) -> DataFrame:
    """Parsed events of a (streaming or batch) text table; lines that are no JSON object are left out."""
    parsed = lines.filter(F.ltrim("value").startswith("{")).select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return parsed.filter(F.col("type").isNotNull())


def segments(events: DataFrame) -> DataFrame:
    return events.filter((F.col("type") == "segment") & F.col("segment").isNotNull()).select(
        "video_file", F.col("segment.start").alias("start_sec"), F.col("segment.end").alias("end_sec"),
        F.col("segment.text").alias("text"), F.col("segment.confidence").alias("confidence"))


def errors(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == "error").select("video_file", "message")


LIVE = "video_file string, step int, progress double, status string, message string"
LIVE_STATE = "last_end double, duration double, status string, step int"


def live_progress(events: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """A row per video and micro-batch that brought events of it: progress and status (running, done, error, expired).

    State is one row per video and ends: it goes ``keep_ms`` after the last event of a video arrived, finished or not; a video that
    had not finished is reported as expired.  Events of one batch are taken together, so their order inside it does not matter, and
    an event that comes after the end changes progress but not the status.
    """
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, whole, status, step = state.get if state.exists else (None, None, "running", 0)
        message = None
        if state.hasTimedOut:
            state.remove()
            if status != "running":
                return
            status = "expired"
        else:
            arrived = 0
            for rows in batches:
                arrived = max(arrived, int(rows["arrived"].max()))
                ends = [x for x in rows["end"] if x is not None and x == x]
                last = max([*ends, *([] if last is None else [last])], default=None)
                spans = [x for x in rows["duration"] if x is not None and x == x]
                whole = max([*spans, *([] if whole is None else [whole])], default=None)
                kinds = set(rows["type"])
                if status == "running" and kinds & {"done", "error"}:
                    status = "error" if "error" in kinds else "done"
                message = next((m for m, t in zip(rows["message"], rows["type"]) if t == "error"), message)
            state.update((last, whole, status, step + 1))
            state.setTimeoutTimestamp(arrived + keep_ms)
        share = 0.0 if last is None else min(last / (whole or 1.0), 1.0)
        done = 1.0 if status == "done" and last is None else share
        yield pd.DataFrame([(key[0], step + 1, done, status, message)], columns=["video_file", "step", "progress", "status", "message"])

    arrived = events.filter(F.col("video_file").isNotNull()).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    flat = arrived.select(
        F.unix_millis("_arrived").alias("arrived"), "_arrived", "video_file", "type", "message", F.col("segment.end").alias("end"), F.when(F.col("type") == "meta", F.col("duration")).alias("duration"))
    return flat.groupBy("video_file").applyInPandasWithState(fold, LIVE, LIVE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def asr_progress(events: DataFrame) -> DataFrame:
    """Largest share done per video; 1.0 when it ended without a segment.

    One streaming aggregate: largest end, duration (missing or zero counts as one second), end mark.
    """
    seen = events.groupBy("video_file").agg(
        F.max("segment.end").alias("last_end"),
        F.max(F.when(F.col("type") == "meta", F.col("duration"))).alias("duration"),
        F.max(F.when(F.col("type") == "done", F.lit(1)).otherwise(F.lit(0))).alias("done"))
    whole = F.when(F.coalesce("duration", F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(F.col("duration"))
    return seen.select("video_file", F.when(F.col("last_end").isNotNull(), F.least(F.col("last_end") / whole, F.lit(1.0)))
                       .when(F.col("done") == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("progress"))


def dedup_segments(rows: DataFrame, keep: str | None = None) -> DataFrame:
    """One row per (video, start, end, text).

    On a stream, ``keep`` bounds the state: a segment is remembered for that long after it arrived.  The bound is on arrival, not on
    times inside the video, so no row is too late to be taken; only a repetition that arrives after ``keep`` is taken again.
    """
    keys = ["video_file", "start_sec", "end_sec", "text"]
    if keep is None:
        return rows.dropDuplicates(keys)
    return rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(
        keys).drop("_arrived")


def write_stream(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True):
    """Append rows to parquet files; returns the running query."""
    writer = rows.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
