"""Streams over three micro-batches, with late rows, ends and expired state."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.ordering import scratch_path
from quillgraph.streaming import asr, conversation as SC


def seg(video, start, end, text="t"):
    return json.dumps({"type": "segment", "video_file": video, "segment": {"start": start, "end": end, "text": text, "confidence": 0.5}})


def event(kind, video, **more):
    return json.dumps({"type": kind, "video_file": video, **more})


BATCHES = [
    [event("meta", "a", duration=10.0), seg("a", 0, 4), seg("b", 0, 0.5), event("meta", "c", duration=8.0), "loading model", event("meta", "e"),
     event("meta", "d", duration=5.0)],
    [event("done", "a"), seg("a", 4, 8), event("error", "b", message="boom"), seg("a", 0, 4), event("done", "e")],
    [seg("a", 2, 9, "late"), seg("c", 0, 2), seg("a", 4, 8), seg("b", 0, 0.5)],
]


@pytest.fixture(scope="module")
def lines(spark):
    path = scratch_path(spark, "lines")
    for batch in BATCHES:
        spark.createDataFrame([(x,) for x in batch], "value string").coalesce(1).write.mode("append").text(path)
    return path


def run(spark, rows):
    out = scratch_path(spark, "out")
    asr.write_stream(rows, out, scratch_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


def last(df):
    best = df.groupBy("video_file").agg(F.max_by(F.struct("progress", "status"), "step").alias("s"), F.max("message").alias("m"))
    return {r["video_file"]: (round(r["s"]["progress"], 6), r["s"]["status"], r["m"]) for r in best.collect()}


def test_progress_of_videos_that_end(spark, lines):
    got = run(spark, asr.live_progress(asr.asr_events(asr.read_lines(spark, lines, 1))))
    assert last(got) == {"a": (0.9, "done", None), "b": (0.5, "error", "boom"), "c": (0.25, "running", None), "e": (1.0, "done", None),
                         "d": (0.0, "running", None)}
    assert got.groupBy("video_file").count().filter("count > 3").isEmpty()


def test_progress_state_expires(spark, lines):
    """With a bound that the third batch exceeds, a video without an end is reported once, and one with an end goes silently."""
    got = run(spark, asr.live_progress(asr.asr_events(asr.read_lines(spark, lines, 1)), keep_ms=1))
    rows = sorted((r["video_file"], r["status"]) for r in got.collect() if r["video_file"] in "de")
    assert rows == [("d", "expired"), ("d", "running"), ("e", "done"), ("e", "running")]


def test_segments_repeat_over_batches(spark, lines):
    got = run(spark, asr.dedup_segments(asr.segments(asr.asr_events(asr.read_lines(spark, lines, 1))), "1 hour"))
    assert sorted((r["video_file"], r["start_sec"], r["text"]) for r in got.collect()) == [
        ("a", 0.0, "t"), ("a", 2.0, "late"), ("a", 4.0, "t"), ("b", 0.0, "t"), ("c", 0.0, "t")]


def test_conversations_keep_answers(spark):
    path = scratch_path(spark, "turns")
    schema = "conv_id bigint, turn bigint, query string, answer string"
    for batch in ([(1, 2, "那 second", None), (1, 1, "first", "one")], [(2, 1, "", "x")], [(1, 3, "third", "three"), (2, 2, "那", "y")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["conv_id"], r["turn"]): (r["standalone_query"], [tuple(h) for h in r["history"]]) for r in run(
        spark, SC.conversation_state(stream, window=2)).collect()}
    assert got == {(1, 1): ("first", []), (1, 2): ('基于"first"：那 second', [(1, "first", "one")]),
                   (1, 3): ("third", [(1, "first", "one"), (2, "那 second", "")]), (2, 1): ("", []), (2, 2): ("那", [(1, "", "x")])}
