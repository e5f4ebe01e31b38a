"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` places on a ring, and a key belongs to the shard of the next place clockwise.  A shard takes at
most (1 + slack) times the mean number of bytes: keys that find their shard full continue clockwise to the next shard that is not.

Which keys overflow must not depend on the order in which tasks see them.  So each key has a second hash, its turn, and a full shard
keeps the keys with the earliest turns, whichever shard they come from.  Turning a key away can only fill another shard, and a fuller
shard closes earlier, so the closing turns sink from round to round until none changes; they are then the same in every run and for every
partitioning.  The whole layout is these closing turns, one number per shard: where a row goes is
decided from its own hashes alone, and no row is moved to find it out.

Turns are counted in ``turns`` steps, and the step in which a shard becomes full is still taken whole.  So no shard exceeds its bound by
more than one such step, a thousandth of its keys (or one key, where it is larger), and every key finds a place, as
all shards together hold more than there is.  Rounds work on a table of at most (places x turns) sums, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm.common import drop_table, write_table
from quillgraph.operators.ordering import position_in_group

#: Places of a shard on the ring, steps of a turn, and how far a shard may exceed the mean.
POINTS, TURNS, SLACK = 64, 1024, 0.002
#: Hashes have 52 bits; the ring is looked up by the first 12 of them.
_BITS, _CELL_BITS = 52, 12


def _hash(text: Column, first: int) -> Column:
    """52 bits of the MD5 of a text, from hexadecimal digit ``first`` on."""
    return F.conv(F.substring(F.md5(text), first, 13), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, points: int = POINTS) -> DataFrame:
    """(place, point, walk): the places in clockwise order, each with the shards that follow it, nearest first, each once.

    The places of a shard depend on its number only, so one more shard leaves all others where they are.
    """
    places = spark.range(shards * points).select((F.col("id") / points).cast("int").alias("shard"), (F.col("id") % points).alias("v"))
    named = places.select("shard", _hash(F.concat_ws(":", F.lit("shard"), "shard", "v"), 1).alias("point"))
    whole = named.agg(F.sort_array(F.collect_list(F.struct("point", "shard"))).alias("all"))
    owner = F.col("all.shard")
    walk = F.array_distinct(F.concat(F.slice(owner, F.col("place") + 1, shards * points), F.slice(owner, F.lit(1), F.col("place"))))
    return whole.select("all", F.posexplode("all.point").alias("place", "point")).select("place", "point", walk.alias("walk"))


def _cells(ring_table: DataFrame, spark: SparkSession) -> DataFrame:
    """(cell, before, within): places before each cell of the ring, and the points inside it."""
    width = 1 << (_BITS - _CELL_BITS)
    inside = ring_table.groupBy(F.floor(F.col("point") / width).alias("cell")).agg(
        F.sort_array(F.collect_list("point")).alias("within"))
    points = ring_table.agg(F.sort_array(F.collect_list("point")).alias("points"))
    empty = spark.range(1 << _CELL_BITS).select(F.col("id").alias("cell"), F.lit(0).alias("one"))
    counted = empty.join(points.withColumn("one", F.lit(0)), "one").select("cell", F.size(F.filter(
        "points", lambda p: p < F.col("cell") * width)).alias("before"))
    return counted.join(inside, "cell", "left").withColumn("within", F.coalesce("within", F.array().cast("array<bigint>")))


def _accepting(walk: str, turn: str, closing: list[int]) -> Column:
    """The first shard of the walk that is still open at the key's turn."""
    open_until = F.array(*map(F.lit, closing))
    return F.filter(F.col(walk), lambda s: F.col(turn) < F.get(open_until, s))[0]


def closing_turns(sums: DataFrame, shards: int, turns: int, slack: float) -> list[int]:
    """Per shard the first turn that is not taken any more, from (walk, turn, mass): at most ``shards`` numbers come back a round."""
    total = sums.agg(F.sum("mass")).first()[0] or 0
    bound = (1 + slack) * total / shards
    closing = [turns] * shards
    while total:
        upto = sums.withColumn("shard", _accepting("walk", "turn", closing)).groupBy("shard", "turn").agg(F.sum("mass").alias("mass"))
        upto = upto.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("turn", "mass"))).alias("steps"))
        # running sum over at most ``turns`` steps; the step that reaches the bound is the last one
        last = F.aggregate("steps", F.struct(F.lit(0).cast("long").alias("mass"), F.lit(turns).alias("end")), lambda s, x: F.struct(
            (s["mass"] + x["mass"]).alias("mass"),
            F.when((s["end"] == turns) & (s["mass"] + x["mass"] >= bound), x["turn"] + 1).otherwise(s["end"]).alias("end")))
        found = {r["shard"]: r["end"] for r in upto.select("shard", last["end"].cast("int").alias("end")).collect()}
        lower = [min(t, found.get(s, turns)) for s, t in enumerate(closing)]
        if lower == closing:
            break
        closing = lower
    return closing


def place(docs: DataFrame, shards: int, points: int = POINTS, turns: int = TURNS, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, _point, shard, home) for every row of ``docs``; ``home`` is the shard before anything overflows."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    places, _ = write_table(ring(spark, shards, points), "ring")
    cells, cells_path = write_table(_cells(places, spark), "cells")
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        _hash(key, 1).alias("_point"),
                        F.floor(_hash(key, 14) / ((1 << _BITS) / turns)).cast("int").alias("_turn"))
    found = keyed.withColumn("cell", F.floor(F.col("_point") / (1 << (_BITS - _CELL_BITS)))).join(cells, "cell")
    at = (F.col("before") + F.size(F.filter("within", lambda p: p < F.col("_point")))) % (shards * points)
    rows, _ = write_table(found.select("doc_id", "size", "text_crc32", "_point", "_turn", at.cast("int").alias("place")), "placed")
    walks = places.select("place", "walk")
    sums, sums_path = write_table(rows.groupBy("place", F.col("_turn").alias("turn")).agg(F.sum("size").alias("mass")).join(
        walks, "place").select("walk", "turn", "mass"), "loads")
    closing = closing_turns(sums, shards, turns, slack)
    drop_table(spark, sums_path, cells_path)
    return rows.join(walks, "place").select("doc_id", "size", "text_crc32", "_point", _accepting("walk", "_turn", closing).alias("shard"),
                                            F.col("walk")[0].alias("home"))


def shard_documents(docs: DataFrame, shards: int = 8, points: int = POINTS, turns: int = TURNS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home for every row of ``docs`` (doc_id, text; others are ignored).

    The law is ``bytes``: no shard exceeds the mean size by more than ``slack`` and one step of turns.  ``slot`` numbers the rows of a shard
    from 0, along the ring.  ``grown_shard`` is null, as loads count too: one more shard takes about its share of rows, and a
    few more change shards because the bound sinks.

    The key is doc_id.  Rows with the same id are one key and stay together, whatever they weigh.  Rows without an id
    are dealt by their text.  Null text counts as empty, a row has one byte more than its text; an empty table gives an empty table.
    """
    placed = place(docs, shards, points, turns, slack)
    return position_in_group(placed, ["shard"], ["_point", "doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
