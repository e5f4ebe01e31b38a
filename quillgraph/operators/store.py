"""Chunk-table changes.  Each returns a new snapshot; nothing is edited in place.

Tables are keyed by chunk id, so joins and first-row choices shuffle on a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.functions.text import strip
from quillgraph.operators.aggregates import sync_counts
from quillgraph.operators.ordering import cut_lineage

#: Columns of an L2 row that reach the store or its actions.
SYNC_FIELDS = ["source_file", "source_type", "content", "heading_path", "is_manual", "seq"]


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def last_per_id(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rn", rn).filter("_rn <= 1").drop("_rn")


def chunk_changed(content, heading, user_edited, old_content, old_heading) -> Column:
    head = strip(F.coalesce(heading, F.lit("")))
    return ((strip(F.coalesce(content, F.lit(""))) != strip(F.coalesce(old_content, F.lit(""))))
            | ((head != "") & (head != strip(F.coalesce(old_heading, F.lit("")))))
            | F.coalesce(user_edited, F.lit(False)))


def diff_chunks(l2: DataFrame, store: DataFrame) -> DataFrame:
    """Status new / changed / unchanged per chunk row; rows without chunk_id are ignored."""
    old = store.select(F.col("id").alias("chunk_id"), F.col("content").alias("_oc"),
                       F.col("heading_path").alias("_oh"), F.lit(True).alias("_in"))
    edited = F.col("user_edited") if "user_edited" in l2.columns else F.lit(False)
    joined = l2.filter(_s("chunk_id") != "").join(old, "chunk_id", "left")
    status = (F.when(F.col("_in").isNull(), "new")
              .when(chunk_changed(F.col("content"), F.col("heading_path"), edited, F.col("_oc"), F.col("_oh")),
                    "changed").otherwise("unchanged"))
    return joined.withColumn("status", status).drop("_oc", "_oh", "_in")


def diff_counts(l2: DataFrame, store: DataFrame) -> DataFrame:
    per = diff_chunks(l2, store).groupBy("source_file").agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in ("new", "changed", "unchanged")])
    total = l2.groupBy("source_file").agg(F.count("*").alias("total"))
    return total.join(per, "source_file", "left").select(
        "source_file", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("new", "changed", "unchanged")], "total")


def sync_chunks(l2: DataFrame, store: DataFrame, delete_missing: bool = False, now: Column | None = None):
    """Bring the store in line with the L2 rows of the sources present in ``l2``.

    Returns (new_store, actions).  ``actions`` has one row per L2 row and per deleted id.
    """
    now = T.iso_now() if now is None else now
    rows = l2.withColumn("_id", F.when(_s("chunk_id") != "", F.col("chunk_id")).otherwise(_s("anchor_id")))
    rows = rows.withColumn("_ok", (strip(_s("content")) != "") & (F.col("_id") != ""))
    edited = F.col("user_edited") if "user_edited" in l2.columns else F.lit(False)
    old = store.select(*[F.col(c).alias(f"_o_{c}") for c in store.columns], F.lit(True).alias("_in"))
    # a chunk counts as present only in the store rows of its own source
    joined = rows.join(old, (F.col("_id") == F.col("_o_id")) & F.col("_ok")
                       & (F.col("_o_payload_file") == T.basename(F.col("source_file"))), "left")
    action = (F.when(~F.col("_ok"), "skipped").when(F.col("_in").isNull(), "inserted")
              .when(chunk_changed(F.col("content"), F.col("heading_path"), edited,
                                  F.col("_o_content"), F.col("_o_heading_path")), "updated")
              .otherwise("skipped"))
    # rows and store meet once: what follows reads the outcome, without the old wording
    acted = cut_lineage(joined.withColumn("action", action).select(
        *[c for c in SYNC_FIELDS if c in l2.columns], "_id", "_ok", "action",
        *[f"_o_{c}" for c in store.columns if c != "content"]))
    written = last_per_id(acted.filter(F.col("action").isin("inserted", "updated")), "_id")
    name, head = T.basename(F.col("source_file")), strip(_s("heading_path"))
    body = strip(_s("content"))
    keep = lambda new, col: F.when(new != "", new).otherwise(F.col(f"_o_{col}"))
    upd = F.col("action") == "updated"
    fresh = {
        "id": F.col("_id"), "content": body, "anchor_id": F.col("_id"),
        "source_type": F.when(upd, keep(_s("source_type"), "source_type")).otherwise(
            F.when(_s("source_type") != "", F.col("source_type")).otherwise(F.lit("markdown"))),
        "category": T.chunk_category(name, head, body),
        "heading_path": F.when(upd, keep(head, "heading_path")).otherwise(head),
        "payload_file": name, "is_manual": F.coalesce(F.col("is_manual"), F.lit(False)),
        "created_at": F.when(upd, F.col("_o_created_at")).otherwise(now),
        "version": F.when(upd, F.col("_o_version") + 1).otherwise(F.lit(1)).cast("int"),
        "seq": F.when(upd, F.col("_o_seq")).otherwise(F.col("seq")),
    }
    changed = written.select(*[fresh[c].cast(store.schema[c].dataType).alias(c) if c in fresh else F.col(f"_o_{c}").alias(c)
                               for c in store.columns])
    kept = store.join(acted.filter(F.col("action").isin("inserted", "updated")).select(F.col("_id").alias("id")), "id", "left_anti")
    actions = acted.select("source_file", F.col("_id").alias("id"), "action")
    if delete_missing:
        sources = acted.select(T.basename(F.col("source_file")).alias("payload_file"), "source_file").distinct()
        accepted = acted.filter("_ok").select(F.col("_id").alias("id"),
                                              T.basename(F.col("source_file")).alias("payload_file")).distinct()
        gone = store.join(sources, "payload_file").join(
            accepted, ["id", "payload_file"], "left_anti")
        kept = kept.join(gone.select("id"), "id", "left_anti")
        actions = actions.unionByName(gone.select("source_file", "id", F.lit("deleted").alias("action")))
    return kept.unionByName(changed), actions


def sync_summary(l2: DataFrame, store: DataFrame, delete_missing: bool = False) -> DataFrame:
    return sync_counts(sync_chunks(l2, store, delete_missing)[1])


def upsert_chunks(store: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert or replace: the last new row per id wins and starts at version 1."""
    stamp = T.iso_now() if now is None else now
    fresh = last_per_id(rows).withColumn("version", F.lit(1)).withColumn("created_at", stamp)
    return store.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*store.columns))


def update_chunks(store: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits by id: content always, other fields only when given.

    An edit without any other field is a manual content edit.  Unknown ids change nothing.
    """
    optional = ["source_type", "anchor_id", "category", "heading_path", "payload_file"]
    given = [c for c in optional if c in edits.columns]
    e = last_per_id(edits).select(
        "id", F.col("content").alias("_n_content"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_n_{c}") for c in given],
        (F.col("is_manual") if "is_manual" in edits.columns else F.lit(None).cast("boolean")).alias("_n_manual"))
    joined = store.join(e, "id", "left")
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c == "content":
            return F.when(hit, F.col("_n_content")).otherwise(F.col(c))
        if c == "version":
            return F.when(hit, F.col(c) + 1).otherwise(F.col(c))
        if c == "is_manual":
            return F.when(hit, F.coalesce("_n_manual", F.lit(True))).otherwise(F.col(c))
        if c in given:
            return F.when(hit & (_s(f"_n_{c}") != ""), F.col(f"_n_{c}")).otherwise(F.col(c))
        return F.col(c)

    return joined.select(*[value(c).alias(c) for c in store.columns])


def delete_chunks(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def edit_chunks_l2(l2: DataFrame, edits: DataFrame) -> DataFrame:
    """A hand edit sets content, display and embedding text and marks the row manual."""
    e = edits.select("chunk_id", F.col("content").alias("_new"))
    joined = l2.join(e, "chunk_id", "left")
    hit = F.col("_new").isNotNull()
    text = [c for c in ("content", "display_content", "embedding_text") if c in l2.columns]
    for c in text:
        joined = joined.withColumn(c, F.when(hit, F.col("_new")).otherwise(F.col(c)))
    return joined.withColumn("is_manual", hit | F.coalesce("is_manual", F.lit(False))).select(*l2.columns)
