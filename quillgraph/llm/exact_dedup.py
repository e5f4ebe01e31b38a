"""Exact dedup that no group of copies can slow down: local, salted and global combining.

Texts are equal when identical after lower-casing A-Z.  A SHA-256 digest deals rows out, and every stage groups by the
digest *and* the whole text, so equality never rests on the digest.

1. A task combines its own copies of a text before anything is shuffled (Spark's partial aggregation).
2. What is left meets in salted groups: (digest, text, salt), with the salt drawn from the row's id, so the copies of a
   hot text are spread over ``salts`` tasks.
3. The winners of the salts, at most ``salts`` rows per text, are combined into one row per text.

Documents then look up the row of their digest, so texts are shuffled for the two merges only.  Should a digest ever have two
different texts, which the merges show, its documents look up digest and text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.common import ascii_lower, write_table

#: Salted groups per text.  A text that makes up a third of n rows puts at most (tasks of the scan) / SALTS rows in a group.
SALTS = 32


def equal_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per different text: _digest, _norm, _keep (largest doc_id), _size (rows)."""
    keyed = _keyed(docs).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    salted = keyed.groupBy("_digest", "_norm", "_salt").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size"))
    return salted.groupBy("_digest", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def _keyed(docs: DataFrame) -> DataFrame:
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", norm.alias("_norm")).withColumn("_digest", F.sha2("_norm", 256))


def mark_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; others are ignored).

    Null text counts as empty.  The row with the largest doc_id of a group stays.  A null doc_id never wins against a
    number; in a group of null ids only, keep_id is null and the rows are kept.  Repeated rows of
    the winning id are the same document and are all marked as kept.  An empty table gives an empty table.
    """
    rows = _keyed(docs)
    per_digest, _ = write_table(equal_groups(docs, salts).groupBy("_digest").agg(
        F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.max("_size").alias("_size")), "digests")
    clashes = per_digest.filter("_texts > 1").select("_digest")
    found = rows.select("doc_id", "_digest").join(per_digest.filter("_texts = 1"), "_digest")
    if not clashes.isEmpty():
        both = rows.join(clashes, "_digest", "left_semi").join(equal_groups(docs, salts), ["_digest", "_norm"])
        found = found.select("doc_id", "_digest", "_keep", "_size").unionByName(both.select("doc_id", "_digest", "_keep", "_size"))
    return found.select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256"))
