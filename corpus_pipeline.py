"""From raw documents to a tokenised training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  Stages are written and reread as Parquet
between each other, so each reads its input from a table however often it scans it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import table, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and resemble trusted ones; the others go."""
    from quillgraph.llm.quality import keep_good
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier line at a similarity of 0.8 or more."""
    from quillgraph.llm.line_dedup import drop_repeated_lines
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    from quillgraph.llm.near_dedup import keep_first
    return keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes."""
    from quillgraph.llm.mixing import mix_documents
    return mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes and digests of ids and decoded bytes."""
    import public_tokenizers
    from quillgraph.llm.byte_bpe import VOCABULARY, encode_digests
    return encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("mix sources", mix_sources), ("byte bpe", byte_bpe)]

#: SQL can express neither the hashed n-gram scores nor the BPE merges; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
