import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
QUICK = ["chunk_sections", "segment_blocks", "chunk_documents_md", "chunk_documents_flat", "list_headings", "sync_actions", "diff_counts",
         "augment_with_clips", "transcript_at", "run_summary", "heading_edges", "category_edges", "sequence_edges", "search_text_topk",
         "find_nodes", "graph_search", "recent_turns", "condense_queries", "prompts", "review_parsed", "apply_suggestions",
         "opt_requests", "qa_samples", "stream_asr", "stream_condense", "markdown_files_chunks", "review_files_roundtrip",
         "chunk_json_roundtrip", "connected_components", "update_graph_edges"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
