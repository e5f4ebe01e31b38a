"""Queries run over all documents, not over a subset of them."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from quillgraph.catalog import adapters as X
from quillgraph.operators import graph as G

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def matches(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    rows = [tuple(r) for r in df.collect()]
    assert check.rows_of(df.columns, rows) == check.rows_of(cols, cur.fetchall())
    return len(rows)


@pytest.mark.parametrize("name", ["upsert_chunks_all", "update_chunks_all", "edit_chunks_l2_all"])
def test_every_line_of_every_document(spark, db, name):
    assert matches(spark, db, name) == X.chunks_t(spark, SF).count()


@pytest.mark.parametrize("name", ["delete_chunks_all", "export_store_rows_all", "levenshtein_turns"])
def test_other_whole_queries(spark, db, name):
    assert matches(spark, db, name) > 25


def test_rebuild_has_edges_of_all_documents(spark):
    # the store ends as the chunks of all documents, so its graph is the graph of those
    edges = G.build_graph(X.chunks_t(spark, SF), X.bindings_t(spark, SF))[1]
    want = {r["relation"]: r["count"] for r in edges.groupBy("relation").count().collect()}
    assert {r["relation"]: r["n"] for r in entry.queries()["rebuild_edges"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["stream_qa_log_all", "qa_review_text_all", "qa_samples_all", "filter_reviewed_all", "augment_with_clips_all"])
def test_every_line_is_a_hit(spark, db, name):
    assert matches(spark, db, name) > 0
    sql = entry.oracle_sql()[name]
    assert "WHERE heading_path <> ''" not in sql and "160)" not in sql and "> 160" not in sql
