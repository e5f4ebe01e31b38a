"""Time the headline queries.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from quillgraph.catalog import registry
from quillgraph.session import build_session

HEADLINE = [
    "chunk_documents_md", "chunk_documents_flat", "split_long_blocks", "heuristic_category", "highlight",
    "list_headings", "sync_store", "sync_counts", "diff_status", "apply_suggestions", "review_markdown", "merge_review",
    "heading_edges", "category_edges", "sequence_edges", "graph_edges_last", "graph_edges_first", "connected_components",
    "search_text_topk", "find_nodes", "graph_search", "search_with_clips", "condense_queries", "recent_turns",
    "prompts", "augment_with_clips", "transcript_at", "run_summary", "opt_requests", "stream_asr",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").count()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
