"""Ranked lexical search for many queries at once, sharing what the queries have in common.

A query's score of a document is a sum over its terms, so terms that several queries hold together need to be summed only once:

1. *Mine.*  Queries are sets of terms (per multiplicity).  The pair of terms that most queries hold together becomes a node, which
   takes its place in these queries; then the next pair, pairs of nodes too, until no pair is shared by two queries.
   The nodes form a directed acyclic graph: leaves are terms, an inner node is the sum of two others.
2. *Materialise.*  For a block of documents every leaf's contribution and then, level by level, every node's partial sum is computed
   once, as one row of accumulators over the documents of the block.
3. *Combine.*  A query adds up its nodes, times their multiplicity, and keeps the ``k`` best documents of the task.

The corpus is read twice, once for its counts (documents, length, documents per query term) and once for the scores; only the ``k``
best per query leave a task, and a window of at most (tasks x k) rows per query ranks them.

Scores are 64-bit integers.  With N documents that have a term, L terms in all, n terms in the document and df documents with a term:
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 75 + (25 n N) div L``, and a term found tf times adds
``w * ((10^9 tf) div (1000 tf + 12 m))``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.llm.common import STEP, to_arrow

#: Queries whose graph and accumulators are held at the same time.  More queries take one more pass over the corpus each.
QUERIES_PER_PASS = 4096
#: Bytes of a text that are Python words at the same time.
PIECE = 1 << 20

#: Bytes of a term are digits, letters (A-Z lower-cased) and everything beyond ASCII; all others become a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """Term (UTF-8 bytes) -> occurrences in the whole text, which is cut into words a piece at a time; null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        # split() also cuts at tabs and line ends, none of which is left
        counts.update(raw[at:end].split())
        at = end
    return counts


@dataclass
class SharedPlan:
    """The queries of a pass.  Node i < len(terms) is a term, node len(terms) + j the sum of the two nodes ``pairs[j]``."""

    keys: list
    terms: list[bytes]
    pairs: list[tuple[int, int]]
    #: per query: (node, times) to be added up
    sums: list[list[tuple[int, int]]]

    def levels(self) -> list[np.ndarray]:
        """Inner nodes as (node, a, b) arrays, each level needing earlier ones only."""
        depth = [0] * len(self.terms)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for j, (a, b) in enumerate(self.pairs):
            depth.append(1 + max(depth[a], depth[b]))
            found.setdefault(depth[-1], []).append((len(self.terms) + j, a, b))
        return [np.array(found[d], np.int64).T for d in sorted(found)]


def share(queries: list[tuple[object, Counter]]) -> SharedPlan:
    """Mine pairs of nodes that at least two queries hold with the same multiplicity, the most shared ones first."""
    terms = sorted({t for _, counts in queries for t in counts})
    number = {t: i for i, t in enumerate(terms)}
    # one bag of nodes for each multiplicity of a query
    bags: list[tuple[int, int, set[int]]] = []
    for q, (_, counts) in enumerate(queries):
        for times in sorted(set(counts.values())):
            bags.append((q, times, {number[t] for t, c in counts.items() if c == times}))
    where: list[set[int]] = [set() for _ in terms]
    for b, (_, _, nodes) in enumerate(bags):
        for node in nodes:
            where[node].add(b)
    pairs: list[tuple[int, int]] = []
    while True:
        # a node in one bag only shares nothing
        shared = Counter(p for _, _, nodes in bags for p in combinations(sorted(n for n in nodes if len(where[n]) > 1), 2))
        made = 0
        for (a, b), held in sorted(shared.items(), key=lambda kv: (-kv[1], kv[0])):
            if held < 2:
                break
            holders = where[a] & where[b]
            if len(holders) < 2:
                continue
            node = len(terms) + len(pairs)
            pairs.append((a, b))
            where.append(set(holders))
            where[a] -= holders
            where[b] -= holders
            for bag in holders:
                bags[bag][2].difference_update((a, b))
                bags[bag][2].add(node)
            made += 1
        if not made:
            break
    sums: list[list[tuple[int, int]]] = [[] for _ in queries]
    for q, times, nodes in bags:
        sums[q].extend((node, times) for node in sorted(nodes))
    return SharedPlan([k for k, _ in queries], terms, pairs, sums)


def corpus_counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents per term of ``terms``) over the whole corpus; one number per term leaves a task."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, length, df = 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                for text in batch.slice(start, STEP).column(0).to_pylist():
                    counts = term_counts(text)
                    n_docs += bool(counts)
                    length += counts.total()
                    for t in counts.keys() & number.keys():
                        df[number[t]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], at)), pa.int64()),
                                          pa.array(np.concatenate(([n_docs, length], df[at])), pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r["term"]: r["n"] for r in rows}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(terms))], np.int64)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` rows of each item by score (highest first), then id, null ids last; sorted by item."""
    order = np.lexsort((doc, no_id, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    place = np.arange(len(item)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(item)]))))
    return order[place < k]


def _scores(docs: DataFrame, plan: SharedPlan, n_docs: int, length: int, df: np.ndarray, k: int) -> DataFrame:
    """(query, score, doc_id): the ``k`` best documents of each task for each query."""
    number = {t: i for i, t in enumerate(plan.terms)}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    levels, n_nodes = plan.levels(), len(plan.terms) + len(plan.pairs)
    queries = np.array([q for q, nodes in enumerate(plan.sums) if nodes], np.int64)
    parts = np.array([node for nodes in plan.sums for node, _ in nodes], np.int64)
    times = np.array([t for nodes in plan.sums for _, t in nodes], np.int64)[:, None]
    begins = np.cumsum([0] + [len(plan.sums[q]) for q in queries])[:-1].astype(np.int64)
    out = docs.sparkSession.createDataFrame([], "query int, score long, doc_id long").schema
    arrow = to_arrow(out)

    def block(texts: list[str | None]) -> np.ndarray:
        """Scores, queries x documents."""
        at_term, at_doc, tf, n = [], [], [], np.zeros(len(texts), np.int64)
        for d, text in enumerate(texts):
            counts = term_counts(text)
            n[d] = counts.total()
            for t in counts.keys() & number.keys():
                at_term.append(number[t])
                at_doc.append(d)
                tf.append(counts[t])
        values = np.zeros((n_nodes, len(texts)), np.int64)
        if tf:
            m = 75 + (25 * n * n_docs) // length
            term, doc, times_found = np.array(at_term), np.array(at_doc), np.array(tf, np.int64)
            values[term, doc] = weight[term] * ((1_000_000_000 * times_found) // (1000 * times_found + 12 * m[doc]))
        for node, a, b in levels:
            values[node] = values[a] + values[b]
        return np.add.reduceat(values[parts] * times, begins, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        item, score, doc, no_id = empty, empty, empty, np.zeros(0, bool)
        least = np.ones(len(queries), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                got = block(part.column(1).to_pylist())
                null = np.array(part.column(0).is_null())
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                q, d = np.nonzero(got >= least[:, None])
                item, score = np.concatenate((item, q)), np.concatenate((score, got[q, d]))
                doc, no_id = np.concatenate((doc, ids[d])), np.concatenate((no_id, null[d]))
                keep = _best(item, score, doc, no_id, k)
                item, score, doc, no_id = item[keep], score[keep], doc[keep], no_id[keep]
                # a query that has k documents takes no lower score any more
                ends = np.flatnonzero(np.concatenate((item[1:] != item[:-1], [True]))) if len(item) else empty
                full = np.bincount(item, minlength=len(queries))[item[ends]] == k
                least[item[ends[full]]] = score[ends[full]]
        yield pa.RecordBatch.from_arrays([pa.array(queries[item], pa.int32()), pa.array(score, pa.int64()),
                                          pa.array(doc, pa.int64(), mask=no_id)], schema=arrow)

    if not len(queries) or not n_docs:
        return docs.sparkSession.createDataFrame([], out)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    All documents are ranked; those with score 0 are left out, equal scores go by ascending doc_id (null last), rows that repeat an id
    each take a rank.  A null or empty text has no terms: as a document it is never found, as an item it finds nothing.  Rows of
    ``items`` with the same or no id are queries of their own.  An empty table gives an empty table; other columns are ignored.

    ``items`` is the set of queries: its terms, at most ``queries_per_pass`` items of them at a time, are mined on the driver and
    sent to the tasks.
    """
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    rows = iter(items.select("item_id", "text").toLocalIterator())
    found = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    while held := list(islice(rows, queries_per_pass)):
        plan = share([(r["item_id"], term_counts(r["text"])) for r in held])
        best = _scores(docs, plan, *corpus_counts(docs, plan.terms), k)
        names = spark.createDataFrame(list(enumerate(plan.keys)), f"query int, item_id {id_type}")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.unionByName(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(
            names, "query").select("item_id", "rank", "doc_id", "score"))
    return found
