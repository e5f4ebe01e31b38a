"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

Two multinomials over ``BUCKETS`` hash buckets of word unigrams and bigrams are counted: one over every document (raw), one over
trusted documents, smoothed towards the raw one.  A document's score is the mean over its n-grams of
log(trusted / raw), so it doesn't depend on length.  Every document whose score is at least the threshold is kept; nothing is
drawn at random.  The threshold lies ``MARGIN`` below the score that all but ``TAIL`` of the trusted
documents reach when their own n-grams are left out of the target.

Counting and scoring each read the table once, without a shuffle of texts.  The texts of all trusted documents are written
once by a semi-join on their ids, for which Spark moves texts only when the ids are too many to be sent to every task.  A task
returns one row per bucket, and the model is an array of BUCKETS numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.bytewords import Piece, joined, pieces
from quillgraph.llm.common import STEP, WORD, drop_table, map_rows, write_table

BUCKETS = 10_000
#: Weight of the raw distribution in the trusted one, in n-grams.
PRIOR = 10_000.0
TAIL, MARGIN = 0.001, 0.03
#: Documents below this many words, or with more than this share of words in repeated windows, fail the plain rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"

_word = re.compile(WORD)
_symbol = np.zeros(256, np.int64)
_symbol[[ord(c) for c in SYMBOLS]] = 1


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first occurrence included."""
    seen: dict[tuple, int] = {}
    again = np.zeros(len(words) + 1, np.int64)
    for i in range(len(words) - window + 1):
        first = seen.setdefault(tuple(words[i:i + window]), i)
        if first != i:
            for at in (first, i):
                again[at] += 1
                again[min(at + window, len(words))] -= 1
    return int((np.cumsum(again)[:-1] > 0).sum()) if len(words) else 0


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _word.search(x)]
    return len(lines) - len(set(lines))


def _counts(p: Piece) -> dict[str, list]:
    n_words = np.diff(p.at)
    out = {"n_words": n_words.tolist(),
           "word_chars": p.per_text(p.in_word & ((p.bytes & 0xC0) != 0x80)).tolist(),
           "n_symbols": p.per_text(_symbol[p.bytes]).tolist(),
           "n_dup_lines": [repeated_lines(t) for t in p.texts]}
    # texts that repeat a window by hash are counted again by their words
    windows = joined(p.words, WINDOW)
    doc = p.doc_of_word()
    inside = doc[:len(windows)] == doc[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    keyed = (windows + doc[:len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[inside]
    order = np.argsort(keyed)
    twice = np.flatnonzero(keyed[order][1:] == keyed[order][:-1])
    hit = set(doc[:len(windows)][inside][order[twice]].tolist())
    out["n_repeat_words"] = [repeated_words(_word.findall(t)) if i in hit else 0 for i, t in enumerate(p.texts)]
    return out


def _grams(p: Piece, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, of every pair of neighbours, and which pairs lie inside one text."""
    doc = p.doc_of_word()
    one = (p.words % np.uint64(buckets)).astype(np.int64)
    two = (joined(p.words, 2) % np.uint64(buckets)).astype(np.int64)
    return one, two, doc[:-1] == doc[1:] if len(doc) > 1 else np.zeros(len(two), bool)


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all texts of ``docs``, a bounded table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                for p in pieces(batch.slice(start, STEP).column(0).to_pylist()):
                    one, two, inside = _grams(p, buckets)
                    found += np.bincount(one, minlength=buckets) + np.bincount(two[inside], minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts as an array, from at most ``buckets`` rows."""
    found = np.zeros(buckets)
    for row in counts.collect():
        found[row["bucket"]] = row["n"]
    return found


def bucket_weights(raw: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(trusted / raw) per bucket; zeros when no document is trusted."""
    if not good.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    return np.log((good + prior * p_raw) / (good.sum() + prior)) - np.log(p_raw)


def scores_of(p: Piece, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each text; 0 without words."""
    one, two, inside = _grams(p, len(weights))
    each = weights[one]
    each[:len(two)] += np.where(inside, weights[two], 0.0)
    sums = np.concatenate(([0.0], np.cumsum(each)))
    n = np.diff(p.at)
    return (sums[p.at[1:]] - sums[p.at[:-1]]) / np.maximum(2 * n - 1, 1)


def held_out_scores(p: Piece, raw: np.ndarray, good: np.ndarray, prior: float) -> list[float]:
    """Scores of trusted texts under a target from which each text's own n-grams are taken out."""
    one, two, inside = _grams(p, len(raw))
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    out = []
    for a, b in zip(p.at[:-1], p.at[1:]):
        grams = np.concatenate((one[a:b], two[a:max(a, b - 1)]))
        at, n = np.unique(grams, return_counts=True)
        rest = np.log((np.maximum(good[at] - n, 0) + prior * p_raw[at]) / (good.sum() - len(grams) + prior)) - np.log(p_raw[at])
        out.append(float((rest * n).sum() / max(len(grams), 1)))
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, tail: float = TAIL,
        margin: float = MARGIN) -> tuple[np.ndarray, float]:
    """Bucket weights and threshold.  Without trusted documents every score is 0 and the threshold below it."""
    trusted, ids_path = write_table(trusted_ids(labels), "trusted")
    mine, texts_path = write_table(docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi").select("text"), "trusted_texts")
    drop_table(docs.sparkSession, ids_path)
    good = collected(gram_counts(mine, buckets), buckets)
    if not good.sum():
        drop_table(docs.sparkSession, texts_path)
        return np.zeros(buckets), -margin
    raw = collected(gram_counts(docs, buckets), buckets)
    weights = bucket_weights(raw, good, prior)

    def scored(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "score": []}
        for p in pieces(batch["text"]):
            out["n_words"] += np.diff(p.at).tolist()
            out["score"] += held_out_scores(p, raw, good, prior)
        return out

    low = map_rows(mine, ["text"], "n_words long, score double", scored).filter(
        F.col("n_words") >= LEAST_WORDS).agg(F.percentile_approx("score", F.lit(tail), F.lit(10_000))).first()[0]
    drop_table(docs.sparkSession, texts_path)
    return weights, (low if low is not None else 0.0) - margin


_RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, weights: np.ndarray, threshold: float, carry: list[str]) -> DataFrame:
    """Counts, score, base_failed and kept for every row, next to the columns named in ``carry`` as _c0, _c1, ..."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    held = [f"_c{i}" for i in range(len(carry))]
    source = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held)], F.col("text").alias("_text"))
    schema = ", ".join([f"{h} {kinds[c]}" for c, h in zip(carry, held)] + [f"{r} long" for r in _RULES] + ["score double"])

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {r: [] for r in (*_RULES, "score")}
        for p in pieces(batch["_text"]):
            for k, v in _counts(p).items():
                out[k] += v
            out["score"] += scores_of(p, weights).tolist()
        return {**{h: batch[h] for h in held}, **out}

    got = map_rows(source, [*held, "_text"], schema, run)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept per row of ``docs``.

    ``labels`` (doc_id, quality) names trusted documents by quality 1.  Null text has no words and fails; a null id can't be
    trusted; a document with several labels is trusted when one of them is 1; repeated rows are judged alike, and all of
    them count in the raw distribution.  Empty tables: no rows, or no trusted documents, in which case only the plain
    rules decide.  Very long texts are laid out alone.  Other columns are ignored.
    """
    weights, threshold = fit(docs, labels, **options)
    return judge(docs, weights, threshold, ["doc_id"]).withColumnRenamed("_c0", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns."""
    weights, threshold = fit(docs, labels, **options)
    names = docs.columns
    got = judge(docs, weights, threshold, names).filter("kept")
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
