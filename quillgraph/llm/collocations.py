"""Phrases of up to four words that stand together more often than their parts suggest, per language.

*Counting.*  Every word opens one window: itself and the following words of its piece (the lead columns w2 to w4), padded with nulls at
the end of the piece.  Only these longest windows are counted, and Spark's ``ROLLUP(w1, w2, w3, w4)`` sums them over successively
shorter prefixes: each occurrence of a phrase is the prefix of exactly one window.  There is no explosion per phrase length.

*Padding early.*  All parts of a phrase with at least ``least`` occurrences have as many.  A first reading counts words and pairs in
hashed buckets, a second one the triples and quadruples whose pairs may be frequent.  A bucket below ``least`` holds rare ones only,
so a window is padded from there on.  That changes no count that is asked for, since a bucket's sum is never below one of its own counts,
and leaves few different windows.  A filter is a bitmap of fixed size (``2 ** bits`` bits); the fuller it is, the less it saves.

*Scoring.*  A phrase counted ``a`` times is cut after each of its words into parts counted ``l`` and ``r`` times; its
score is the least ``floor(2000000 a / (l + r))`` of its cuts.  Phrases that mostly occur inside a longer one are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph.llm.bytewords import _power_tables
from quillgraph.llm.common import STEP, mix64, to_arrow, write_table
from quillgraph.operators.ordering import join_hot

#: log2 of the bits of a filter: 8 MiB each.
FILTER_BITS = 26
#: Bytes of text that are words at the same time, and different windows and numbers of buckets that a task holds before it hands them on.
PIECE, WINDOWS_HELD, BUCKETS_HELD = 1 << 20, 1 << 17, 1 << 21
#: Words and pairs of the corpus per part in which windows are summed.
PART_RUNS = 1_000_000

#: A-Z lower-cased, ends of pieces as a line feed, tabs as a space, all else as it is.
_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_AHEAD = re.compile(rb" *(?:[^ \n]+ *){0,3}")


def _blocks(texts: list[str | None]) -> Iterator[tuple[bytes, int]]:
    """The texts end to end in blocks: (bytes, n), of which only windows that open before byte n are the block's own.

    A block ends at a space or an end of a piece and carries the next three words along.
    """
    raw = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(_PIECES)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            ends = [e for e in (raw.find(b"\n", end), raw.find(b" ", end)) if e >= 0]
            end = min(ends, default=len(raw))
        else:
            end = len(raw)
        yield raw[at:_AHEAD.match(raw, end).end()], end - at
        at = end


def _shifted(flags: np.ndarray, n: int) -> np.ndarray:
    """The flags of the n-th word from each one on, false beyond the end."""
    return np.concatenate((flags[n:], np.zeros(min(n, len(flags)), bool)))


class _Words:
    """Words of a block: byte ranges, whether a run of k words from each one on is in one piece, and the bucket of that run."""

    def __init__(self, raw: bytes, own: int, lang: str, bits: int):
        data = np.frombuffer(raw, np.uint8)
        inside = (data != 32) & (data != 10)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.own, self.bits = int(np.searchsorted(self.starts, own)), bits
        piece = np.cumsum(data == 10)[self.starts]
        self.followed = np.concatenate((piece[1:] == piece[:-1], [False]))[:len(self.starts)]
        power, unpower = _power_tables(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        self.word = mix64((sums[self.ends] - sums[self.starts]) * unpower[self.starts] + (self.ends - self.starts).astype(np.uint64))
        seed = np.frombuffer(lang.encode()[:8].ljust(8, b"\0"), np.uint64)
        self.run = mix64(self.word + mix64(seed))

    def buckets(self, most: int) -> Iterator[np.ndarray]:
        """Buckets of the runs of 1, 2, .. ``most`` words; those over the end of a piece mean nothing."""
        run = self.run
        for k in range(1, most + 1):
            if k > 1:
                run = mix64(run * np.uint64(0xC2B2AE3D27D4EB4F) + np.concatenate((self.word[k - 1:], self.word[:k - 1]))[:len(run)])
            yield (run >> np.uint64(64 - self.bits)).astype(np.int64)


def _bit(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return ((bitmap[bucket >> 3] >> (bucket & 7)) & 1).astype(bool)


def _short_runs(words: _Words) -> np.ndarray:
    """Buckets of the words and pairs of a block."""
    one, two = words.buckets(2)
    return np.concatenate((one[:words.own], two[:words.own][words.followed[:words.own]]))


def _frequent(words: _Words, first: np.ndarray, second: np.ndarray | None = None) -> list[np.ndarray]:
    """Per run length 1 to 4: whether the run may be frequent; triples and quadruples by their pairs only, if there is no second filter."""
    one, two, three, four = words.buckets(4)
    pair = words.followed & _bit(first, two)
    triple = pair & _shifted(pair, 1)
    if second is not None:
        triple &= _bit(second, three)
    quadruple = triple & _shifted(triple, 1)
    if second is not None:
        quadruple &= _bit(second, four)
    return [_bit(first, one), pair, triple, quadruple]


def _long_runs(words: _Words, first: np.ndarray) -> np.ndarray:
    """Buckets of the triples and quadruples of a block whose pairs may all be frequent."""
    _, _, triple, quadruple = _frequent(words, first)
    _, _, three, four = words.buckets(4)
    return np.concatenate((three[:words.own][triple[:words.own]], four[:words.own][quadruple[:words.own]]))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    """The texts of each language of a batch (lang, text), a few rows at a time."""
    for start in range(0, batch.num_rows, STEP):
        part = batch.slice(start, STEP)
        groups: dict[str, list[str | None]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            groups.setdefault(lang, []).append(text)
        yield from groups.items()


def _bucket_filter(rows: DataFrame, least: int, bits: int, buckets_of: Callable[[_Words], np.ndarray]) -> tuple[bytes, int]:
    """A bitmap of the buckets with at least ``least`` runs (bit b is bit b % 8 of byte b // 8), and the number of runs.

    Buckets travel as ranges of 65536: two bytes of place and two of count each, the count cut at ``least``.
    """
    width = min(bits, 16)
    count_type = np.uint16 if least < 1 << 16 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def hand_on():
            bucket, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.flatnonzero(np.diff(bucket >> width)) + 1
            split = list(zip(np.split(bucket, cuts), np.split(n, cuts)))
            return pa.RecordBatch.from_arrays([
                pa.array([int(b[0]) >> width for b, _ in split], pa.int64()), pa.array([int(c.sum()) for _, c in split], pa.int64()),
                pa.array([(b & ((1 << width) - 1)).astype(np.uint16).tobytes() for b, _ in split], pa.binary()),
                pa.array([np.minimum(c, least).astype(count_type).tobytes() for _, c in split], pa.binary())],
                ["part", "runs", "places", "counts"])

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for raw, own in _blocks(texts):
                    held.append(buckets_of(_Words(raw, own, lang, bits)))
                    size += len(held[-1])
                    if size >= BUCKETS_HELD:
                        yield hand_on()
                        size = 0
        if size:
            yield hand_on()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, np.int64)
        for places, counts in zip(table["places"], table["counts"]):
            total[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), count_type)
        full = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([full], pa.binary()),
                         "runs": pa.array([sum(table["runs"].to_pylist())], pa.int64())})

    maps = rows.mapInArrow(run, "part long, runs long, places binary, counts binary").groupBy("part").applyInArrow(
        merge, "part long, bits binary, runs long").collect()
    whole = bytearray((1 << bits) // 8)
    for r in maps:
        at = (r["part"] << width) // 8
        whole[at:at + (1 << width) // 8] = bytes(r["bits"])
    return bytes(whole), sum(r["runs"] for r in maps)


def _packed(lang: str, counts: Counter, parts: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """(part, lang, windows, counts): the windows of a part end to end and their counts, so that few rows travel."""
    # several spaces between words say nothing
    names = [b" ".join(w.split()) if b"  " in w else w for w in counts]
    n = np.fromiter(counts.values(), np.int64, len(counts))
    part = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % parts
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        yield int(part[at[0]]), lang, b"\n".join([names[i] for i in at]), n[at].tobytes()


def windows(rows: DataFrame, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): the different windows of ``rows`` (lang, text) with their counts, padded with nulls.

    Tasks hand on packed windows by the hash of the window, and the windows of a part are summed in one place; parts hold a
    bounded share of all words, so their number grows with the corpus.
    """
    spark = rows.sparkSession
    first_filter, n_runs = _bucket_filter(rows, least, bits, _short_runs)
    short = spark.sparkContext.broadcast(first_filter)
    long = spark.sparkContext.broadcast(_bucket_filter(
        rows, least, bits, lambda words: _long_runs(words, np.frombuffer(short.value, np.uint8)))[0])
    parts = n_runs // PART_RUNS + 64
    packed = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("windows", pa.binary()), ("counts", pa.binary())])
    out = spark.createDataFrame([], "lang string, w1 string, w2 string, w3 string, w4 string, n long").schema
    arrow = to_arrow(out)

    def batch_of(held: dict[str, Counter]) -> pa.RecordBatch:
        columns = zip(*[row for lang, counts in held.items() for row in _packed(lang, counts, parts)])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, packed)], schema=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.frombuffer(short.value, np.uint8), np.frombuffer(long.value, np.uint8)
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                counts = held.setdefault(lang, Counter())
                for raw, own in _blocks(texts):
                    words = _Words(raw, own, lang, bits)
                    often = _frequent(words, first, second)
                    # words of each window: 0 for a rare word, which only counts as one of the language's
                    length = np.zeros(len(words.starts), np.int64)
                    for flags in reversed(often):
                        length = np.where(flags, length + 1, 0)
                    length = length[:words.own]
                    at = np.flatnonzero(length)
                    counts[b""] += words.own - len(at)
                    last = words.ends[at + length[at] - 1]
                    counts.update([raw[s:e] for s, e in zip(words.starts[at].tolist(), last.tolist())])
                if sum(map(len, held.values())) >= WINDOWS_HELD:
                    yield batch_of(held)
                    held = {}
        if any(held.values()):
            yield batch_of({lang: counts for lang, counts in held.items() if counts})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for names, counts in zip(table["windows"], table["counts"]):
            for window, n in zip(names.as_py().split(b"\n"), np.frombuffer(counts.as_py(), np.int64).tolist()):
                total[window] = total.get(window, 0) + n
        split = [w.split(b" ") if w else [] for w in total]
        words = [pa.array([w[i] if i < len(w) else None for w in split], pa.binary()).cast(pa.string()) for i in range(4)]
        lang = pa.array([key[1].as_py()] * len(total), pa.string())
        return pa.Table.from_arrays([lang, *words, pa.array(list(total.values()), pa.int64())], schema=arrow)

    return rows.mapInArrow(run, "part long, lang string, windows binary, counts binary").groupBy("part", "lang").applyInArrow(merge, out)


def phrase_counts(docs: DataFrame, least: int = 30, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to 4 words with f >= least; words = 0 has the number of words of the language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return docs.sparkSession.sql("""
        SELECT lang, words, concat_ws(' ', w1, w2, w3, w4) AS phrase, f FROM (
          SELECT lang, w1, w2, w3, w4, 4 - bit_count(grouping_id()) AS words, sum(n) AS f
          FROM {windows} GROUP BY lang, ROLLUP (w1, w2, w3, w4))
        WHERE words = 0 OR f >= {least} AND element_at(array(w1, w2, w3, w4), words) IS NOT NULL""",
                                 windows=windows(rows, least, bits), least=least)


def _scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates, by their lowest-scoring cut."""
    part = counts.filter("words between 1 and 3").select("lang", "phrase", "f")
    cuts = counts.filter("words >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn(
        "first", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "rest", F.expr("substring(phrase, length(first) + 2)")).withColumnRenamed("f", "a")
    with_l = join_hot(cuts, part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    with_r = join_hot(with_l, part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(a AS DECIMAL(19, 0)) * CAST(2000000 AS DECIMAL(7, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + r)")
    return with_r.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 to 4 words of each language of ``docs`` (lang, text).

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (the earliest of equal ones), ``n`` all words of the
    language.  Candidates occur ``least`` times; one whose words lie inside a longer candidate with at least ``inside`` % of its count
    is dropped.  Order: score, then ``a``, both from the highest, then the phrase by its UTF-8 bytes.

    A null text counts as empty, a null language as ``und``; repeated rows count again, an empty table gives an empty table, other
    columns and ids play no part.  A text of any length, also without an end of a piece, is counted in blocks.
    """
    counts, _ = write_table(phrase_counts(docs, least, bits), "phrases")
    scored = _scored(counts)
    spans = [(first, n) for n in (2, 3) for first in range(1, 5 - n + 1)]
    runs = F.array(*[F.when(F.col("words") > n, F.when(F.col("words") >= first + n - 1, F.array_join(
        F.slice(F.split("phrase", " "), first, n), " "))) for first, n in spans])
    covers = counts.filter("words >= 3").select("lang", F.explode(F.array_distinct(F.array_compact(runs))).alias("inner"), "f").groupBy(
        "lang", "inner").agg(F.max("f").alias("cover")).withColumnsRenamed({"lang": "_lang", "inner": "_inner"})
    left = scored.join(covers, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_inner")), "left").filter(
        F.col("cover").isNull() | (100 * F.col("cover") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
