"""Near-duplicate documents by MinHash, with odd sketches to check banded candidates before the exact test.

A document's set is its distinct 5-word shingles (64-bit hashes).  Equal sets are one node from the start.  Per node:

* ``rows * bands`` MinHash samples, of which every ``rows`` make a band; nodes that share a band are candidates.  ``bands``
  follows from the similarity, so that a pair just at the threshold is missed with probability MISS at most;
* an odd sketch: each sample flips one bit of a bitmap of BITS bits.  The bits in which two sketches differ estimate the
  Jaccard similarity, most precisely where it is high.  Candidates estimated ``SLACK`` below the threshold (over
  six standard deviations) are dropped, all others are tested on their full sets.

Groups of thousands of near copies share their bands, most of them without being near enough to each other, so pairs
are not listed group by group:

* A shingle that no other candidate has can't be shared.  With u such shingles among n, a set shares n - u at most, which bounds its
  similarity to any other set.  Pairs, and whole nodes, whose bound is too low are never compared.
* In a first phase, repeated ``PIVOT_ROUNDS`` times, every band names one pivot: first the node with the fewest shingles of its own,
  which is the hub of a group of copies, then another one.  A node is tested against the pivot its sketch is closest to, if that is
  in another component.
* Only then the pairs are listed that share a band, are still in different components and have close sketches, each once, and all
  of them are tested.

What comes out are the exact components; the links inside a component that was already joined are never needed.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.bytewords import Piece, joined, pieces
from quillgraph.llm.common import drop_table, map_rows, mix64, write_table
from quillgraph.operators.traversal import component_labels

SHINGLE, SIMILARITY = 5, 80
#: Chance of missing a pair at the threshold, samples per band, bits of a sketch, tolerance of its estimate.
MISS, ROWS, BITS, SLACK = 1e-9, 5, 512, 0.17
PIVOT_ROUNDS = 2
#: Shingles that are hashed under all samples at a time.
BLOCK = 1024


def band_count(similarity: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that miss a pair at ``similarity`` percent with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (similarity / 100) ** rows))


def most_differing(similarity: int, samples: int, bits: int = BITS, slack: float = SLACK) -> int:
    """Differing bits of two odd sketches up to which their similarity may reach the threshold.

    The estimate is 1 + bits / (4 samples) * ln(1 - 2 differing / bits).
    """
    return math.floor(bits / 2 * (1 - math.exp(4 * samples * (similarity / 100 - slack - 1) / bits)))


def shingle_sets(p: Piece, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle, none make an empty set."""
    runs = joined(p.words, size)
    out = []
    for a, b in zip(p.at[:-1].tolist(), p.at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            out.append(mix64(joined(p.words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    return [s for p in pieces(texts, lower=True) for s in shingle_sets(p)]


def min_hashes(items: np.ndarray, samples: int) -> np.ndarray:
    """The smallest of ``items`` under each of ``samples`` fixed hash functions."""
    n = np.arange(1, 2 * samples + 1, dtype=np.uint64)
    factor, shift = mix64(n[:samples]) | np.uint64(1), mix64(n[samples:])
    best = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), BLOCK):
        np.minimum(best, (items[start:start + BLOCK, None] * factor + shift).min(axis=0), out=best)
    return best


def odd_sketch(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit integers."""
    at = mix64(mins + np.arange(len(mins), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def band_hashes(mins: np.ndarray, rows: int) -> np.ndarray:
    """One signed hash per band of ``rows`` samples, different in each band."""
    grid = mins.reshape(-1, rows)
    out = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + grid[:, k])
    return out.view(np.int64)


def set_key(items: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set, as two signed integers."""
    return tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist())


def features(docs: DataFrame, bands: int, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (digest of the set), sketch and bands; the last two are null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_shingles": [], "k1": [], "k2": [], "sketch": [], "bands": []}
        for items in _sets(batch["text"]):
            mins = min_hashes(items, bands * rows) if len(items) else None
            out["n_shingles"].append(len(items))
            for name, half in zip(("k1", "k2"), set_key(items)):
                out[name].append(half)
            out["sketch"].append(None if mins is None else odd_sketch(mins, bits))
            out["bands"].append(None if mins is None else band_hashes(mins, rows))
        return out

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_shingles long, k1 long, k2 long, sketch array<long>, bands array<long>", run)


def _differ(a: str, b: str, bits: int):
    """Bits in which two sketches differ."""
    return reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)])


def _close(pairs: DataFrame, signs: DataFrame, most: int, bits: int) -> DataFrame:
    """Pairs (a, b) with the differing bits of their sketches, where there are at most ``most`` or an id has several texts."""
    side = lambda end: signs.select(F.col("node").alias(end), F.col("sketch").alias(f"_{end}"), F.col("several").alias(f"_s{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", _differ("_a", "_b", bits)).filter(
        (F.col("differ") <= most) | F.col("_sa") | F.col("_sb")).select("a", "b", "differ")


def _own_shingles(texts: DataFrame) -> DataFrame:
    """(k1, k2, u): shingles that no other set of the table has, for the sets that have any."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        sets = _sets(batch["text"])
        keys = [set_key(s) for s in sets]
        return {"k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "items": [s.view(np.int64) for s in sets]}

    rows = map_rows(texts, ["text"], "k1 long, k2 long, items array<long>", run)
    # rows with equal sets would hide each other's shingles, which only weakens the bound
    return rows.select("k1", "k2", F.explode("items").alias("item")).groupBy("item").agg(
        F.count("*").alias("_n"), F.min("k1").alias("k1"), F.min("k2").alias("k2")).filter("_n = 1").groupBy("k1", "k2").agg(
        F.count("*").alias("u"))


def _reachable(n: str, u: str, m: str, v: str, similarity: int):
    """Whether sets of n and m shingles, u and v of them their own, can reach the similarity."""
    most = F.least(F.col(n) - F.col(u), F.col(m) - F.col(v))
    return most * 100 >= (F.col(n) + F.col(m) - most) * similarity


def _linked(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"_{end}"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batch: dict[str, list]) -> dict[str, list]:
        yes = []
        for i, (x, y) in enumerate(zip(_sets(batch["_a"]), _sets(batch["_b"]))):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= similarity * (len(x) + len(y) - both):
                yes.append(i)
        return {"src": [batch["a"][i] for i in yes], "dst": [batch["b"][i] for i in yes]}

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return map_rows(both, ["a", "b", "_a", "_b"], f"src {kind}, dst {kind}", run)


def components(docs: DataFrame, similarity: int = SIMILARITY, rows: int = ROWS, bits: int = BITS,
               pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * shared >= ``similarity`` * united shingles; component_id is the smallest doc_id that can
    be reached, the document itself included, and kept marks the documents that are their component's smallest.

    Null text and text without words have an empty set, link to nothing and are their own component.  Null ids never name
    a component that has numbers; without any number component_id is null and kept true.  Rows that repeat an id and a text are
    one document and marked alike; an id with several texts is one node, linked by any of them.  Empty table: no rows.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    bands = band_count(similarity, rows)
    most = most_differing(similarity, bands * rows, bits)
    feats, _ = write_table(features(docs, bands, rows, bits), "features")
    full = feats.filter("n_shingles > 0")
    sets = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    firsts = full.join(sets, ["k1", "k2"]).filter("doc_id = node")

    # bands that at least two nodes share, and the nodes that can have a link at all
    spread = firsts.select("node", "k1", "k2", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    busy = spread.groupBy("band").agg(F.count("*").alias("_n")).filter("_n > 1")
    met, met_path = write_table(spread.join(busy, "band"), "met")
    texts, texts_path = write_table(docs.select(F.col("doc_id").alias("node"), "text").join(
        met.select("node").distinct(), "node", "left_semi"), "texts")
    shared, shared_path = write_table(met.join(_own_shingles(texts), ["k1", "k2"], "left").select(
        "band", "node", "n", F.coalesce("u", F.lit(0)).alias("u")).filter((F.col("n") - F.col("u")) * 100 >= F.col("n") * similarity), "shared")
    drop_table(spark, met_path)
    signs, signs_path = write_table(firsts.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("sketch", "bands")).alias("_s"), (F.min(F.struct("k1", "k2")) != F.max(F.struct("k1", "k2"))).alias("several")).select(
        "node", "_s.*", "several"), "signs")

    labels = links = tested = None
    spent: list[str] = []
    for turn in range(pivot_rounds + 1):
        inside = shared.withColumn("comp", F.col("node")) if labels is None else shared.join(labels, "node", "left").select(
            "band", "node", "n", "u", F.coalesce("label", "node").alias("comp"))
        inside, inside_path = write_table(inside.join(inside.groupBy("band").agg(
            F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("band"), "band"), "open")
        if turn < pivot_rounds:
            drawn = F.struct((F.lit(0) if turn else F.col("u")).alias("own"), F.xxhash64("node", "band", F.lit(turn)).alias("h"),
                             "node", "comp", "n", "u")
            pivots = inside.groupBy("band").agg(F.min(drawn).alias("_p")).select(
                "band", F.col("_p.node").alias("b"), F.col("_p.comp").alias("_cb"), F.col("_p.n").alias("m"), F.col("_p.u").alias("v"))
            pairs = inside.join(pivots, "band").filter(
                (F.col("comp") != F.col("_cb")) & _reachable("n", "u", "m", "v", similarity)).select(F.col("node").alias("a"), "b").distinct()
            pairs = _close(pairs, signs, most, bits).groupBy("a").agg(
                F.min(F.struct("differ", "b")).alias("_best")).select("a", F.col("_best.b").alias("b"))
        else:
            # a pair is made once, in the smallest band it shares, and only if its sketches are close
            signed = inside.join(signs, "node")
            left = signed.select("band", F.col("node").alias("a"), "n", "u", F.col("comp").alias("_ca"), F.col("sketch").alias("_a"),
                               F.col("bands").alias("_ba"), F.col("several").alias("_sa"))
            right = signed.select(F.col("band").alias("_band"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("u").alias("v"),
                                F.col("comp").alias("_cb"), F.col("sketch").alias("_b"), F.col("bands").alias("_bb"), F.col("several").alias("_sb"))
            near = (_differ("_a", "_b", bits) <= most) & (F.col("band") == F.array_min(F.array_intersect("_ba", "_bb")))
            pairs = left.join(right, (F.col("band") == F.col("_band")) & (F.col("_ca") < F.col("_cb")) & _reachable(
                "n", "u", "m", "v", similarity) & (F.col("_sa") | F.col("_sb") | near)).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, pairs_path = write_table(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new, new_path = write_table(_linked(pairs, texts, similarity), "links")
        links = new if links is None else links.unionByName(new)
        labels, _ = write_table(component_labels(links), "labels")
        drop_table(spark, inside_path)
        spent += [pairs_path, new_path]
    named, _ = write_table(sets.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component_id")), "named")
    drop_table(spark, shared_path, signs_path, texts_path, *spent)
    alone = feats.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = full.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, similarity: int = SIMILARITY, **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their component, with their columns."""
    marks = components(docs, similarity, **options).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    return rows.join(marks, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_doc.*")
