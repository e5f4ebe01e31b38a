"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words.  A line goes when an earlier line, in the order of (doc_id, line number), has
Jaccard similarity of ``similarity`` percent or more with it, equal sets included.  Whether that earlier line goes as
well makes no difference.

1. Lines of equal sets are combined before they are shuffled into one class with its first line; texts are not shuffled for that.
2. Words are ordered by rarity: words are counted over all lines in LEVELS hash buckets, and the logarithm of
   the bucket's count, then the word's hash, is its rank.  Any fixed order gives the same result; rarity makes it fast, and
   the table of levels has the same size for any input.
3. Two sets of that similarity share a word among the rarest ``n - ceil(similarity * n) + 1`` of each (prefix filter).  Classes meet
   on those words.  Their sizes must be near enough (length filter), and from the places of the common word in both orders
   enough words must be left behind it (positional filter).  A parity bitmap of 128 bits for each set bounds how many words differ: sets of 100
   words at a similarity of 80 % may differ in 22, and unlike ones differ in about 64 bits.
4. One earlier match is enough to drop a line, so a group of near copies need not be paired with itself.  First, classes meet
   witnesses only: for a few words of their prefix the earliest class that has it, and the last one before them, which settles copies that are
   not near enough to the first.  A class with a match is settled.  Then the others meet all earlier classes, on all words of their prefix.
5. The texts of the classes that are in a pair are fetched by their place.  Wide parity bitmaps, made once for each of them, bound the difference
   again (for long lines); the pairs left over are compared word by word.

A set is named by two 64-bit hashes of its ranks, so two sets of a corpus of n are mistaken for one with a probability of
about n * n / 2 ** 128; whether lines are near is decided on their words.  Two words of one line with equal 64-bit hashes
would count as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.llm.common import drop_table, free_shuffles, write_table

SIMILARITY = 80
#: Hash buckets in which words are counted.
LEVELS = 1 << 18


def _cut(line: Column) -> Column:
    """The words of a line, and empty strings; the usual line has only spaces between words."""
    return F.when(line.rlike(r"[\t\x0B\f\r]"), F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))


def _hashes(line: Column) -> Column:
    """Hashes of the different words of a line."""
    return F.array_remove(F.array_distinct(F.transform(_cut(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _flag(place: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, _row (hash of the text, which tells rows of one id apart), _line and _text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_row"), F.posexplode(F.split(text, "\n")).alias("_line", "_text"))


def _least_shared(n: Column, similarity: int) -> Column:
    """ceil(similarity * n / 100)"""
    return F.ceil((n * similarity) / F.lit(100.0)).cast("int")


def _levels(docs: DataFrame) -> bytes:
    """Twice the binary logarithm of the number of words, one byte for each of the LEVELS hash buckets: 256 KiB at any size of the corpus.

    Words are counted with repeats, as they are cut; the table only fixes an order.
    """
    words = docs.select(F.explode(_cut(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("_word")).filter("_word <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("_word")).alias("_bucket")).agg(F.floor(2 * F.log2(F.count("*"))).cast("int").alias("_level"))
    levels = bytearray(LEVELS)
    for bucket, level in counts.toLocalIterator():
        levels[bucket] = level
    return bytes(levels)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(LEVELS - 1)).cast("int")


def _ranked(docs: DataFrame, levels: bytes, similarity: int) -> DataFrame:
    """A row per line with words: two hashes of its set, its place, its number of words, a parity bitmap and its prefix.

    A line is ranked where it lies, without a shuffle of its text or a sort of words.  The bitmap (_p and _q) tells for each of 128 places
    whether an odd number of words falls on it; a word in which two sets differ changes one place.
    """
    # cast and split are folded into one constant array
    level_of = F.split(F.lit(",".join(str(level << 55) for level in levels)), ",").cast("array<bigint>")

    def rank(h: Column) -> Column:
        return F.get(level_of, _bucket(h)).bitwiseOR(F.shiftrightunsigned(h, 9))

    def place(h: Column) -> Column:
        return h.bitwiseAND(F.lit(63)).cast("int")

    def parity(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate("_h", F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", bit(h), place(h))))

    # the filter looks at the text, so that words are not cut once more for it
    hashed = _lines(docs).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]")).select(
        F.struct("doc_id", "_row", "_line").alias("_first"), _hashes(F.col("_text")).alias("_h"))
    # _both has the parities of two places in one bit, _q those of the second
    sets = hashed.select(
        "_first", F.size("_h").alias("_n"), parity(lambda h: F.lit(1).cast("long")).alias("_both"),
        parity(lambda h: F.shiftrightunsigned(h, 63)).alias("_q"),
        F.sort_array(F.transform("_h", rank)).alias("_ranks"))
    prefix = F.slice("_ranks", F.lit(1), F.col("_n") - _least_shared(F.col("_n"), similarity) + 1)
    return sets.select(F.xxhash64("_ranks").alias("_i"), F.xxhash64(F.lit(1), "_ranks").alias("_j"), "_first", "_n",
                       F.col("_both").bitwiseXOR(F.col("_q")).alias("_p"), "_q", prefix.alias("_prefix"))


def _classes(ranked: DataFrame) -> DataFrame:
    """One class per set, with its first line, numbered (_ord) in the order of that."""
    one = ranked.groupBy("_i", "_j").agg(F.min(F.struct("_first", "_n", "_p", "_q", "_prefix")).alias("_c")).select("_c.*")
    return one.repartitionByRange("_first").sortWithinPartitions("_first").withColumn("_ord", F.monotonically_increasing_id())


def _prefix_rows(classes: DataFrame, drawn: int | None = None) -> DataFrame:
    """A row per class and prefix word: _rank, _ord, _size and the bitmap.

    _size packs the number of words (upper half), whether the class is settled (bit 31) and the place of the word.  ``drawn`` takes that many
    words only, those with the smallest hashes: copies agree on them more often than on the rarest, which are the words that were changed.
    Their places are given as 0, which bounds nothing.
    """
    prefix = F.col("_prefix")
    if drawn is not None:
        prefix = F.slice(F.sort_array(F.transform("_prefix", lambda r: r.bitwiseAND(F.lit((1 << 55) - 1)))), 1, drawn)
    head = F.shiftleft(F.col("_n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("_settled").cast("long"), 31))
    rows = classes.select("_ord", head.alias("_head"), "_p", "_q", F.posexplode(prefix).alias("_at", "_rank"))
    size = F.col("_head") if drawn is not None else F.col("_head").bitwiseOR(F.col("_at").cast("long"))
    rows = rows.select("_rank", "_ord", size.alias("_size"), "_p", "_q")
    # nothing is null here; saying so keeps both sides of a self-join one shuffle
    return rows.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in rows.columns])


#: The bit of _size that marks a settled class.
SETTLED = 1 << 31


def _passes(x: Callable[[str], Column], y: Callable[[str], Column], similarity: int) -> tuple[Column, Column, Column]:
    """Whether a probe and an earlier class that share a word pass all filters on hashes, the words they must share and in how many they may differ."""
    n, m = (F.shiftright(r("_size"), 32).cast("int") for r in (x, y))
    i, j = (r("_size").bitwiseAND(F.lit(SETTLED - 1)).cast("int") for r in (x, y))
    shared = F.ceil((n + m) * F.lit(float(similarity)) / F.lit(100.0 + similarity)).cast("int")
    most = n + m - 2 * shared
    apart = F.bit_count(x("_p").bitwiseXOR(y("_p"))) + F.bit_count(x("_q").bitwiseXOR(y("_q")))
    near = (F.least(n, m) * 100 >= F.greatest(n, m) * similarity) & (F.least(n - i, m - j) >= shared) & (apart <= most)
    return near, shared, most


def _witnesses(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs as ``_candidates`` makes them, of each class and two of the earlier classes with a word of its: the first one and the one before it."""
    by_word = Window.partitionBy("_rank").orderBy("_ord")
    whole = F.struct("_ord", "_size", "_p", "_q")
    met = rows.select("_ord", "_size", "_p", "_q", F.first(whole).over(by_word).alias("_w1"), F.lag(whole).over(by_word).alias("_w2"))
    found = []
    for w in ("_w1", "_w2"):
        near, shared, most = _passes(F.col, lambda c, w=w: F.col(w).getField(c), similarity)
        found.append(F.when((F.col("_ord") > F.col(w)["_ord"]) & near, F.struct(
            F.col(w)["_ord"].alias("_y"), shared.alias("_shared"), most.alias("_most"))))
    return met.select(F.col("_ord").alias("_x"), F.explode(F.array_compact(F.array(*found))).alias("_pair")).select("_x", "_pair.*").distinct()


def _candidates(probes: DataFrame, others: DataFrame, similarity: int) -> DataFrame:
    """Pairs (_x, _y) of a probe and an earlier class that share a word and pass all filters on hashes, with the words they must share
    (_shared) and in which they may differ (_most)."""
    x, y = probes.alias("x"), others.alias("y")
    near, shared, most = _passes(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), similarity)
    # one comparison of both ends: a filter on x alone would be pushed below the shuffle, which both sides share
    earlier = F.when(F.col("x._size").bitwiseAND(F.lit(SETTLED)) == 0, F.col("x._ord")).otherwise(-1) > F.col("y._ord")
    return x.join(y, (F.col("x._rank") == F.col("y._rank")) & earlier & near).select(
        F.col("x._ord").alias("_x"), F.col("y._ord").alias("_y"), shared.alias("_shared"), most.alias("_most")).distinct()


def _texts(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """_ord and _text (of its first line) of the classes that are in a pair."""
    ends = pairs.select(F.col("_x").alias("_ord")).union(pairs.select("_y")).distinct()
    places = ends.join(classes.select("_ord", "_first"), "_ord").select(
        "_ord", F.col("_first.doc_id").alias("_id"), F.col("_first._row").alias("_of"), F.col("_first._line").alias("_at"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")) & (F.col("_line") == F.col("_at"))
    # rows that repeat id and text have the line several times
    return _lines(docs).join(places, here).groupBy("_ord").agg(F.min("_text").alias("_text"))


def _close(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, str]:
    """The written pairs whose wide sketches differ in no more places than they may have different words.

    The sketch is a parity bitmap of 512 places.  It is made once per class that is in a pair, so a class in many pairs is cut into words once.
    """
    words = texts.select("_ord", F.explode(_hashes(F.col("_text"))).alias("_h"))
    slot, flag = F.shiftrightunsigned("_h", 61), _flag(F.shiftrightunsigned("_h", 55).bitwiseAND(F.lit(63)))
    parts = [f"_s{i}" for i in range(8)]
    made, path = write_table(words.select("_ord", slot.alias("_slot"), flag.alias("_flag")).groupBy("_ord").agg(
        *[F.bit_xor(F.when(F.col("_slot") == i, F.col("_flag")).otherwise(0)).alias(c) for i, c in enumerate(parts)]), "sketches")
    of = lambda end: made.select(F.col("_ord").alias(f"_{end}"), F.array(*parts).alias(f"_{end}s"))
    both = pairs.join(of("x"), "_x").join(of("y"), "_y")
    apart = reduce(Column.__add__, [F.bit_count(F.get("_xs", F.lit(i)).bitwiseXOR(F.get("_ys", F.lit(i)))) for i in range(8)])
    kept = write_table(both.filter(apart <= F.col("_most")).select("_x", "_y", "_shared"), "close-pairs")
    drop_table(pairs.sparkSession, path)
    return kept


def _matched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(_ord) of the probes that share as many words as they must with the class they met."""
    text = lambda end: texts.select(F.col("_ord").alias(f"_{end}"), F.col("_text").alias(f"_{end}text"))
    full = pairs.join(text("x"), "_x").join(text("y"), "_y")
    both = F.array_remove(F.array_intersect(_cut(F.col("_xtext")), _cut(F.col("_ytext"))), "")
    return full.filter(F.size(both) >= F.col("_shared")).select(F.col("_x").alias("_ord")).distinct()


#: Words of a prefix by which classes meet witnesses, and rounds of that.
WITNESS_WORDS, WITNESS_ROUNDS = 4, 1


def _late_classes(classes: DataFrame, docs: DataFrame, similarity: int) -> list[tuple[DataFrame, str]]:
    """Written tables (_ord) of the classes that match an earlier one: a table per witness round and one of the rest."""
    spark = classes.sparkSession
    found: list[tuple[DataFrame, str]] = []
    for step in range(WITNESS_ROUNDS + 1):
        marked = classes.withColumn("_settled", F.lit(False))
        if found:
            settled = reduce(DataFrame.unionByName, [table for table, _ in found]).withColumn("_settled", F.lit(True))
            marked = classes.join(settled, "_ord", "left").withColumn("_settled", F.coalesce("_settled", F.lit(False)))
        if step < WITNESS_ROUNDS:
            met = _witnesses(_prefix_rows(marked.filter("NOT _settled"), WITNESS_WORDS), similarity)
        else:
            # settled classes stay in the one shuffle that both sides share; as probes they meet nothing
            rows = _prefix_rows(marked).repartition(F.col("_rank"))
            met = _candidates(rows, rows, similarity)
        pairs, path = write_table(met, "line-pairs")
        free_shuffles(spark)
        texts, texts_path = write_table(_texts(pairs, classes, docs), "pair-texts")
        free_shuffles(spark)
        close, close_path = _close(pairs, texts)
        found.append(write_table(_matched(close, texts), "late"))
        drop_table(spark, path, texts_path, close_path)
        free_shuffles(spark)
    return found


def removed_lines(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, _row, n_lines and removed (array of 0-based line numbers, in order) for every different row of ``docs`` (doc_id, text).

    Lines are split at "\\n"; lines without words stay.  Null text is one line without words.  Null ids come first in the order, rows of one
    id are ordered by a hash of their text, rows that repeat id and text are one document.  A very long line is one set.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    classes, classes_path = write_table(_classes(_ranked(docs, _levels(docs), similarity)), "classes")
    free_shuffles(spark)
    late = _late_classes(classes, docs, similarity)
    every = reduce(DataFrame.unionByName, [table for table, _ in late])
    # of a class that matches no earlier one its first line stays; all other lines with words go
    stay, _ = write_table(classes.join(every, "_ord", "left_anti").select("_first.*"), "stay")
    drop_table(spark, classes_path, *[path for _, path in late])
    free_shuffles(spark)
    text = F.coalesce("text", F.lit(""))
    worded = F.array_compact(F.transform(F.col("_lines"), lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_row"), F.split(text, "\n").alias("_lines")).select(
        "doc_id", "_row", F.size("_lines").cast("long").alias("n_lines"), worded.alias("_worded"))
    return rows.unionByName(stay, allowMissingColumns=True).groupBy("doc_id", "_row").agg(
        F.max("n_lines").alias("n_lines"), F.first("_worded", True).alias("_worded"), F.collect_list("_line").alias("_stay")).select(
        "doc_id", "_row", "n_lines", F.array_except("_worded", "_stay").alias("removed"))


def line_report(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed, removed: a row per document, see ``removed_lines``."""
    return removed_lines(docs, similarity).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def drop_repeated_lines(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones; n_chars, where there is such a column, follows the text.

    A row of which no line is left keeps an empty text, null text stays null.
    """
    gone = removed_lines(docs, similarity).filter(F.size("removed") > 0).select(
        F.col("doc_id").alias("_gone_id"), F.col("_row").alias("_gone_row"), "removed")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left")
    # a column of its own, so that a text is not split again for each of its lines
    split = joined.select("_doc", "removed", F.split(F.col("_doc.text"), "\n").alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("removed"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_doc.text")).otherwise(rest)
    changed = {"text": text, **({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return split.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
