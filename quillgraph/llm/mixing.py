"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A document should be taken ``target / source size`` times
(times its ``appeal``, where a column of relative weights is given).  The whole part of that number is certain: so many
whole copies are taken.  What is left over, a fraction between 0 and 1, is the document's inclusion odds, and one
more copy goes to the documents that come first in the order of

    random odds / inclusion odds = (u / (1 - u)) / (p / (1 - p))

with ``u`` a uniform number made from a hash of the document's id and the seed (Rosen's Pareto order sampling, of
fixed size and with unequal probabilities).  The size is fixed in words: a source's order is cut where the words
taken come nearest to its target, so a source misses its target by half a document at most (as long as there are
documents left to take).

The order is never sorted as a whole.  Ranks are mapped into (0, 1), counted in bins per source with
partial sums, and only the one bin in which the cut falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.llm.common import drop_table, numbered, word_count, write_table

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most copies of a source.
SHARE, MOST_COPIES = 1.5, 2
#: Bins of the order per source.  A bin is ordered in one task, so it should hold a few thousand rows; the work table
#: has at most this many rows per source.
BINS = 1 << 16


def uniform(doc_id: Column, seed: int) -> Column:
    """A number inside (0, 1) from 52 bits of the MD5 of seed and id; the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Targets are shares of ``share`` times all words by weight, cut to ``most_copies`` times the source; what is
    cut off is shared again by weight among the others until no source is above its limit.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, _ = write_table(numbered(per_source, [F.col("source").asc_nulls_last()], "_at").withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))))
    limit = most_copies * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        over = limit <= F.lit(rate) * F.col("_weight") if capped >= 0 else F.lit(False)
        n, cut, left = ranked.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == capped:
            break
        capped = n
        if not left:
            break
        rate = (total - (cut or 0)) / left
    target = F.least(limit.cast("double"), F.lit(rate) * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _ranked(docs: DataFrame, appeal: Column | None, seed: int) -> DataFrame:
    """The row as ``_doc``, and doc_id, source, _size, _appeal and the uniform number _u."""
    wish = F.lit(1.0) if appeal is None else F.greatest(F.coalesce(appeal.cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.struct("*").alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("_size"),
                       wish.alias("_appeal"), uniform(F.col("doc_id"), seed).alias("_u"))


def _placed(rows: DataFrame, per_source: DataFrame, most_copies: int) -> DataFrame:
    """Add certain copies ``_sure`` and rank ``_q`` (null: nothing left to draw) from the rate of the row's source."""
    some = F.col("_size") > 0
    expected = F.when(some, F.least(F.lit(float(most_copies)), F.coalesce("_rate", F.lit(0.0)) * F.col("_appeal"))).otherwise(0.0)
    return rows.join(per_source, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn(
        "_e", expected).withColumn("_sure", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_sure")).withColumn(
        "_q", F.when(F.col("_p") > 0, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))).drop("_e", "_p")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES,
             seed: int = 1, appeal: Column | None = None, bins: int = BINS) -> DataFrame:
    """One row per source: source, source_size, target, rate and the last rank that is taken (cut_q, cut_id, cut_size)."""
    rows, rows_path = write_table(_ranked(docs, appeal, seed).select(
        "source", "doc_id", F.col("_size"), "_appeal", "_u"), "sizes")
    targets = source_targets(rows.select("source", F.col("_size").alias("size")), weights, share, most_copies)
    drawn = rows.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("_size") * F.col("_appeal")).alias("_drawn"))
    rates, _ = write_table(targets.join(drawn, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", F.when(F.col("_drawn") > 0, F.col("target") / F.col("_drawn")).otherwise(
            0.0).alias("rate")), "rates")
    placed = _placed(rows, rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), "target"),
                     most_copies).withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * bins))

    # words wanted per source after the certain copies, and the bin of the order in which they are reached
    per_bin = placed.groupBy("source", "_bin").agg(
        F.sum("_size").alias("_words"), F.sum(F.col("_sure") * F.col("_size")).alias("_certain"), F.max("target").alias("target"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    marked = per_bin.withColumn("_wanted", F.max("target").over(whole) - F.sum("_certain").over(whole)).filter(
        "_bin is not null").withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    cut, _ = write_table(marked.filter("_before < _wanted").groupBy(F.col("source").alias("_source")).agg(
        F.max("_bin").alias("_cut"), F.max_by("_before", "_bin").alias("_before"), F.max("_wanted").alias("_wanted")), "cuts")

    # the bin of the cut in order; everything in the bins before it is taken
    at_edge = placed.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_cut"))).groupBy(
        "source", "_q", "doc_id", "_size").agg(F.count("*").alias("_n"), F.max("_before").alias("_before"), F.max("_wanted").alias("_wanted"))
    order = Window.partitionBy("source").orderBy("_q", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("_n") * F.col("_size")
    last = at_edge.withColumn("_upto", F.col("_before") + F.coalesce(F.sum(words).over(order), F.lit(0))).filter(
        F.col("_upto") + words / 2 <= F.col("_wanted")).groupBy(F.col("source").alias("_last_source")).agg(
        F.max(F.struct("_q", "doc_id", F.col("_size").alias("size"))).alias("_last"))
    # with no row of the bin taken, the cut is the end of the bin before
    edge = cut.join(last, F.col("_source").eqNullSafe(F.col("_last_source")), "left").select(
        "_source", F.coalesce("_last", F.struct(
            (F.col("_cut") / F.lit(float(bins)) / (1 - F.col("_cut") / F.lit(float(bins)))).alias("_q"),
            F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(-1).cast("long").alias("size"))).alias("_last"), "_cut")
    plan, _ = write_table(rates.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", "rate", F.col("_cut").alias("cut_bin"), F.col("_last._q").alias("cut_q"),
        F.col("_last.doc_id").alias("cut_id"), F.col("_last.size").alias("cut_size")), "plan")
    drop_table(docs.sparkSession, rows_path)
    return plan


def with_copies(docs: DataFrame, plan: DataFrame, most_copies: int = MOST_COPIES, seed: int = 1,
                appeal: Column | None = None, bins: int = BINS) -> DataFrame:
    """_doc (the whole row), _size, _source_size, _target and _copies, decided row by row from the plan (same options)."""
    renamed = plan.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"),
                          F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "cut_bin", "cut_q",
                          "cut_id", "cut_size")
    rows = _placed(_ranked(docs, appeal, seed), renamed, most_copies).withColumn(
        "_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * bins))
    mine, last = F.struct("_q", "doc_id", "_size"), F.struct("cut_q", "cut_id", "cut_size")
    taken = F.coalesce((F.col("_bin") < F.col("cut_bin")) | ((F.col("_bin") == F.col("cut_bin")) & (mine <= last)), F.lit(False))
    return rows.select("_doc", "_size", "_source_size", F.coalesce("_target", F.lit(0.0)).alias("_target"),
                       (F.col("_sure") + taken.cast("long")).alias("_copies"))


def _of_rows(options: dict) -> dict:
    """The options that concern single rows."""
    return {k: v for k, v in options.items() if k not in ("weights", "share")}


def pareto_mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    ``copies`` is the number of times the mix takes the document, ``taken`` the words that makes.  Options are those of
    ``mix_plan``.  ``appeal``, a non-negative expression over ``docs``, makes documents of one source unequally likely; a
    document's expected copies are cut to ``most_copies``, so a source with extreme appeals can fall short.

    A null text has size 0, documents without words are never taken, a null source is a source of its own
    that comes last, a null id counts as an empty one.  Rows of equal rank are ordered by id and size; rows that also
    share those are taken together.  An empty table gives an empty table.  Other columns are ignored.
    """
    return with_copies(docs, mix_plan(docs, **options), **_of_rows(options)).select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row for every copy that the mix takes: none, one or several.  All columns stay as they are."""
    return with_copies(docs, mix_plan(docs, **options), **_of_rows(options)).select(
        "_doc", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")
