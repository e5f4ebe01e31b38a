"""Lexical scoring of graph nodes and phrase search over chunks; how questions and texts meet is in ``matching``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.operators.matching import (
    best_in_blocks, count_in_groups, phrase_matches, score_in_groups, similar_strings, with_match_terms)
from quillgraph.operators.ordering import cut_lineage

def lowered_fields(nodes: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return nodes.select("id", "node_seq", low("label").alias("label"), low("heading_path").alias("heading"),
                        low("category").alias("category"))


def distinct_texts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, places): the different texts of nodes with their first node, and (text_id, id, node_seq) of every node."""
    fields = ["label", "heading", "category"]
    rows = lowered_fields(nodes)
    texts = cut_lineage(rows.groupBy(*fields).agg(F.min("node_seq").alias("seq")).withColumn("text_id", F.monotonically_increasing_id()))
    return texts, rows.join(texts.select("text_id", *fields), fields).select("text_id", "id", "node_seq")


def _scores(queries: DataFrame, texts: DataFrame, k: int | None) -> DataFrame:
    q = with_match_terms(queries).filter(F.size("terms") > 0).select(F.lit(0).alias("group_id"), "query_id", "terms")
    no_bonus = F.lit(0.0)
    return score_in_groups(q, texts.select(F.lit(0).alias("group_id"), "text_id", "label", "heading", "category",
                                           no_bonus.alias("bonus_a"), no_bonus.alias("bonus_b"), "seq"), k)


def find_nodes(queries: DataFrame, nodes: DataFrame, top_k: int = 10) -> DataFrame:
    """Best ``top_k`` nodes per question; ties by node order.  Adds ``rank`` from 1.

    Nodes of one text score alike, so texts are scored, and the first ``top_k`` nodes of the best texts take part.
    """
    texts, places = distinct_texts(nodes)
    first = places.withColumn("_n", F.row_number().over(Window.partitionBy("text_id").orderBy("node_seq"))).filter(
        F.col("_n") <= top_k).drop("_n")
    best = _scores(queries, texts, top_k).join(texts.select("text_id", "seq"), "text_id")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "seq"))).filter(
        F.col("_n") <= top_k)
    return top_k_nodes(best.join(first, "text_id").select("query_id", "id", "node_seq", F.col("relevance").alias("score")), top_k)


def top_k_nodes(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_seq")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_nodes(queries: DataFrame, nodes: DataFrame, mode: str = "cascade") -> DataFrame:
    """All nodes with a score above zero, per question.

    ``cascade``: exact terms, else shared bigrams.  A third, edit-distance layer could only fire
    when no bigram is shared, and then never reaches its threshold; ``independent`` reports
    the best of the cascade and that layer on its own.
    """
    texts, places = distinct_texts(nodes)
    base = _scores(queries, texts, None).join(places, "text_id").select("query_id", "id", "node_seq", F.col("relevance").alias("score"))
    if mode == "cascade":
        return base
    fuzzy = fuzzy_scores(queries, nodes).withColumnRenamed("similarity", "fuzzy")
    joined = base.select("query_id", "id", "score").join(fuzzy, ["query_id", "id"], "full")
    return joined.select("query_id", "id", F.greatest(
        F.coalesce("score", F.lit(0.0)), F.coalesce("fuzzy", F.lit(0.0))).alias("score")).join(
        nodes.select("id", "node_seq"), "id").select("query_id", "id", "node_seq", "score")


def counted_texts(nodes: DataFrame) -> DataFrame:
    """The different texts of nodes with their number of nodes, as one group."""
    fields = ["label", "heading", "category"]
    return cut_lineage(lowered_fields(nodes).groupBy(*fields).agg(F.count("*").alias("places")).select(
        F.lit(0).alias("group_id"), F.monotonically_increasing_id().alias("text_id"), *fields, "places"))


def score_counts(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, score, n): how many nodes have a score, for all scores above zero; ``score_nodes`` without its list of pairs."""
    q = with_match_terms(queries).filter(F.size("terms") > 0).select(F.lit(0).alias("group_id"), "query_id", "terms")
    return count_in_groups(q, counted_texts(nodes)).groupBy("query_id", F.col("relevance").alias("score")).agg(F.sum("n").alias("n"))


def _fuzzy(queries: DataFrame, texts: DataFrame, min_similarity: float, min_length_ratio: float, counted: bool) -> DataFrame:
    """``best_in_blocks`` for questions and texts (text_id, label, heading, category, places), by their distinct terms and tokens."""
    terms = cut_lineage(with_match_terms(queries).select("query_id", F.explode("terms").alias("term")).filter(F.length("term") >= 2))
    tokens = cut_lineage(texts.select("text_id", "places", F.explode(F.array_distinct(F.regexp_extract_all(
        F.concat_ws(" ", "label", "heading", "category"), F.lit(T.V.QUERY_TOKEN), F.lit(0)))).alias("token")))
    numbered = cut_lineage(terms.select("term").distinct().withColumn("n_term", F.monotonically_increasing_id()))
    ratio = F.least(F.length("term"), F.length("token")) / F.greatest(F.length("term"), F.length("token"))
    similar = cut_lineage(similar_strings(numbered.select("term"), tokens.select("token").distinct(), min_similarity).filter(
        ratio >= min_length_ratio).join(numbered, "term").select("token", "n_term", "similarity"))
    one = F.lit(0).alias("group_id")
    met = tokens.join(similar, "token").groupBy("text_id", "places", "n_term").agg(F.max("similarity").alias("similarity")).groupBy(
        "text_id", "places").agg(F.collect_list(F.struct("n_term", "similarity")).alias("_m"))
    asked = terms.join(numbered, "term").groupBy("query_id").agg(F.collect_list("n_term").alias("terms"))
    return best_in_blocks(asked.select(one, "query_id", "terms"), met.select(
        one, "text_id", "places", F.col("_m.n_term").alias("terms"), F.col("_m.similarity").alias("similar")), counted)


def fuzzy_scores(queries: DataFrame, nodes: DataFrame, min_similarity: float = 0.7,
                 min_length_ratio: float = 0.6) -> DataFrame:
    """Best normalised edit similarity between a question term and a node token.

    Works on distinct terms and tokens, which meet on an unchanged piece (``matching.similar_strings``), and on distinct texts.
    """
    texts, places = distinct_texts(nodes)
    best = _fuzzy(queries, texts.withColumn("places", F.lit(1)), min_similarity, min_length_ratio, False)
    return best.join(places, "text_id").select("query_id", "id", "similarity")


def fuzzy_counts(queries: DataFrame, nodes: DataFrame, min_similarity: float = 0.7, min_length_ratio: float = 0.6) -> DataFrame:
    """(query_id, n, best): how many nodes a question has in ``fuzzy_scores``, and its best similarity, without the list of pairs."""
    return _fuzzy(queries, counted_texts(nodes), min_similarity, min_length_ratio, True).groupBy("query_id").agg(
        F.sum("n").alias("n"), F.max("best").alias("best"))


def relevance(terms: Column, bigrams: Column, label: Column, heading: Column, category: Column) -> Column:
    """The same layers for one (question, node) pair, as a column."""
    def score(joined: Column) -> Column:
        exact = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(
            joined.contains(t), F.when(heading.contains(t), 3.0).when(label.contains(t), 2.5).otherwise(1.5)
        ).otherwise(0.0))
        shared = F.size(F.filter(bigrams, lambda g: joined.contains(g)))
        return T.let(exact, lambda e: F.when(e > 0, e).otherwise(
            shared / F.greatest(F.size(bigrams), F.lit(1)) * 1.5))
    return T.let(F.concat_ws(" ", label, heading, category), score)


def node_features(nodes: DataFrame, degree: DataFrame, communities: DataFrame, cohesion: DataFrame) -> DataFrame:
    """Scoring fields of every node with its community density and degree."""
    by_community = communities.join(cohesion.select("community_id", "cohesion"), "community_id", "left")
    return lowered_fields(nodes).join(degree.select("id", "degree"), "id", "left").join(
        by_community.select("id", "cohesion"), "id", "left").fillna({"degree": 0, "cohesion": 0.0})


def rank_nodes(visited: DataFrame, queries: DataFrame, features: DataFrame) -> DataFrame:
    """Score visited nodes: 2 x relevance + community density + capped degree bonus."""
    q = queries.select("query_id", T.rank_terms("query").alias("terms")).withColumn(
        "bigrams", T.char_bigrams("terms"))
    pairs = visited.select("query_id", "id").join(features, "id").join(q, "query_id")
    rel = relevance(F.col("terms"), F.col("bigrams"), F.col("label"), F.col("heading"), F.col("category"))
    return pairs.select("query_id", "id", "node_seq", (
        rel * 2.0 + F.col("cohesion") + F.least(F.col("degree") / 10.0, F.lit(1.0)) * 0.5).alias("score"))


def rank_with_hubs(visited: DataFrame, cells: DataFrame, hub_texts: tuple[DataFrame, DataFrame], queries: DataFrame,
                   features: DataFrame, k: int) -> DataFrame:
    """(query_id, id, node_seq, score): nodes of ``visited`` and the best ``k`` of the cells (query_id, cell) of each question.

    ``hub_texts`` is what ``cell_texts`` made of the same features.
    """
    listed, kept = hub_texts
    q = queries.select("query_id", T.rank_terms("query").alias("terms"))
    asked = cells.join(q, "query_id").select(F.col("cell").alias("group_id"), "query_id", "terms")
    best = score_in_groups(asked, listed.withColumnRenamed("cell", "group_id"), k, 2.0, all_texts=True)
    from_hubs = best.join(kept, "text_id").select("query_id", "id", "node_seq", (
        F.col("relevance") * 2.0 + F.col("bonus_a") + F.col("bonus_b")).alias("score"))
    return rank_nodes(visited, queries, features).unionByName(from_hubs).dropDuplicates(["query_id", "id"])


def cell_texts(cell_of_node: DataFrame, features: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(texts, nodes) of each cell: its different texts with their best node, and the first ``k`` nodes of every text.

    Nodes of one text are equally relevant to any question, so their order does not depend on it: by community density and
    degree, then node order.
    """
    fields = ["cell", "label", "heading", "category"]
    bonus = (F.least(F.col("degree") / 10.0, F.lit(1.0)) * 0.5).alias("bonus_b")
    rows = features.join(cell_of_node, "id").select(*fields, "id", "node_seq", F.col("cohesion").alias("bonus_a"), bonus)
    order = Window.partitionBy(*fields).orderBy(F.desc(F.col("bonus_a") + F.col("bonus_b")), "node_seq")
    kept = cut_lineage(rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k))
    texts = cut_lineage(kept.filter("_n = 1").select(*fields, "bonus_a", "bonus_b", F.col("node_seq").alias("seq"),
                                                     F.monotonically_increasing_id().alias("text_id")))
    return texts, kept.join(texts.select("text_id", *fields), fields).select("text_id", "id", "node_seq", "bonus_a", "bonus_b")


#: Rows that phrases are looked for first: these, or one in so many if that is more; tables of fewer than four times as many are searched at once.
FIRST_ROWS, FIRST_PART = 32_768, 64


def _first_rows(rows: DataFrame, order: Column) -> Column | None:
    """Which rows stand first in ``order``, about as many as are to be searched first; None if there are too few rows.

    The place of the cut is estimated from a sample.  It decides which rows are looked at first, not what is found.
    """
    n = rows.count()
    if n < 4 * FIRST_ROWS:
        return None
    share = min(1.0, 65_536 / n)
    placed = rows.sample(share, 1).select(order.alias("o")).orderBy("o").offset(int(max(FIRST_ROWS, n // FIRST_PART) * share) - 1).limit(1)
    kinds, last = placed.schema["o"].dataType, placed.first()
    return None if last is None else order <= F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last["o"], kinds)])


def search_text(chunks: DataFrame, queries: DataFrame, category: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks whose content or heading path holds the question as a phrase.

    Every term must occur, and the whole phrase is the first term, so this is a phrase search;
    ASCII letters of the stored side are folded.  First ``limit`` per question by heading path.

    The first rows in this order are searched before the others: a phrase that has its ``limit`` there cannot get another one from
    later rows, and only phrases that have not are looked for in these.  So frequent phrases, which nearly every row holds, meet few rows.
    """
    q = cut_lineage(queries.select("query_id", T.query_phrase("query").alias("phrase")).filter(F.col("phrase") != ""))
    rows = chunks if category is None else chunks.filter(F.col("category") == category)
    low = lambda c: T.ascii_lower(F.coalesce(F.col(c), F.lit("")))
    path = F.coalesce("heading_path", F.lit(""))
    order = Window.partitionBy("phrase").orderBy(path, "seq")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)

    def search(phrases: DataFrame, of: DataFrame) -> DataFrame:
        return first(phrase_matches(phrases, of, [low("content"), low("heading_path")]))

    early = _first_rows(rows, F.struct(path.alias("path"), F.col("seq").alias("seq")))
    if early is None:
        found = search(q, rows)
    else:
        begun = cut_lineage(search(q, rows.filter(early)).drop("rank"))
        full = begun.groupBy("phrase").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
        found = first(begun.unionByName(search(q.join(full, "phrase", "left_anti"), rows.filter(~early)).drop("rank")))
    return q.join(found, "phrase").select("query_id", "rank", *rows.columns)
