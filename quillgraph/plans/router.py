"""Model-routed retrieval.  Model outputs arrive as tables; the calls themselves are elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph.functions import text as T, vocab as V
from quillgraph.functions.text import strip
from quillgraph.operators import aggregates as A, scoring as S
from quillgraph.operators.matching import phrase_matches
from quillgraph.operators.ordering import cut_lineage, position_in_group
from quillgraph.plans.search import hits_by_headings


def _legal(category, default):
    return F.when(category.isin(V.CATEGORIES), category).otherwise(default)


def apply_route_decisions(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``queries`` (query_id, query, condensed) with the route read from ``decisions`` (query_id, raw).

    An unknown category becomes general; an answer without category or question is ignored.
    """
    parsed = decisions.select("query_id", T.first_json_object("raw", "category string, standalone_query string").alias("d"))
    joined = queries.join(parsed, "query_id", "left")
    cat, alone = strip(F.coalesce("d.category", F.lit(""))), strip(F.coalesce("d.standalone_query", F.lit("")))
    ok = (cat != "") & (alone != "")
    return joined.select(
        "query_id", "query", F.when(ok, _legal(cat, F.lit("general"))).otherwise(T.heuristic_category("condensed")).alias("category"),
        F.when(ok, alone).otherwise(F.col("condensed")).alias("standalone_query"),
        F.when(ok, "llm").otherwise("heuristic").alias("router_source"))


def prefilter_headings(queries: DataFrame, headings: DataFrame, keep: int = 30, default: int = 20) -> DataFrame:
    """Heading paths worth offering per question: those sharing words, else the first ones.

    A question's words are looked up in the heading list, which is one row per distinct path.
    """
    words = queries.select("query_id", F.explode(F.filter(
        T.split_ws(F.lower("query")), lambda t: F.length(t) > 1)).alias("word"))
    # repeated words of a question count each time
    weights = words.groupBy("query_id", "word").agg(F.count("*").alias("w"))
    paths = headings.select(F.col("heading_path").alias("id"), F.lower("heading_path").alias("_low"))
    found = phrase_matches(weights.select(F.col("word").alias("phrase")), paths, ["_low"]).select(F.col("phrase").alias("word"), "id")
    scored = weights.join(found, "word").groupBy("query_id", F.col("id").alias("heading_path")).agg(F.sum("w").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "heading_path")
    top = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)
    none = queries.select("query_id").join(top.select("query_id").distinct(), "query_id", "left_anti")
    first = [r["heading_path"] for r in headings.select("heading_path").orderBy("heading_path").limit(default).collect()]
    offered = none.select("query_id", F.posexplode(
        F.array(*[F.lit(p) for p in first]).cast("array<string>")).alias("position", "heading_path"))
    return top.select("query_id", "position", "heading_path").unionByName(
        offered.withColumn("position", F.col("position") + 1))


def numbered_headings(chunks: DataFrame) -> DataFrame:
    """Heading paths of each category with their 1-based number in path order."""
    paths = chunks.filter(F.coalesce("heading_path", F.lit("")) != "").select("category", "heading_path").distinct()
    return position_in_group(paths, ["category"], ["heading_path"], "position").withColumn(
        "position", (F.col("position") + 1).cast("int"))


def chosen_headings(routed: DataFrame, chunks: DataFrame, picks: DataFrame) -> DataFrame:
    """Paths behind the picked numbers: of the question's category, else of the prefiltered list.

    Numbers meet the list by an equi-join, so the list is never written out per question.
    """
    numbered = numbered_headings(chunks)
    with_list = routed.join(numbered.select("category").distinct(), "category", "left_semi")
    own = picks.join(with_list.select("query_id", "category"), "query_id").join(numbered, ["category", "position"])
    rest = routed.join(with_list.select("query_id"), "query_id", "left_anti")
    wide = prefilter_headings(rest.select("query_id", F.col("standalone_query").alias("query")), A.list_headings(chunks))
    cols = ["query_id", "sel_no", F.col("heading_path").alias("selected_path")]
    return own.select(*cols).unionByName(picks.join(wide, ["query_id", "position"]).select(*cols))


def locate(routed: DataFrame, chunks: DataFrame, decisions: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, outcome): chunks below the headings chosen in ``decisions`` (query_id, raw).

    Without a valid choice the question is answered by phrase search.
    """
    parsed = decisions.select("query_id", T.first_json_object(
        "raw", "selected_indices array<string>, indices array<string>").alias("d"))
    list_of = F.coalesce(F.when(F.size("d.selected_indices") > 0, F.col("d.selected_indices")), F.col("d.indices"))
    picks = parsed.select("query_id", F.posexplode(list_of).alias("sel_no", "v")).select(
        "query_id", "sel_no", F.col("v").try_cast("int").alias("position"))
    chosen = cut_lineage(chosen_headings(routed, chunks, picks))
    hits = hits_by_headings(chosen.join(routed.select("query_id", F.col("category").alias("_want")), "query_id"), chunks)
    hits = hits.filter(F.col("category") == F.col("_want")).drop("_want")
    rest = routed.join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    text = cut_lineage(S.search_text(chunks, rest.select("query_id", F.col("standalone_query").alias("query")), None, limit))
    common = ["query_id", "rank", "id", "heading_path", "content", "category"]
    found = hits.select(*common, F.lit("heading").alias("via")).unionByName(text.select(*common, F.lit("text").alias("via")))
    n_sel = chosen.groupBy("query_id").agg(F.count("*").alias("n"))
    n_hit = found.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    outcome = routed.select("query_id").join(n_sel, "query_id", "left").join(n_hit, "query_id", "left").select(
        "query_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") * 0.4)).when(F.col("n_chunks") > 0, 0.3).otherwise(0.0).alias("confidence"))
    return found, outcome


@dataclass(frozen=True)
class RouterState:
    """Where a routed search stands: the questions still open, what was located for them, and the results so far.

    ``found`` is set between locating and validating.  A step reads a state and returns the next one, so a step that is
    repeated with the same answers gives the same state again.
    """

    round: int
    open: DataFrame
    found: DataFrame | None = None
    hits: DataFrame | None = None
    outcome: DataFrame | None = None


def start_router(routed: DataFrame) -> RouterState:
    return RouterState(1, cut_lineage(routed.select("query_id", "category", "standalone_query")))


def locate_requests(state: RouterState, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, lists): what to ask about the open questions, and the numbered headings to choose from.

    A request (query_id, round, phase, category, standalone_query, list_id) names a list (list_id, position, heading_path).  Questions of a
    category with headings share its list; any other has the prefiltered headings as a list of its own.
    """
    numbered = numbered_headings(chunks)
    own = numbered.select("category").distinct().withColumn("_own", F.lit(True))
    asked = state.open.join(own, "category", "left").select(
        "query_id", F.lit(state.round).alias("round"), F.lit("locate").alias("phase"), "category", "standalone_query",
        F.when(F.col("_own"), F.concat(F.lit("category:"), "category")).otherwise(F.concat(F.lit("query:"), "query_id")).alias("list_id"))
    asked = cut_lineage(asked)
    shared = numbered.select(F.concat(F.lit("category:"), "category").alias("list_id"), "position", "heading_path").join(
        asked.select("list_id").distinct(), "list_id", "left_semi")
    alone = asked.filter(F.col("list_id").startswith("query:")).select("query_id", F.col("standalone_query").alias("query"))
    wide = prefilter_headings(alone, A.list_headings(chunks)).select(
        F.concat(F.lit("query:"), "query_id").alias("list_id"), "position", "heading_path")
    return asked, shared.unionByName(wide)


def locate_step(state: RouterState, chunks: DataFrame, answers: DataFrame, read: int | None = None) -> RouterState:
    """Apply the choices in ``answers`` (query_id, raw); a question without one is located by phrase search.

    If no later step reads ranks above ``read``, only these are written, and the last row of each question, which says that it has
    hits and where a supplement starts.
    """
    found = locate(state.open, chunks, answers)[0]
    if read is not None:
        last = cut_lineage(found.groupBy("query_id").agg(F.max("rank").alias("_last")))
        found = found.join(last, "query_id").filter((F.col("rank") <= read) | (F.col("rank") == F.col("_last"))).drop("_last")
    return replace(state, found=cut_lineage(found))


def validate_requests(state: RouterState, shown: int = 8, chars: int = 300) -> DataFrame:
    """(query_id, round, phase, standalone_query, rank, heading_path, content): the first hits of each question that has any."""
    return state.found.filter(F.col("rank") <= shown).join(state.open.select("query_id", "standalone_query"), "query_id").select(
        "query_id", F.lit(state.round).alias("round"), F.lit("validate").alias("phase"), "standalone_query", "rank",
        F.coalesce("heading_path", F.lit("")).alias("heading_path"),
        F.substring(F.coalesce("content", F.lit("")), 1, chars).alias("content"))


def validate_step(state: RouterState, chunks: DataFrame, answers: DataFrame, top_k: int = 5, max_rounds: int = 3) -> RouterState:
    """Apply the verdicts in ``answers`` (query_id, raw): settled questions move to the results, the others are widened to general.

    A verdict that cannot be read counts as valid.  A general question judged incomplete gets hits for what is missing and is settled.
    """
    found = state.found
    has = found.select("query_id").distinct().withColumn("_has", F.lit(True))
    verdict = answers.select("query_id", T.first_json_object("raw", "valid boolean, missing string").alias("v"))
    judged = cut_lineage(state.open.join(has, "query_id", "left").join(verdict, "query_id", "left").select(
        "query_id", "category", "standalone_query", F.coalesce("_has", F.lit(False)).alias("has"),
        F.coalesce("v.valid", F.lit(True)).alias("valid"), F.coalesce("v.missing", F.lit("")).alias("missing")))
    general, last = F.col("category") == "general", F.lit(state.round >= max_rounds)
    supplement = F.col("has") & ~F.col("valid") & general & ~last
    done = (F.col("has") & F.col("valid")) | (~F.col("has") & general) | supplement | last
    final = judged.filter(done)
    keep = found.join(final.select("query_id"), "query_id", "left_semi")
    extra_q = judged.filter(supplement).select("query_id", F.when(
        F.col("missing") != "", F.col("missing")).otherwise(F.col("standalone_query")).alias("query"))
    size = found.groupBy("query_id").agg(F.max("rank").alias("_last"))
    extra = S.search_text(chunks, extra_q, None, 10).join(size, "query_id").select(
        "query_id", (F.col("rank") + F.col("_last")).cast("int").alias("rank"), "id", "heading_path", "content",
        "category", F.lit("supplement").alias("via"))
    hits = cut_lineage(keep.unionByName(extra).filter(F.col("rank") <= top_k))
    outcome = final.select("query_id", F.when(~F.col("has") & last, F.lit("general")).otherwise(F.col("category")).alias("category"),
                           F.lit(state.round).alias("attempts"), (F.col("has") & F.col("valid")).alias("validated"))
    still = cut_lineage(judged.filter(~done).select("query_id", F.lit("general").alias("category"), "standalone_query"))
    return RouterState(state.round + 1, still, None, hits if state.hits is None else state.hits.unionByName(hits),
                       outcome if state.outcome is None else state.outcome.unionByName(outcome))


_STATE_TABLES = ("open", "found", "hits", "outcome")


def write_router_state(state: RouterState, path: str) -> None:
    """Write the tables of a state below ``path``, a new folder per step; its number of rounds is written last and marks it complete."""
    spark = state.open.sparkSession
    for name in _STATE_TABLES:
        if getattr(state, name) is not None:
            getattr(state, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(state.round).alias("round"), *[
        F.lit(getattr(state, name) is not None).alias(name) for name in _STATE_TABLES]).write.mode("overwrite").parquet(f"{path}/round")


def read_router_state(spark: SparkSession, path: str) -> RouterState:
    mark = spark.read.parquet(f"{path}/round").first()
    return RouterState(mark["round"], *[spark.read.parquet(f"{path}/{name}") if mark[name] else None for name in _STATE_TABLES])


def routed_search(routed: DataFrame, chunks: DataFrame, decisions: DataFrame, top_k: int = 5,
                  max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(hits, outcome) of all rounds where the answers are known beforehand.

    ``decisions`` has (query_id, round, phase, raw) with phases ``locate`` and ``validate``.  With a model in between, take the steps above
    one by one: requests out, answers in.
    """
    state = start_router(routed)
    while state.round <= max_rounds:
        at = lambda phase: decisions.filter((F.col("round") == state.round) & (F.col("phase") == phase)).select("query_id", "raw")
        state = locate_step(state, chunks, at("locate"), top_k)
        state = validate_step(state, chunks, at("validate"), top_k, max_rounds)
        if state.open.isEmpty():
            break
    return state.hits, state.outcome


def parse_tags(outputs: DataFrame, samples: DataFrame) -> DataFrame:
    """Category, at most five tags and a description per document from ``outputs`` (doc_id, raw)."""
    parsed = outputs.select("doc_id", T.first_json_object(
        "raw", "category string, tags array<string>, description string").alias("d"))
    cat = strip(F.coalesce("d.category", F.lit("")))
    tags = F.slice(F.filter(F.transform("d.tags", lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != ""), 1, 5)
    return samples.join(parsed, "doc_id", "left").select(
        "doc_id", _legal(cat, T.heuristic_category("sample")).alias("category"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        strip(F.coalesce("d.description", F.lit(""))).alias("description"))
