"""Review documents: rendering, parsing, merging of hand edits and of suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as T, vocab as V
from quillgraph.functions.text import let, strip
from quillgraph.operators.ordering import cut_lineage, position_in_group, release

CHUNK_HEADER = rf"^##[{V.WS_CLASS}]+Chunk[{V.WS_CLASS}]+([0-9]+)[{V.WS_CLASS}]*$"
META_LINE = rf"^-[{V.WS_CLASS}]+(\w+):[{V.WS_CLASS}]*(.*)$"
HEADER_LINE = rf"(?m)(?d)^[{V.WS_CLASS}&&[^\n]]*-[{V.WS_CLASS}&&[^\n]]+%s:[ \t]*(.*)$"
FENCE = r"^(`{3,4}|~{3,4})"


def extract_links(df: DataFrame, key: str, column: str) -> DataFrame:
    """Images and links of a text as rows (key, pos, kind, label, target)."""
    both = f"{V.IMAGE}|{V.LINK}"
    found = df.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(both), F.lit(0))).alias("pos", "tag"))
    image = F.col("tag").startswith("!")
    return found.select(
        key, "pos", F.when(image, "image").otherwise("link").alias("kind"),
        F.when(image, F.regexp_extract("tag", V.IMAGE, 1)).otherwise(F.regexp_extract("tag", V.LINK, 1)).alias("label"),
        F.when(image, F.regexp_extract("tag", V.IMAGE, 2)).otherwise(F.regexp_extract("tag", V.LINK, 2)).alias("target"))


# ---------------------------------------------------------------- rendering
def _fence_of(text: Column) -> Column:
    return F.when(text.contains("```"), F.lit("````")).otherwise(F.lit("```"))


def _opt(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), value))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def review_bodies(chunks: DataFrame, variant: str = "export") -> DataFrame:
    """(source_file, source_type, seq, _body): chunks as they stand in a review document, behind their heading with the number."""
    shown = F.coalesce("display_content", "content") if variant == "export" else F.col("content")
    shown = F.coalesce(shown, F.lit(""))
    embed = F.coalesce("embedding_text", "content") if "embedding_text" in chunks.columns else shown
    desc = F.col("description") if "description" in chunks.columns else F.lit("")
    notes = F.col("notes") if "notes" in chunks.columns else F.lit("")
    meta = [
        F.concat(F.lit("- chunk_id: "), F.coalesce("chunk_id", F.lit(""))),
        F.concat(F.lit("- anchor_id: "), F.coalesce("anchor_id", F.lit(""))),
        F.concat(F.lit("- page: "), F.coalesce("page", F.lit(0)).cast("string")),
        F.lit("- vector_dim: None"),
        F.concat(F.lit("- stored: "), F.coalesce("stored", F.lit(False)).cast("string")),
    ]
    if variant == "edit":
        meta.append(F.concat(F.lit("- is_manual: "), F.coalesce("is_manual", F.lit(False)).cast("string")))
    meta.append(F.concat(F.lit("- block_type: "), F.coalesce("block_type", F.lit("text"))))
    meta.append(_opt("heading_path", F.col("heading_path")))
    meta.append(_opt("semantic_description", desc) if variant == "export" else _opt("notes", notes))
    head = F.concat(F.lit("\n\n"), F.concat_ws("\n", *meta), F.lit("\n\n"))
    block = lambda t: F.concat(_fence_of(t), F.lit("text\n"), t, F.lit("\n"), _fence_of(t), F.lit("\n"))
    if variant == "export":
        body = F.concat(head, F.lit("### Display Content\n\n"), block(shown), F.when(
            (F.coalesce(embed, F.lit("")) != "") & (embed != shown),
            F.concat(F.lit("\n### Embedding Text\n\n"), block(embed))).otherwise(F.lit("")))
    else:
        body = F.concat(head, block(shown))
    return chunks.select("source_file", "source_type", "seq", body.alias("_body"))


def review_piece(number: Column, body: Column) -> Column:
    return F.concat(F.lit("## Chunk "), number.cast("string"), body)


def review_header(count: Column, exported_at: str) -> Column:
    label = F.when(F.lower("source_type") == "pdf", F.lit("PDF")).otherwise(F.initcap("source_type"))
    return F.concat(
        F.lit("# "), label, F.lit(" Chunk Export\n\n- Source file: "), F.col("source_file"),
        F.lit("\n- Source type: "), F.col("source_type"), F.lit("\n- Chunk count: "), count.cast("string"),
        F.lit(f"\n- Exported at: {exported_at}\n"))


def render_review_markdown(chunks: DataFrame, exported_at: str, variant: str = "export") -> DataFrame:
    """Review document as ordered pieces: piece 0 is the header, piece n is chunk n.

    Joined with newlines in order, the pieces of a source are its review document.  They are
    kept as rows so that a source of any size is never gathered in one cell.  ``variant`` is
    ``export`` (display and embedding text) or ``edit`` (one content block, notes, manual flag).
    """
    keys = ["source_file", "source_type"]
    # a piece travels as its text behind the number, and pieces are counted where they are numbered
    c = position_in_group(review_bodies(chunks, variant), keys, ["seq"], "_pos").withColumn("piece", F.col("_pos") + 1)
    pieces = c.select(*keys, "piece", review_piece(F.col("piece"), F.col("_body")).alias("markdown"))
    headers = c.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.lit(0).cast("bigint").alias("piece"), review_header(F.col("_n"), exported_at).alias("markdown"))
    return headers.unionByName(pieces)


# ---------------------------------------------------------------- parsing
def parse_review_text(files: DataFrame) -> DataFrame:
    """Review texts (file, text) to review rows; a file is one row, so the parse stays inside it."""
    def header(name: str) -> Column:
        return strip(F.regexp_extract("text", HEADER_LINE % name, 1))

    def split_chunks(lines: Column) -> Column:
        codes = F.array_join(F.transform(lines, lambda l: F.when(strip(l).rlike(CHUNK_HEADER), "H").otherwise("x")), "")
        runs = F.regexp_extract_all(codes, F.lit("Hx*+"), F.lit(0))
        lead = F.length(F.regexp_extract(codes, "^x*", 0))
        starts = F.aggregate(runs, F.struct(lead.alias("pos"), F.array().cast("array<struct<start:int,n:int>>").alias("out")),
                             lambda acc, r: F.struct(
                                 (acc["pos"] + F.length(r)).alias("pos"),
                                 F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), F.length(r).alias("n")))).alias("out")),
                             lambda acc: acc["out"])
        return F.transform(starts, lambda s: F.struct(
            F.regexp_extract(strip(F.get(lines, s["start"])), CHUNK_HEADER, 1).try_cast("bigint").alias("chunk_no"),
            F.slice(lines, s["start"] + 2, s["n"] - 1).alias("lines")))

    rows = files.select(
        "file", header("Source file").alias("source_file"), header("Source type").alias("source_type"),
        header("Exported at").alias("exported_at"),
        F.posexplode(let(T.split_lines("text"), split_chunks)).alias("ordinal", "b")).select(
        "file", "source_file", "source_type", "exported_at", "ordinal", "b.chunk_no", "b.lines")
    is_open = lambda l: strip(l).rlike(FENCE) & ~strip(l).rlike(META_LINE)
    fence_at = F.array_position(F.transform("lines", is_open), True).cast("int")       # 1-based, 0 when absent
    rows = rows.withColumn("_f", fence_at)
    meta_lines = F.when(F.col("_f") > 0, F.slice("lines", 1, F.col("_f") - 1)).otherwise(F.col("lines"))
    meta = F.filter(F.transform(meta_lines, strip), lambda l: l.rlike(META_LINE))
    key_of, val_of = lambda l: F.regexp_extract(l, META_LINE, 1), lambda l: strip(F.regexp_extract(l, META_LINE, 2))
    entries = F.transform(meta, lambda l: F.struct(key_of(l).alias("key"), val_of(l).alias("value")))
    rows = rows.withColumn("_m", entries)
    last = lambda name: let(F.filter("_m", lambda e: e["key"] == name), lambda es: F.get(es, F.size(es) - 1)["value"])
    marker = F.regexp_extract(strip(F.get("lines", F.col("_f") - 1)), FENCE, 1)
    after = F.slice("lines", F.col("_f") + 1, F.greatest(F.size("lines"), F.lit(1)))
    rows = rows.withColumn("_after", F.when(F.col("_f") > 0, after).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_marker", marker)
    close_at = F.array_position(F.transform("_after", lambda l: strip(l).startswith(F.col("_marker"))), True).cast("int")
    content = F.when(close_at > 0, F.slice("_after", 1, close_at - 1)).otherwise(F.col("_after"))
    flag = lambda name: F.when(last(name).isNotNull(), F.lower(last(name)).isin("true", "1", "yes"))
    return rows.select(
        "file", "source_file", F.when(F.col("source_type") != "", F.col("source_type")).otherwise("markdown").alias("source_type"),
        "exported_at", "ordinal", "chunk_no", F.coalesce(last("chunk_id"), F.lit("")).alias("chunk_id"),
        last("anchor_id").alias("anchor_id"), last("page").try_cast("int").alias("page"),
        last("vector_dim").try_cast("int").alias("vector_dim"), flag("stored").alias("stored"),
        flag("is_manual").alias("is_manual"), last("block_type").alias("block_type"),
        last("heading_path").alias("heading_path"), last("notes").alias("notes"),
        strip(F.array_join(content, "\n")).alias("content"))


def merge_review_edits(review: DataFrame, base: DataFrame) -> DataFrame:
    """Hand-edited rows over their base rows: by chunk_id, else by position in the file.

    ``base`` has (source_file, ordinal, chunk_id, …).  Human fields win; a changed, non-empty
    content makes the row manual and becomes its embedding text.
    """
    fields = ["chunk_id", "anchor_id", "source_type", "page", "heading_path", "block_type", "content",
              "embedding_text", "stored", "is_manual"]
    b = base.select("source_file", "ordinal", F.struct(*fields).alias("_base"))
    by_id = b.filter(F.col("_base.chunk_id") != "").groupBy(
        "source_file", F.col("_base.chunk_id").alias("chunk_id")).agg(F.max_by("_base", "ordinal").alias("_by_id"))
    by_pos = b.withColumnRenamed("_base", "_by_pos")
    joined = review.join(by_id, ["source_file", "chunk_id"], "left").join(by_pos, ["source_file", "ordinal"], "left")
    joined = joined.withColumn("_b", F.coalesce("_by_id", "_by_pos"))
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    changed = (F.col("content") != "") & (F.col("content") != F.coalesce("_b.content", F.lit("")))
    own_id = F.coalesce(given("chunk_id"), F.concat(F.lit("md-chunk-"), F.col("chunk_no").cast("string")))
    final_id = F.coalesce("_b.chunk_id", own_id)
    return joined.select(
        "source_file", "ordinal", final_id.alias("chunk_id"), F.coalesce("_b.anchor_id", final_id).alias("anchor_id"),
        F.coalesce("_b.source_type", "source_type").alias("source_type"), F.coalesce("_b.page", F.lit(0)).alias("page"),
        F.coalesce(given("heading_path"), F.col("_b.heading_path")).alias("heading_path"),
        F.coalesce(given("block_type"), F.col("_b.block_type")).alias("block_type"),
        F.col("content"), F.col("content").alias("display_content"),
        F.when(changed, F.col("content")).otherwise(F.coalesce("_b.embedding_text", "content")).alias("embedding_text"),
        F.coalesce("_b.stored", F.lit(False)).alias("stored"),
        (changed | F.coalesce("_b.is_manual", F.lit(False))).alias("is_manual"), given("notes").alias("notes"))


def roundtrip_check(review: DataFrame, again: DataFrame) -> DataFrame:
    """Differences between parsed rows and the rows parsed from their re-rendering; empty when safe."""
    a = review.select("source_file", "ordinal", strip("content").alias("a"), F.lit(True).alias("_a"))
    b = again.select("source_file", "ordinal", strip("content").alias("b"), F.lit(True).alias("_b"))
    return a.join(b, ["source_file", "ordinal"], "full").filter(
        F.col("_a").isNull() | F.col("_b").isNull() | (F.col("a") != F.col("b"))).drop("_a", "_b")


# ---------------------------------------------------------------- suggestions
def apply_suggestions(chunks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Apply the last suggestion per chunk: keep, update, delete or merge_with_next.

    A merged chunk appends the original content of its target, and the target is left out when
    it comes later.  A left-out chunk does not run its own merge, so whether a chunk is left
    out depends on earlier chunks; only merges take part in finding that out.
    """
    last = suggestions.filter(F.coalesce("chunk_id", F.lit("")) != "").groupBy("chunk_id").agg(F.max_by(
        F.struct("action", "optimized_content", "merge_target_id", "reason"), "pos").alias("_s"))
    rows = chunks.join(last, "chunk_id", "left").withColumn("_act", F.coalesce("_s.action", F.lit("keep")))
    target = F.coalesce("_s.merge_target_id", F.lit(""))
    merges = cut_lineage(rows.filter((F.col("_act") == "merge_with_next") & (target != "")).select(
        "source_file", "chunk_id", F.col("seq").alias("m_seq"), target.alias("target")))
    where = chunks.select("source_file", F.col("chunk_id").alias("target"), F.col("seq").alias("t_seq"), "content")
    # a merge that could leave its target out: the target exists and comes later
    reach = cut_lineage(merges.join(where.drop("content"), ["source_file", "target"]).filter("t_seq > m_seq"))
    skipped = _resolve_skips(reach)
    merged = rows.join(skipped.withColumnRenamed("target", "chunk_id"), ["source_file", "chunk_id"], "left_anti")
    texts = where.groupBy("source_file", "target").agg(F.min_by("content", "t_seq").alias("_target_text"))
    merged = merged.withColumn("target", target).join(texts, ["source_file", "target"], "left")
    new = strip(F.coalesce("_s.optimized_content", F.lit("")))
    does_update = (F.col("_act") == "update") & (new != "")
    does_merge = (F.col("_act") == "merge_with_next") & F.col("_target_text").isNotNull() & (F.col("target") != "")
    touched = does_update | does_merge
    return merged.filter(F.col("_act") != "delete").select(
        *[c for c in chunks.columns if c not in ("content", "is_manual", "optimization_reason")],
        F.when(does_update, new).when(does_merge, F.concat(strip("content"), F.lit("\n\n"), strip("_target_text")))
        .otherwise(F.col("content")).alias("content"),
        F.when(touched, F.lit(True)).otherwise(F.col("is_manual")).alias("is_manual"),
        F.when(touched, F.coalesce("_s.reason", F.lit(""))).alias("optimization_reason"))


def _resolve_skips(reach: DataFrame) -> DataFrame:
    """(source_file, target): targets that are left out, since some merge that itself runs reaches them.

    Merges point forward and a chunk has one target, so they form trees.  A chunk is left out if one of the chunks before it in
    the tree is not.  Where only one undecided chunk comes before, a chunk is left out exactly if that one is not, so whole chains collapse by
    pointer doubling with a parity: every chunk of a chain looks twice as far back in each step.  Each round decides all chains that
    start at decided chunks; what is left has half as many ends, so a forest of n merges takes about log n rounds of log n steps.
    """
    key = ["source_file", "node"]
    edges = cut_lineage(reach.select("source_file", F.col("chunk_id").alias("child"), F.col("target").alias("node")).distinct())
    nodes = edges.select("source_file", F.explode(F.array("child", "node")).alias("node")).distinct()
    # chunks that no merge reaches stay
    known = cut_lineage(nodes.join(edges.select(*key).distinct(), key, "left_anti").withColumn("skip", F.lit(False)))
    open_edges = edges
    while True:
        told = open_edges.join(known.select("source_file", F.col("node").alias("child"), "skip"), ["source_file", "child"], "left")
        state = cut_lineage(told.groupBy(*key).agg(
            F.bool_or(~F.col("skip")).alias("reached"), F.count_if(F.col("skip").isNull()).alias("left"),
            F.max(F.when(F.col("skip").isNull(), F.col("child"))).alias("back")))
        sure = state.filter("coalesce(reached, false) or left = 0").select(*key, F.coalesce("reached", F.lit(False)).alias("skip"))
        chain = cut_lineage(state.filter("not coalesce(reached, false) and left = 1").select(*key, "back", F.lit(True).alias("odd")))
        decided = cut_lineage(known.unionByName(sure))
        while True:
            far = chain.select("source_file", F.col("node").alias("back"), F.col("back").alias("_far"), F.col("odd").alias("_odd"))
            jumped = cut_lineage(chain.join(far, ["source_file", "back"], "left").select(
                *key, F.coalesce("_far", "back").alias("back"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                F.col("_far").isNotNull().alias("_moved")))
            release(chain)
            chain = jumped
            if chain.filter("_moved").isEmpty():
                break
        ends = chain.join(decided.select("source_file", F.col("node").alias("back"), "skip"), ["source_file", "back"]).select(
            *key, (F.col("skip") != F.col("odd")).alias("skip"))
        known = cut_lineage(decided.unionByName(ends))
        open_edges = cut_lineage(open_edges.join(known.select(*key), key, "left_anti"))
        release(state, chain, decided)
        if open_edges.isEmpty():
            return known.filter("skip").select("source_file", F.col("node").alias("target"))
