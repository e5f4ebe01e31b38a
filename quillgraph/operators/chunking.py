"""Documents to chunks.

``documents`` has (doc_id, source_file, source_type, text).  One document is one
file of the corpus.  All steps up to the final ``explode`` work inside the row, so
cutting a corpus needs no shuffle at all; a large document never meets others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions import markdown as M, text as T, vocab as V
from quillgraph.operators.ordering import position_in_group


@dataclass(frozen=True)
class ChunkParams:
    max_chars: int = V.MAX_CHARS
    overlap_chars: int = V.OVERLAP_CHARS
    keep_heading_path: bool = True
    min_section_chars: int = V.MIN_SECTION_CHARS
    micro_chunk_chars: int = V.MICRO_CHUNK_CHARS
    image_context_lines: int = V.IMAGE_CONTEXT_LINES
    keep_heading_on_merge: bool = False
    strict_max: bool = False


def _sections() -> Column:
    return T.built_once(("sections",), lambda: M.sections(F.col("text")))


def explode_lines(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.posexplode(T.split_lines("text")).alias("line_no", "line")
    ).withColumn("stripped", T.strip("line"))


def assign_sections(documents: DataFrame) -> DataFrame:
    """One row per non-blank section with its page and heading path."""
    carried = [c for c in documents.columns if c != "text"]
    return documents.select(*carried, F.posexplode(_sections()).alias("section_no", "s")).select(
        *carried, "section_no", "s.page", F.col("s.path").alias("heading_path"),
        F.col("s.first_line").alias("first_line"), F.col("s.text").alias("text"))


def section_lines(documents: DataFrame) -> DataFrame:
    """Body lines with the section, page and heading path they belong to."""
    return assign_sections(documents).select(
        "doc_id", "section_no", "page", "heading_path", "first_line",
        F.posexplode(F.split("text", "\n")).alias("line_index", "line"),
    ).withColumn("line_no", F.col("first_line") + F.col("line_index")).drop("first_line")


def normalize_headings(sections: DataFrame) -> DataFrame:
    return sections.withColumn("heading_path", F.transform("heading_path", M.normalize_heading))


def drop_toc_sections(sections: DataFrame) -> DataFrame:
    last = F.coalesce(F.get("heading_path", F.size("heading_path") - 1), F.lit(""))
    return sections.filter(~M.is_contents_title(last))


def segment_blocks(sections: DataFrame) -> DataFrame:
    """Typed blocks of every section, in order."""
    path = F.array_join("heading_path", M.PATH_SEP)
    title = F.coalesce(F.get("heading_path", F.size("heading_path") - 1), F.lit(""))
    return sections.withColumn("lines", F.split("text", "\n")).select(
        "doc_id", "section_no", "page", path.alias("heading_path"), title.alias("title"),
        F.posexplode(T.built_once(("blocks",), lambda: M.blocks(F.col("lines")))).alias("block_no", "b"), "lines",
    ).select("doc_id", "section_no", "block_no", "page", "heading_path", "title", "b.kind", "b.line_index",
             "b.text", "lines")


def classify_text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_type", F.when(F.col("kind").isin("table", "image"), F.col("kind")).when(
        F.col("kind") == "code", F.lit("code")).otherwise(M.text_block_type(F.col("text"), F.col("title"))))


def split_long_blocks(blocks: DataFrame, max_chars: int = V.MAX_CHARS,
                      overlap: int = V.OVERLAP_CHARS) -> DataFrame:
    carried = [c for c in blocks.columns if c not in ("text", "lines")]
    return blocks.select(*carried, F.posexplode(
        M.split_long(F.col("text"), max_chars, overlap)).alias("part_no", "text"))


def parse_tables(blocks: DataFrame) -> DataFrame:
    """One row per table row; row 0 is the header."""
    keys = ["doc_id", "section_no", "block_no"]
    return blocks.filter(F.col("kind") == "table").select(
        *keys, F.posexplode(M.table_rows(F.col("text"))).alias("row_no", "cells"))


def describe_tables(blocks: DataFrame) -> DataFrame:
    rows = blocks.filter(F.col("kind") == "table").withColumn("rows", M.table_rows(F.col("text")))
    return rows.select(
        "doc_id", "section_no", "block_no", "heading_path",
        M.table_description(F.col("rows"), F.col("heading_path")).alias("description"),
        F.when(M.is_parameter_table(F.col("rows")), F.lit("parameter_table"))
        .otherwise(F.lit("table")).alias("block_type"))


def describe_images(blocks: DataFrame, context_lines: int = V.IMAGE_CONTEXT_LINES) -> DataFrame:
    """One row per image with its neighbouring lines and description."""
    return blocks.filter(F.col("kind") == "image").select(
        "doc_id", "section_no", "block_no",
        F.posexplode(M.image_items(F.struct("text", "line_index"), F.col("lines"), F.col("page"),
                                   F.col("heading_path"), F.col("title"), context_lines))
        .alias("image_no", "i")).select("doc_id", "section_no", "block_no", "image_no", "i.*")


def describe_text(blocks: DataFrame) -> DataFrame:
    """Descriptions of term, tutorial and code blocks."""
    typed = blocks if "block_type" in blocks.columns else classify_text_blocks(blocks)
    t, title, path, text = (F.col(c) for c in ("block_type", "title", "heading_path", "text"))
    return typed.withColumn("description", F.when(t == "term", M.term_description(text, title, path))
                            .when(t == "tutorial", M.tutorial_description(text, title, path))
                            .when(t == "code", M.code_description(title, path)))


def build_embedding_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding_text", T.built_once(("embedding",), lambda: M.embedding_text(
        F.col("content"), F.col("heading_path"), F.col("block_type"), F.col("title"), F.col("description"))))


def document_items(documents: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Documents with an ``items`` array (before any merging) and their heading depth."""
    with_sections = documents.withColumn("_secs", _sections())
    items = T.built_once(("items", params), lambda: F.flatten(F.transform("_secs", lambda s: M.section_items(
        s, params.max_chars, params.overlap_chars, params.image_context_lines, params.keep_heading_path))))
    return with_sections.select(*documents.columns, M.max_depth(F.col("_secs")).alias("depth"),
                                items.alias("items"))


def document_depth(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", M.max_depth(_sections()).alias("depth"))


def collect_items(chunks: DataFrame) -> DataFrame:
    """Chunk rows of one document back into its ordered ``items`` array."""
    fields = ["page", "heading_path", "title", "block_type", "content", "description", "has_table",
              "has_image", "image_alt", "image_path", "context_before", "context_after"]
    packed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("seq", F.struct(*fields).cast(M.ITEM_T).alias("item")))).alias("_p"))
    return packed.select("doc_id", F.transform("_p", lambda p: p["item"]).alias("items"))


def merge_preamble(docs: DataFrame, min_chars: int = V.MIN_SECTION_CHARS, keep_heading=False) -> DataFrame:
    return docs.withColumn("items", T.built_once(("preamble", min_chars, keep_heading), lambda: M.merge_items(
        F.col("items"), lambda its: M.preamble_spans(its, min_chars), keep_heading)))


def merge_micro(docs: DataFrame, micro: int = V.MICRO_CHUNK_CHARS, max_chars: int = V.MAX_CHARS,
                keep_heading=False) -> DataFrame:
    return docs.withColumn("items", T.built_once(("micro", micro, max_chars, keep_heading), lambda: M.merge_items(
        F.col("items"), lambda its: M.micro_spans(its, micro, max_chars), keep_heading)))


def window_flat_documents(docs: DataFrame, max_chars: int = V.MAX_CHARS, overlap: int = V.OVERLAP_CHARS,
                          keep_heading=False, strict_max=False) -> DataFrame:
    """Windows for documents of heading depth 0 or 1; deeper ones stay as they are."""
    flat = T.built_once(("windows", max_chars, overlap, keep_heading, strict_max), lambda: M.merge_items(
        F.col("items"), lambda its: M.window_spans(its, max_chars, overlap, strict_max), keep_heading))
    return docs.withColumn("items", F.when(F.col("depth") <= 1, flat).otherwise(F.col("items")))


def whole_text_fallback(docs: DataFrame) -> DataFrame:
    """A document that gave no item but is not blank becomes one text item."""
    body = T.strip(F.coalesce(F.col("text"), F.lit("")))
    whole = F.array(M._item(F.lit(0), F.lit(""), F.lit(""), F.lit("text"), body, None))
    return docs.withColumn("items", F.when((F.size("items") == 0) & (body != ""), whole)
                           .otherwise(F.col("items")))


def explode_items(docs: DataFrame) -> DataFrame:
    carried = [c for c in docs.columns if c not in ("items", "text", "depth")]
    return docs.select(*carried, F.posexplode("items").alias("seq", "i")).select(*carried, "seq", "i.*")


def base_chunk_id(source_file, source_type, page, heading_path, content) -> Column:
    """``type:stem-hash:pPAGE:hash`` from the file name, page, path and content."""
    name = T.basename(F.coalesce(F.when(source_file != "", source_file), F.lit("document")))
    kind = F.coalesce(F.when(source_type != "", source_type), F.lit("document"))
    page_text = F.coalesce(page.cast("string"), F.lit("0"))
    sha = lambda x, n: F.substring(F.sha1(x.cast("binary")), 1, n)
    key = F.concat_ws("\n", T.strip(F.lower(kind)), name, page_text,
                      T.collapse_ws(F.coalesce(heading_path, F.lit(""))),
                      T.collapse_ws(F.coalesce(content, F.lit(""))))
    stem = F.coalesce(F.when(T.stem(name) != "", T.stem(name)), F.lit("document"))
    return F.concat(T.safe_label(kind), F.lit(":"), T.safe_label(stem), F.lit("-"), sha(name, 8), F.lit(":"),
                    T.safe_label(F.concat(F.lit("p"), page_text)), F.lit(":"), sha(key, 14))


def stable_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Add ``id``; repeats inside one source get -2, -3, … in ``seq`` order.

    Only rows whose base id really repeats take part in the ordering step.
    """
    based = chunks.withColumn("_base", base_chunk_id(
        *(F.col(c) for c in ("source_file", "source_type", "page", "heading_path", "content"))))
    keys = ["source_file", "_base"]
    repeated = based.groupBy(*keys).count().filter("count > 1").drop("count")
    unique = based.join(repeated, keys, "left_anti").withColumn("id", F.col("_base"))
    again = position_in_group(based.join(repeated, keys, "left_semi"), keys, ["doc_id", "seq"], "_k")
    numbered = again.withColumn("id", F.when(F.col("_k") == 0, F.col("_base")).otherwise(
        F.concat("_base", F.lit("-"), (F.col("_k") + 1).cast("string")))).drop("_k")
    return unique.unionByName(numbered).drop("_base")


def _ids_in_document(items: Column, source_file: Column, source_type: Column) -> Column:
    ids = F.transform(items, lambda it: base_chunk_id(
        source_file, source_type, it["page"], it["heading_path"], it["content"]))

    def number(base: Column) -> Column:
        nth = lambda x, i: F.size(F.filter(F.slice(base, 1, i + 1), lambda y: y == x))
        suffixed = F.transform(base, lambda x, i: T.let(nth(x, i), lambda k: F.when(k == 1, x).otherwise(
            F.concat(x, F.lit("-"), k.cast("string")))))
        return F.when(F.size(F.array_distinct(base)) == F.size(base), base).otherwise(suffixed)

    return T.let(ids, number)


def assign_category(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("category", T.chunk_category(
        T.basename(F.col("source_file")), F.col("heading_path"), F.col("content")))


def chunk_documents(documents: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Chunks with ids, categories and embedding text; a single shuffle-free stage."""
    docs = document_items(documents, params)
    docs = merge_preamble(docs, params.min_section_chars, params.keep_heading_on_merge)
    docs = merge_micro(docs, params.micro_chunk_chars, params.max_chars, params.keep_heading_on_merge)
    docs = window_flat_documents(docs, params.max_chars, params.overlap_chars,
                                 params.keep_heading_on_merge, params.strict_max)
    docs = whole_text_fallback(docs)
    docs = docs.withColumn("_ids", T.built_once(("ids",), lambda: _ids_in_document(
        F.col("items"), F.col("source_file"), F.col("source_type"))))
    docs = docs.withColumn("items", F.arrays_zip(F.col("_ids").alias("id"), F.col("items").alias("item")))
    carried = [c for c in documents.columns if c != "text"]
    rows = docs.select(*carried, F.posexplode("items").alias("seq", "z")).select(
        *carried, "seq", F.col("z.id").alias("id"), "z.item.*")
    rows = rows.withColumn("anchor_id", F.col("id")).withColumn("display_content", F.col("content"))
    return build_embedding_text(assign_category(rows))
