"""Markdown structure as column expressions.

A document is one text cell, so its parse never leaves the row: every step
maps an array column to an array column.  A whole corpus is therefore cut into
chunks by one narrow stage without any shuffle.

Line structure is found by giving each line a short code and letting a regular
expression cut the code string into runs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillgraph.functions import vocab as V
from quillgraph.functions.text import (
    let, normalize_heading, split_lines, strip, strip_legacy_prefix,
)

PATH_SEP = " > "

_PATH_T = "array<struct<level:int,title:string>>"
_RUN_T = "array<struct<page:bigint,path:array<string>,start:int,n:int>>"
_SPAN_T = "array<struct<start:int,n:int,merge:boolean>>"


def is_fence(s: Column) -> Column:
    return s.startswith("```") | s.startswith("~~~")


def is_page_marker(s: Column) -> Column:
    return (s.startswith("<!--") & s.rlike(V.PAGE_MARKER)) | s.rlike(V.PAGE_NUMBER)


def is_heading(s: Column) -> Column:
    return s.startswith("#") & s.rlike(V.HEADING)


def page_of(s: Column) -> Column:
    bare = s.cast("bigint")
    return F.when(s.startswith("<!--"), F.regexp_extract(s, V.PAGE_MARKER, 1).cast("bigint")).otherwise(
        F.when(bare == 0, F.lit(1).cast("bigint")).otherwise(bare))


def is_table_row(s: Column) -> Column:
    return ~s.startswith("![") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)


def has_image(line: Column) -> Column:
    return line.contains("![") & line.rlike(V.IMAGE)


def _section_code(line: Column) -> Column:
    return let(strip(line), lambda s: F.when(is_fence(s), F.lit("f"))
               .when(is_page_marker(s), F.lit("m"))
               .when(is_heading(s), F.length(F.regexp_extract(s, r"^#+", 0)).cast("string"))
               .otherwise(F.lit("o")))


def section_codes(lines: Column) -> Column:
    return F.array_join(F.transform(lines, _section_code), "")


def sections(text: Column) -> Column:
    """Non-blank sections: array of (page, path, first_line, text)."""
    def walk(lines: Column) -> Column:
        runs = F.regexp_extract_all(section_codes(lines), F.lit("(?:f[^f]*+f?+|o)++|[1-6m]"), F.lit(0))
        start = F.struct(
            F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("page"),
            F.array().cast(_PATH_T).alias("path"), F.array().cast(_RUN_T).alias("out"))

        def step(acc: Column, run: Column) -> Column:
            here = strip(F.get(lines, acc["pos"]))
            level = run.cast("int")
            opened = F.concat(
                F.filter(acc["path"], lambda h: h["level"] < level),
                F.array(F.struct(level.alias("level"),
                                 strip(F.regexp_extract(here, V.HEADING, 2)).alias("title"))))
            body = F.struct(
                acc["page"].alias("page"),
                F.transform(acc["path"], lambda h: h["title"]).alias("path"),
                acc["pos"].alias("start"), F.length(run).alias("n"))
            is_body = run.rlike("^[fo]")
            return F.struct(
                (acc["pos"] + F.length(run)).alias("pos"),
                F.when(run == "m", page_of(here)).otherwise(acc["page"]).alias("page"),
                F.when(is_body | (run == "m"), acc["path"]).otherwise(opened).alias("path"),
                F.when(is_body, F.concat(acc["out"], F.array(body))).otherwise(acc["out"]).alias("out"))

        runs_out = F.aggregate(runs, start, step, lambda acc: acc["out"])
        built = F.transform(runs_out, lambda r: let(
            F.slice(lines, r["start"] + 1, r["n"]),
            lambda ls: F.struct(
                r["page"].alias("page"), r["path"].alias("path"),
                (r["start"] + F.length(F.regexp_extract(
                    F.array_join(F.transform(ls, lambda x: F.when(x == "", "e").otherwise("x")), ""),
                    "^e*", 0))).alias("first_line"),
                F.btrim(F.array_join(ls, "\n"), F.lit("\n")).alias("text"))))
        return F.filter(built, lambda s: strip(s["text"]) != "")

    return let(split_lines(F.coalesce(text, F.lit(""))), walk)


def max_depth(secs: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(secs, lambda s: F.size(s["path"]))), F.lit(0))


def is_contents_title(title: Column) -> Column:
    return (title != "") & strip(title).rlike(V.CONTENTS_TITLE)


_BLOCK_RUNS = (
    "h...(?:.-..)*+(?:.e..)?+"
    "|t.......(?:..r.)*+"
    "|i..."
    "|c..`(?:...[^`])*+(?:...`)?+"
    "|c..~(?:...[^~])*+(?:...~)?+"
    "|(?:p...)++"
    "|(?:b...)++"
)


def _line_code(line: Column, following: Column) -> Column:
    def code(s: Column) -> Column:
        kind = (
            F.when(s == "", F.lit("b"))
            .when(F.lower(F.substring(s, 1, 6)) == "<table", F.lit("h"))
            .when(is_table_row(s) & F.coalesce(following, F.lit("")).rlike(V.TABLE_SEPARATOR), F.lit("t"))
            .when(has_image(line), F.lit("i"))
            .when(is_fence(s), F.lit("c"))
            .otherwise(F.lit("p")))
        return F.concat(
            kind,
            F.when(s.contains("<") & F.lower(s).contains("</table>"), F.lit("e")).otherwise(F.lit("-")),
            F.when(is_table_row(s), F.lit("r")).otherwise(F.lit("-")),
            F.when(s.startswith("```"), F.lit("`")).when(s.startswith("~~~"), F.lit("~")).otherwise(F.lit("-")))
    return let(strip(line), code)


_KINDS = {"h": "table", "t": "table", "i": "image", "c": "code", "p": "text"}


def blocks(lines: Column) -> Column:
    """Blocks of a section: array of (kind, line_index, text), blank runs left out."""
    codes = F.array_join(F.transform(lines, lambda l, i: _line_code(l, F.get(lines, i + 1))), "")
    runs = F.regexp_extract_all(codes, F.lit(_BLOCK_RUNS), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"),
                     F.array().cast("array<struct<code:string,start:int,n:int>>").alias("out"))

    def step(acc, run):
        n = (F.length(run) / 4).cast("int")
        return F.struct(
            (acc["pos"] + n).alias("pos"),
            F.when(run.startswith("b"), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                F.substring(run, 1, 1).alias("code"), acc["pos"].alias("start"), n.alias("n"))))).alias("out"))

    kind_of = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return F.transform(
        F.aggregate(runs, start, step, lambda acc: acc["out"]),
        lambda b: F.struct(
            F.element_at(kind_of, b["code"]).alias("kind"),
            b["start"].alias("line_index"),
            strip(F.array_join(F.slice(lines, b["start"] + 1, b["n"]), "\n")).alias("text")))


def text_block_type(text: Column, title: Column) -> Column:
    """code / tutorial / term / text for a non-table, non-image block."""
    def decide(lines: Column) -> Column:
        plain = F.array_join(lines, " ")
        listed = F.size(F.filter(lines, lambda l: l.rlike(V.LIST_LINE)))
        short = (F.length(plain) <= 220) & (F.size(lines) <= 3)
        titled = (title != "") | plain.contains("：") | plain.contains(":")
        return (F.when(F.size(lines) == 0, F.lit("text"))
                .when(is_fence(lines[0]), F.lit("code"))
                .when((listed >= 2) | text.rlike(V.STEP_MARKER), F.lit("tutorial"))
                .when(short & titled, F.lit("term"))
                .otherwise(F.lit("text")))

    stripped = F.filter(F.transform(F.split(text, "\n"), strip), lambda l: l != "")
    return let(stripped, decide)


def split_long(text: Column, max_chars: int = V.MAX_CHARS, overlap: int = V.OVERLAP_CHARS) -> Column:
    """Parts of at most ``max_chars`` characters that overlap by ``overlap``."""
    lower = int(max_chars * 0.6)
    if not 0 <= overlap < lower:
        raise ValueError("overlap must be smaller than 0.6 * max_chars")
    last_sep = "(?s)^(.*)[" + V.SPLIT_SEPARATORS + "]"

    def cut(body: Column) -> Column:
        size = F.length(body)
        start = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"),
                         F.array().cast("array<string>").alias("parts"))

        def step(acc, _):
            window = F.substring(body, acc["start"] + lower + 1, F.lit(max_chars - lower))
            boundary = F.when(window.rlike(f"[{V.SPLIT_SEPARATORS}]"),
                              acc["start"] + lower + F.length(F.regexp_extract(window, last_sep, 1)))
            last = acc["start"] + max_chars >= size
            end = F.when(last, size).otherwise(F.coalesce(boundary, acc["start"] + max_chars))
            return F.when(acc["done"], acc).otherwise(let(end, lambda e: let(
                strip(F.substring(body, acc["start"] + 1, e - acc["start"])),
                lambda part: F.struct(
                    F.greatest(acc["start"] + 1, e - overlap).alias("start"),
                    (e >= size).alias("done"),
                    F.when(part != "", F.concat(acc["parts"], F.array(part)))
                    .otherwise(acc["parts"]).alias("parts")))))

        rounds = F.sequence(F.lit(0), F.ceil(size / F.lit(lower - overlap)).cast("int"))
        return F.aggregate(rounds, start, step, lambda acc: acc["parts"])

    return let(strip(text), lambda body: F.when(body == "", F.array().cast("array<string>"))
               .when(F.length(body) <= max_chars, F.array(body)).otherwise(cut(body)))


def _row_cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|"), strip)


def table_rows(text: Column) -> Column:
    """Cells per row: Markdown rows, or HTML rows when there are none; header first."""
    def markdown(lines: Column) -> Column:
        usable = (F.size(lines) >= 2) & is_table_row(strip(lines[0])) & strip(F.get(lines, F.lit(1))).rlike(
            V.TABLE_SEPARATOR)
        # rows end at the first line that is no table row
        codes = F.array_join(F.transform(
            F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))),
            lambda l: F.when(is_table_row(strip(l)), "r").otherwise("-")), "")
        data = F.slice(lines, 3, F.length(F.regexp_extract(codes, "^r*", 0)))
        return F.when(F.coalesce(usable, F.lit(False)),
                      F.transform(F.concat(F.array(lines[0]), data), _row_cells))

    clean = lambda c: strip(F.regexp_replace(F.regexp_replace(c, V.HTML_TAG, " "), f"[{V.WS_CLASS}]+", " "))
    html = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(V.HTML_ROW), F.lit(1)), lambda row: F.transform(
            F.regexp_extract_all(row, F.lit(V.HTML_CELL), F.lit(1)), clean)),
        lambda cells: F.exists(cells, lambda c: c != ""))
    return F.coalesce(let(F.split(text, "\n"), markdown), html)


def table_description(rows: Column, path: Column) -> Column:
    """Location line, header line and up to 24 data lines."""
    label = F.when(path != "", path).otherwise(F.lit(V.UNNAMED_SECTION))
    headers = rows[0]
    named = F.filter(headers, lambda h: h != "")

    def data_line(cells: Column) -> Column:
        pairs = F.filter(F.transform(cells, lambda c, i: F.when(c != "", F.concat(
            F.coalesce(F.when(F.get(headers, i) != "", F.get(headers, i)),
                       F.concat(F.lit("列"), (i + 1).cast("string"))),
            F.lit("为"), c))), lambda p: p.isNotNull())
        return F.when(F.size(pairs) > 0, F.concat(F.array_join(pairs, "，"), F.lit("。")))

    lines = F.concat(
        F.array(F.concat(F.lit("该表格位于【"), label, F.lit("】。"))),
        F.when(F.size(named) > 0, F.array(F.concat(
            F.lit("表头包含："), F.array_join(named, "、"), F.lit("。")))).otherwise(
            F.array().cast("array<string>")),
        F.filter(F.transform(F.slice(rows, 2, 24), data_line), lambda l: l.isNotNull()))
    empty = F.array(F.concat(F.lit("该表格位于【"), label, F.lit("】。")))
    return strip(F.array_join(F.when(F.size(rows) > 0, lines).otherwise(empty), "\n"))


def is_parameter_table(rows: Column) -> Column:
    return (F.size(rows) > 0) & F.exists(rows[0], lambda h: h.rlike(V.PARAMETER_HINT))


def usable_context(line: Column) -> Column:
    """Line as image context, or null when it cannot serve as one."""
    return let(strip(line), lambda s: F.when(
        (s != "") & ~has_image(s) & (F.lower(F.substring(s, 1, 6)) != "<table")
        & ~is_table_row(s) & ~is_fence(s), s))


def image_context(lines: Column, line_index: Column, n: int):
    """(before, after): up to ``n`` usable lines on each side."""
    usable = lambda part: F.filter(F.transform(part, usable_context), lambda l: l.isNotNull())
    before = let(usable(F.slice(lines, 1, line_index)),
                 lambda u: F.slice(u, F.greatest(F.size(u) - n + 1, F.lit(1)), n))
    after = F.slice(usable(F.slice(lines, line_index + 2, F.greatest(F.size(lines), F.lit(1)))), 1, n)
    return before, after


def last_heading(path: Column) -> Column:
    return F.when(path != "", F.element_at(F.split(path, PATH_SEP), -1)).otherwise(F.lit(""))


def image_description(alt, src, before, after, path) -> Column:
    location = F.when(path != "", path).otherwise(F.lit(V.UNNAMED_SECTION))
    step = strip(last_heading(path))
    none = F.lit(None).cast("string")
    return strip(F.concat_ws(
        " ",
        F.concat(F.lit("图片位于【"), location, F.lit("】。")),
        F.when(alt != "", F.concat(F.lit("图片标题为“"), alt, F.lit("”。")))
        .when((step != "") & (step != location), F.concat(F.lit("该图片说明了操作步骤："), step, F.lit("。")))
        .otherwise(none),
        F.concat(F.lit("图片路径为 "), src, F.lit("。")),
        F.when(F.size(before) > 0, F.concat(F.lit("图片前文："), F.array_join(before, " "), F.lit("。"))),
        F.when(F.size(after) > 0, F.concat(F.lit("图片后文："), F.array_join(after, " "), F.lit("。")))))


def term_description(text, title, path) -> Column:
    label = F.when(title != "", title).when(path != "", last_heading(path)).otherwise(F.lit(V.DEFAULT_TERM))
    first = strip(F.split(text, "[。；;\n]", 2)[0])
    place = F.when(path != "", path).otherwise(label)
    return F.when(first == "", F.concat(F.lit("术语块，位于【"), place, F.lit("】。"))).otherwise(
        F.concat(F.lit("术语【"), label, F.lit("】的定义或说明："), first))


def tutorial_description(text, title, path) -> Column:
    label = F.when(title != "", title).when(path != "", last_heading(path)).otherwise(F.lit(V.DEFAULT_TUTORIAL))
    steps = F.regexp_count(text, F.lit(V.STEP_COUNT))
    lines = F.size(F.filter(F.split(text, "\n"), lambda l: strip(l) != ""))
    count = F.when(steps > 0, steps).otherwise(lines)
    return F.concat(F.lit("教程/操作步骤块，主题为【"), label, F.lit("】，共约 "),
                    count.cast("string"), F.lit(" 个步骤。"))


def code_description(title, path) -> Column:
    label = F.when(path != "", path).when(title != "", title).otherwise(F.lit(V.UNNAMED_SECTION))
    return F.concat(F.lit("代码或命令片段，位于【"), label, F.lit("】。"))


def embedding_text(display, path, block_type, title, description) -> Column:
    """Tags, description and display text as paragraphs; empty parts are left out."""
    none = F.lit(None).cast("string")
    norm_path = normalize_heading(path)
    root = strip(F.split(norm_path, PATH_SEP, 2)[0])
    norm_title = strip(normalize_heading(title))
    tags = F.concat_ws(
        " ",
        F.when(norm_path.contains(PATH_SEP) & (root != ""), F.concat(F.lit("[Path: "), root, F.lit("]"))),
        F.when(norm_path != "", F.concat(F.lit("[Path: "), norm_path, F.lit("]"))),
        F.concat(F.lit("[Type: "), block_type, F.lit("]")),
        F.when(norm_title != "", F.concat(F.lit("[Title: "), norm_title, F.lit("]"))))
    keep = lambda x: F.when(strip(x) != "", strip(x)).otherwise(none)
    return strip(F.concat_ws("\n\n", keep(tags), keep(F.coalesce(description, F.lit(""))), keep(display)))


ITEM_T = (
    "struct<page:bigint,heading_path:string,title:string,block_type:string,content:string,"
    "description:string,has_table:boolean,has_image:boolean,image_alt:string,image_path:string,"
    "context_before:array<string>,context_after:array<string>>"
)


def _item(page, path, title, block_type, content, description, table=False, image=False,
          alt=None, src=None, before=None, after=None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    lines = lambda x: F.lit(None).cast("array<string>") if x is None else x
    return F.struct(
        page.cast("bigint").alias("page"), path.alias("heading_path"), title.alias("title"),
        block_type.alias("block_type"), content.alias("content"), text(description).alias("description"),
        F.lit(table).alias("has_table"), F.lit(image).alias("has_image"),
        text(alt).alias("image_alt"), text(src).alias("image_path"),
        lines(before).alias("context_before"), lines(after).alias("context_after")).cast(ITEM_T)


def text_items(block, page, path, title, max_chars, overlap) -> Column:
    kind = F.when(block["kind"] == "code", F.lit("code")).otherwise(text_block_type(block["text"], title))

    def one(display: Column, t: Column) -> Column:
        description = (F.when(t == "term", term_description(display, title, path))
                       .when(t == "tutorial", tutorial_description(display, title, path))
                       .when(t == "code", code_description(title, path)))
        return _item(page, path, title, t, display, description)

    return let(kind, lambda t: F.transform(
        F.filter(F.transform(split_long(block["text"], max_chars, overlap), strip_legacy_prefix),
                 lambda d: d != ""),
        lambda d: one(d, t)))


def table_items(block, page, path, title) -> Column:
    return let(table_rows(block["text"]), lambda rows: F.array(_item(
        page, path, title,
        F.when(is_parameter_table(rows), F.lit("parameter_table")).otherwise(F.lit("table")),
        block["text"], table_description(rows, path), table=True)))


def image_items(block, lines, page, path, title, context_lines) -> Column:
    line = block["text"]
    pairs = F.arrays_zip(
        F.regexp_extract_all(line, F.lit(V.IMAGE), F.lit(0)).alias("tag"),
        F.regexp_extract_all(line, F.lit(V.IMAGE), F.lit(1)).alias("alt"),
        F.regexp_extract_all(line, F.lit(V.IMAGE), F.lit(2)).alias("src"))
    before, after = image_context(lines, block["line_index"], context_lines)

    def one(ctx: Column):
        def build(m: Column) -> Column:
            alt, src = strip(m["alt"]), strip(m["src"])
            display = strip(F.concat_ws(
                "\n\n",
                F.when(F.size(ctx["b"]) > 0, F.array_join(ctx["b"], "\n")), m["tag"],
                F.when(F.size(ctx["a"]) > 0, F.array_join(ctx["a"], "\n"))))
            return _item(page, path, title, F.lit("image"), display,
                         image_description(alt, src, ctx["b"], ctx["a"], path),
                         image=True, alt=alt, src=src, before=ctx["b"], after=ctx["a"])
        return F.transform(pairs, build)

    return let(F.struct(before.alias("b"), after.alias("a")), one)


def section_items(section: Column, max_chars: int, overlap: int, context_lines: int,
                  keep_path: bool = True) -> Column:
    """Chunk items of one section; none for a table of contents."""
    names = F.transform(section["path"], normalize_heading) if keep_path else F.array().cast("array<string>")

    def build(head: Column) -> Column:
        lines = F.split(section["text"], "\n")
        made = let(lines, lambda ls: F.flatten(F.transform(blocks(ls), lambda b: (
            F.when(b["kind"] == "table", table_items(b, section["page"], head["path"], head["title"]))
            .when(b["kind"] == "image", image_items(b, ls, section["page"], head["path"], head["title"],
                                                    context_lines))
            .otherwise(text_items(b, section["page"], head["path"], head["title"], max_chars, overlap))))))
        return F.when(is_contents_title(head["title"]), F.array().cast(f"array<{ITEM_T}>")).otherwise(made)

    return let(names, lambda ns: let(
        F.struct(F.array_join(ns, PATH_SEP).alias("path"),
                 F.coalesce(F.get(ns, F.size(ns) - 1), F.lit("")).alias("title")), build))


def _span(start, n, merge) -> Column:
    m = merge if isinstance(merge, Column) else F.lit(merge)
    return F.array(F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"), m.alias("merge")))


def preamble_spans(items: Column, min_chars: int) -> Column:
    """Runs of small items without a heading path are merged."""
    small = lambda it: (it["heading_path"] == "") & (F.length(strip(it["content"])) < min_chars * 2)
    codes = F.array_join(F.transform(items, lambda it: F.when(small(it), "s").otherwise("x")), "")
    runs = F.regexp_extract_all(codes, F.lit("s++|x"), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN_T).alias("out"))
    return F.aggregate(
        runs, start,
        lambda acc, r: F.struct(
            (acc["pos"] + F.length(r)).alias("pos"),
            F.concat(acc["out"], _span(acc["pos"], F.length(r), r.startswith("s"))).alias("out")),
        lambda acc: acc["out"])


def micro_spans(items: Column, micro: int, max_chars: int) -> Column:
    """Neighbouring tiny term/text items of one path and page, up to ``max_chars`` together."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("chars"),
                     F.array().cast(_SPAN_T).alias("out"))

    def step(acc, it):
        prev = F.get(items, acc["i"] - 1)
        size = F.length(it["content"])
        tiny = it["block_type"].isin(V.MERGEABLE_TYPES) & (F.length(strip(it["content"])) < micro)
        joins = (tiny & (acc["n"] > 0) & (prev["heading_path"] == it["heading_path"])
                 & (prev["page"] == it["page"]) & (acc["chars"] + size <= max_chars))
        flushed = F.when(acc["n"] > 0, F.concat(
            acc["out"], _span(acc["i"] - acc["n"], acc["n"], acc["n"] > 1))).otherwise(acc["out"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(joins, acc["n"] + 1).when(tiny, F.lit(1)).otherwise(F.lit(0)).alias("n"),
            F.when(joins, acc["chars"] + size).when(tiny, size).otherwise(F.lit(0)).alias("chars"),
            F.when(joins, acc["out"]).when(tiny, flushed)
            .otherwise(F.concat(flushed, _span(acc["i"], F.lit(1), False))).alias("out"))

    return F.aggregate(items, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(
        acc["out"], _span(acc["i"] - acc["n"], acc["n"], acc["n"] > 1))).otherwise(acc["out"]))


def window_spans(items: Column, max_chars: int, overlap: int, strict_max: bool = False) -> Column:
    """Overlapping windows over the text items of a document without heading levels."""
    ends = F.aggregate(
        items, F.array(F.lit(0)),
        lambda acc, it: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(it["content"]))))

    def fold(p: Column) -> Column:
        total = lambda a, b: F.get(p, b) - F.get(p, a)      # characters of items a .. b-1
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.array().cast(_SPAN_T).alias("out"))

        def step(acc, it):
            i, first = acc["i"], acc["first"]
            size = F.length(it["content"])
            held = i - first
            out = F.when(held > 0, F.concat(acc["out"], _span(first, held, held > 1))).otherwise(acc["out"])
            # item k stays when everything after it fits the overlap
            tail = F.element_at(F.filter(F.sequence(first, i - 1), lambda k: total(k + 1, i) <= overlap), 1)
            if strict_max:
                tail = F.when(total(tail, i) + size <= max_chars, tail).otherwise(i)
            full = (held > 0) & (total(first, i) + size > max_chars)
            hard = it["block_type"].isin(V.PASSTHROUGH_TYPES)
            return F.struct(
                (i + 1).alias("i"),
                F.when(hard, i + 1).when(full, tail).otherwise(first).alias("first"),
                F.when(hard, F.concat(out, _span(i, F.lit(1), False)))
                .when(full, out).otherwise(acc["out"]).alias("out"))

        return F.aggregate(items, start, step, lambda acc: F.when(
            acc["i"] > acc["first"],
            F.concat(acc["out"], _span(acc["first"], acc["i"] - acc["first"], acc["i"] - acc["first"] > 1)))
            .otherwise(acc["out"]))

    return let(ends, fold)


def apply_spans(items: Column, spans: Column, keep_heading: bool = False) -> Column:
    """Merge the items of each span; a merged item is plain text on the page of its first."""
    def merged(part: Column) -> Column:
        texts = F.filter(F.transform(part, lambda it: strip(it["content"])), lambda t: t != "")
        empty = F.lit("")
        path = part[0]["heading_path"] if keep_heading else empty
        title = part[0]["title"] if keep_heading else empty
        return _item(part[0]["page"], path, title, F.lit("text"), F.array_join(texts, "\n\n"), None)

    return F.transform(spans, lambda s: F.when(
        s["merge"], let(F.slice(items, s["start"] + 1, s["n"]), merged)).otherwise(F.get(items, s["start"])))


def merge_items(items: Column, spans_of, keep_heading: bool = False) -> Column:
    return let(items, lambda its: apply_spans(its, spans_of(its), keep_heading))
