"""Chunking queries over whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.catalog import adapters as X
from quillgraph.functions import markdown as M, text as T, vocab as V
from quillgraph.operators import chunking as C
from quillgraph.operators.ordering import scratch_path
from quillgraph.sources import files as FS

JOIN = lambda c: F.array_join(c, " > ")


def _md(s, d):
    return X.docs_md(s, d)


def _blocks(s, d):
    return C.segment_blocks(C.drop_toc_sections(C.normalize_headings(C.assign_sections(_md(s, d)))))


def _from_files(s, d):
    """Documents written as Markdown files, read back with the file reader, and chunked."""
    path = scratch_path(s, "markdown")
    FS.write_markdown(_md(s, d).withColumn("source_file", F.concat(F.lit("dir/doc"), F.col("doc_id").cast("string"), F.lit(".md"))), path)
    chunks = C.chunk_documents(FS.read_markdown(s, path))
    return chunks.select(F.regexp_extract("source_file", "doc([0-9]+)", 1).cast("bigint").alias("doc_id"), "seq", "page",
                         "heading_path", "block_type", "content", "category", "embedding_text")


QUERIES = {
    "chunk_lines": lambda s, d: C.explode_lines(_md(s, d)).select("doc_id", "line_no", "stripped"),
    "chunk_sections": lambda s, d: C.assign_sections(_md(s, d)).select(
        "doc_id", "section_no", "page", JOIN("heading_path").alias("heading_path"), "text"),
    "section_lines": lambda s, d: C.section_lines(_md(s, d)).select(
        "doc_id", "section_no", "line_no", "page", JOIN("heading_path").alias("heading_path"), "line"),
    "document_depth": lambda s, d: C.document_depth(_md(s, d)),
    "segment_blocks": lambda s, d: _blocks(s, d).select(
        "doc_id", "section_no", "block_no", "kind", "line_index", "text"),
    "classify_blocks": lambda s, d: C.classify_text_blocks(_blocks(s, d)).select(
        "doc_id", "section_no", "block_no", "block_type"),
    "split_long_blocks": lambda s, d: C.split_long_blocks(
        X.docs_flat(s, d).select("doc_id", "text")).select("doc_id", "part_no", "text"),
    "table_rows": lambda s, d: C.parse_tables(_blocks(s, d)).select(
        "doc_id", "section_no", "block_no", "row_no", F.array_join("cells", "¦").alias("cells")),
    "table_descriptions": lambda s, d: C.describe_tables(_blocks(s, d)).select(
        "doc_id", "section_no", "block_no", "block_type", "description"),
    "image_context": lambda s, d: C.describe_images(_blocks(s, d)).select(
        "doc_id", "section_no", "block_no", "image_no", "image_alt", "image_path", "content", "description"),
    "text_descriptions": lambda s, d: C.describe_text(_blocks(s, d)).filter(
        ~F.col("kind").isin("table", "image")).select("doc_id", "section_no", "block_no", "block_type", "description"),
    "chunk_documents_md": lambda s, d: C.chunk_documents(_md(s, d)).select(
        "doc_id", "seq", "id", "page", "heading_path", "block_type", "content", "description", "category",
        "embedding_text"),
    "markdown_files_chunks": lambda s, d: _from_files(s, d),
    "chunk_documents_flat": lambda s, d: C.chunk_documents(X.docs_flat(s, d)).select(
        "doc_id", "seq", "id", "page", "heading_path", "block_type", "content", "category", "embedding_text"),
    "flat_windows_strict": lambda s, d: C.explode_items(C.window_flat_documents(
        C.document_items(X.docs_flat(s, d)), strict_max=True)).select("doc_id", "seq", "block_type", "content"),
    "preamble_merge": lambda s, d: C.explode_items(C.merge_preamble(
        C.document_items(X.docs_flat(s, d)))).select("doc_id", "seq", "block_type", "content"),
    "micro_merge": lambda s, d: C.explode_items(C.merge_micro(
        C.document_items(_md(s, d)))).select("doc_id", "seq", "heading_path", "block_type", "content"),
    "stable_ids_per_source": lambda s, d: C.stable_chunk_ids(_line_chunks(s, d)).select("doc_id", "seq", "id"),
    "assign_category": lambda s, d: C.assign_category(_line_chunks(s, d)).select("doc_id", "seq", "category"),
}


def _line_chunks(s, d):
    """Document lines as chunks of one file per source, so that equal lines collide."""
    return X.chunks_t(s, d).select(
        "doc_id", "seq", F.col("payload_file").alias("source_file"), "source_type",
        F.lit(0).alias("page"), F.lit("").alias("heading_path"), "content")


# ---------------------------------------------------------------- SQL
W = X.SQL_WS
strip, collapse = X.sql_strip, X.sql_collapse

SECTIONS = X.DOCS_MD_SQL + rf""",
md_lines AS (
  SELECT doc_id, line, {strip('line')} AS s, line_no FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs_md)
  QUALIFY NOT (line = '' AND line_no = max(line_no) OVER (PARTITION BY doc_id))),
md_flags AS (
  SELECT *, CASE WHEN regexp_matches(s, '(?i)^<!--[{W}]*page:[{W}]*[0-9]+[{W}]*-->$')
                   THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT)
                 WHEN regexp_matches(s, '^[0-9]+$') THEN greatest(CAST(s AS BIGINT), 1) END AS pg,
         CASE WHEN regexp_matches(s, '^#{{1,6}}[{W}]+.') THEN length(regexp_extract(s, '^(#+)', 1)) END AS lvl,
         {strip(f"regexp_extract(s, '^(#{{1,6}})[{W}]+(.+?)[{W}]*#*$', 2)")} AS title FROM md_lines),
md_run AS (
  SELECT *, sum(CASE WHEN pg IS NOT NULL OR lvl IS NOT NULL THEN 1 ELSE 0 END) OVER w AS sec,
    coalesce(last_value(pg IGNORE NULLS) OVER w, 0) AS page,
    last_value(CASE WHEN lvl = 1 THEN line_no END IGNORE NULLS) OVER w AS l1,
    last_value(CASE WHEN lvl = 2 THEN line_no END IGNORE NULLS) OVER w AS l2,
    last_value(CASE WHEN lvl = 3 THEN line_no END IGNORE NULLS) OVER w AS l3,
    last_value(CASE WHEN lvl = 1 THEN title END IGNORE NULLS) OVER w AS t1,
    last_value(CASE WHEN lvl = 2 THEN title END IGNORE NULLS) OVER w AS t2,
    last_value(CASE WHEN lvl = 3 THEN title END IGNORE NULLS) OVER w AS t3
  FROM md_flags WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
md_sec AS (
  SELECT doc_id, sec, any_value(page) AS page,
    any_value(concat_ws(' > ', t1, CASE WHEN l2 > coalesce(l1, -1) THEN t2 END,
                               CASE WHEN l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) THEN t3 END)) AS heading_path,
    min(line_no) AS first_line,
    string_agg(line, chr(10) ORDER BY line_no) AS body
  FROM md_run WHERE pg IS NULL AND lvl IS NULL GROUP BY doc_id, sec),
sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, page, heading_path,
    first_line + length(body) - length(ltrim(body, chr(10))) AS first_line, trim(body, chr(10)) AS text
  FROM md_sec WHERE {strip('body')} <> '')
"""

BLOCKS = SECTIONS + rf""",
sl AS (
  SELECT doc_id, section_no, page, heading_path, line, {strip('line')} AS s, li FROM (
    SELECT *, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS li FROM sections)),
sl2 AS (
  SELECT *, s = '' AS blank,
    NOT starts_with(s, '![') AND length(s) - length(replace(s, '|', '')) >= 2 AS is_row,
    regexp_matches(line, '!\[[^\]]*\]\([^){W}]+([{W}]+"[^"]*")?\)') AS img,
    coalesce(regexp_matches(lead(s) OVER w, '^[{W}]*\|?([{W}]*:?-{{3,}}:?[{W}]*\|)+[{W}]*([{W}]*:?-{{3,}}:?[{W}]*)?\|?[{W}]*$'), false) AS sep_next
  FROM sl WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY li)),
sl3 AS (
  SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, section_no ORDER BY li) AS rr FROM sl2),
sl4 AS (
  SELECT *, CASE WHEN blank THEN 'blank'
      WHEN is_row AND coalesce(max(CASE WHEN is_row AND sep_next THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, section_no, rr, is_row ORDER BY li), 0) = 1 THEN 'table'
      WHEN img THEN 'image' ELSE 'text' END AS kind FROM sl3),
sl5 AS (
  SELECT *, CASE WHEN kind = 'image' OR kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS st
  FROM sl4 WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY li)),
sl6 AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, section_no ORDER BY li) AS b FROM sl5),
blk0 AS (
  SELECT doc_id, section_no, any_value(page) AS page, any_value(heading_path) AS heading_path, b,
    any_value(kind) AS kind, min(li) AS line_index, {strip("string_agg(line, chr(10) ORDER BY li)")} AS text
  FROM sl6 WHERE kind <> 'blank' GROUP BY doc_id, section_no, b),
blk AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY b) - 1 AS block_no,
    coalesce(string_split(heading_path, ' > ')[-1], '') AS title FROM blk0)
"""

STEP = rf"(?i)第[{W}]*[0-9]+[{W}]*步|步骤[{W}]*[0-9]+|step[{W}]*[0-9]+"
LIST = (rf"(?i)^[{W}]*([-*+][{W}]+|[0-9]+[.)][{W}]+|第[{W}]*[0-9]+[{W}]*步[:：]?[{W}]+"
        rf"|步骤[{W}]*[0-9]+[:：]?[{W}]+|step[{W}]*[0-9]+[:：]?[{W}]+)")


def _type_sql(lines: str, text: str, title: str) -> str:
    return (f"CASE WHEN len(list_filter({lines}, lambda l: regexp_matches(l, '{LIST}'))) >= 2 "
            f"OR regexp_matches({text}, '{STEP}') THEN 'tutorial' "
            f"WHEN length(array_to_string({lines}, ' ')) <= 220 AND len({lines}) <= 3 AND ({title} <> '' "
            f"OR contains(array_to_string({lines}, ' '), '：') OR contains(array_to_string({lines}, ' '), ':')) "
            f"THEN 'term' ELSE 'text' END")


_LINES = (f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')")
TYPED = BLOCKS + rf""",
typed AS (
  SELECT *, CASE WHEN kind IN ('table', 'image') THEN kind ELSE {_type_sql(_LINES, 'text', 'title')} END AS block_type
  FROM blk)
"""


def _parts_sql(src: str, keys: str, name: str) -> str:
    """Recursive split of ``src(keys, text)`` into ``name(keys, part_no, part)``."""
    low = int(V.MAX_CHARS * 0.6)
    seps = "[\\n。；，.;, ]"
    win = f"substr(body, start + {low} + 1, {V.MAX_CHARS - low})"
    return rf"""
{name}_r AS (
  SELECT {keys}, {strip('text')} AS body, 0 AS start, 0 AS step,
    CASE WHEN length({strip('text')}) <= {V.MAX_CHARS} THEN length({strip('text')})
         WHEN regexp_matches(substr({strip('text')}, {low + 1}, {V.MAX_CHARS - low}), '{seps}')
           THEN {low} + length(regexp_extract(substr({strip('text')}, {low + 1}, {V.MAX_CHARS - low}), '(?s)^(.*){seps}', 1))
         ELSE {V.MAX_CHARS} END AS stop
  FROM {src}
  UNION ALL
  SELECT {keys}, body, start, step,
    CASE WHEN start + {V.MAX_CHARS} >= length(body) THEN length(body)
         WHEN regexp_matches({win}, '{seps}') THEN start + {low} + length(regexp_extract({win}, '(?s)^(.*){seps}', 1))
         ELSE start + {V.MAX_CHARS} END AS stop
  FROM (SELECT {keys}, body, greatest(start + 1, stop - {V.OVERLAP_CHARS}) AS start, step + 1 AS step
        FROM {name}_r WHERE stop < length(body))),
{name} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY step) - 1 AS part_no,
    {strip('substr(body, start + 1, stop - start)')} AS part
  FROM {name}_r WHERE {strip('substr(body, start + 1, stop - start)')} <> '')
"""


_CELLS = f"list_transform(string_split(trim(s, '|'), '|'), lambda c: {strip('c')})"
TROWS = TYPED + rf""",
trow AS (
  SELECT l.doc_id, l.section_no, k.block_no, k.heading_path,
    row_number() OVER (PARTITION BY l.doc_id, l.section_no, k.block_no ORDER BY li) - 1 AS row_no, {_CELLS} AS cells
  FROM sl6 l JOIN blk k ON l.doc_id = k.doc_id AND l.section_no = k.section_no AND l.b = k.b
  WHERE k.kind = 'table' AND li <> k.line_index + 1)
"""
HINT = V.PARAMETER_HINT.replace("(?i)", "(?i)(") + ")"
_PAIR = ("list_filter(list_transform(range(1, len(r.cells) + 1), lambda i: CASE WHEN r.cells[i] = '' THEN NULL ELSE "
         "coalesce(nullif(h.cells[i], ''), '列' || i) || '为' || r.cells[i] END), lambda p: p IS NOT NULL)")
TDESC = TROWS + rf""",
tdata AS (
  SELECT r.doc_id, r.section_no, r.block_no, string_agg(array_to_string({_PAIR}, '，') || '。', chr(10) ORDER BY r.row_no)
    FILTER (len({_PAIR}) > 0) AS body
  FROM trow r JOIN trow h ON r.doc_id = h.doc_id AND r.section_no = h.section_no AND r.block_no = h.block_no AND h.row_no = 0
  WHERE r.row_no BETWEEN 1 AND 24 GROUP BY ALL),
tdesc AS (
  SELECT h.doc_id, h.section_no, h.block_no,
    CASE WHEN len(list_filter(h.cells, lambda c: regexp_matches(c, '{HINT}'))) > 0 THEN 'parameter_table' ELSE 'table' END AS block_type,
    concat_ws(chr(10), '该表格位于【' || h.heading_path || '】。',
      '表头包含：' || nullif(array_to_string(list_filter(h.cells, lambda c: c <> ''), '、'), '') || '。', d.body) AS description
  FROM trow h LEFT JOIN tdata d USING (doc_id, section_no, block_no) WHERE h.row_no = 0)
"""
IMAGES = TDESC + rf""",
usable AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY li) AS u FROM sl6
  WHERE NOT blank AND NOT img AND NOT is_row),
img AS (
  SELECT k.*, regexp_extract(text, '!\[([^\]]*)\]\(([^){W}]+)', 1) AS alt,
    regexp_extract(text, '!\[([^\]]*)\]\(([^){W}]+)', 2) AS src,
    (SELECT list(s ORDER BY li) FROM (SELECT s, li FROM usable x WHERE x.doc_id = k.doc_id AND x.section_no = k.section_no
       AND x.li < k.line_index ORDER BY li DESC LIMIT 2)) AS bef,
    (SELECT list(s ORDER BY li) FROM (SELECT s, li FROM usable x WHERE x.doc_id = k.doc_id AND x.section_no = k.section_no
       AND x.li > k.line_index ORDER BY li LIMIT 2)) AS aft
  FROM blk k WHERE kind = 'image'),
imgs AS (
  SELECT doc_id, section_no, block_no, 0 AS image_no, alt AS image_alt, src AS image_path,
    concat_ws(chr(10) || chr(10), array_to_string(bef, chr(10)), text, array_to_string(aft, chr(10))) AS content,
    concat_ws(' ', '图片位于【' || heading_path || '】。', '图片标题为“' || alt || '”。', '图片路径为 ' || src || '。',
      '图片前文：' || array_to_string(bef, ' ') || '。', '图片后文：' || array_to_string(aft, ' ') || '。') AS description
  FROM img)
"""


def _text_desc(text: str, title: str, path: str, t: str) -> str:
    count = rf"len(regexp_extract_all({text}, '(?im)^[{W}]*[0-9]+[.)][{W}]+|第[{W}]*[0-9]+[{W}]*步|步骤[{W}]*[0-9]+|step[{W}]*[0-9]+'))"
    lines = f"len(list_filter(string_split({text}, chr(10)), lambda l: {strip('l')} <> ''))"
    first = strip(rf"regexp_split_to_array({text}, '[。；;\n]')[1]")
    return (f"CASE {t} WHEN 'term' THEN CASE WHEN {first} = '' THEN '术语块，位于【' || {path} || '】。' ELSE "
            f"'术语【' || {title} || '】的定义或说明：' || {first} END "
            f"WHEN 'tutorial' THEN '教程/操作步骤块，主题为【' || {title} || '】，共约 ' || "
            f"CASE WHEN {count} > 0 THEN {count} ELSE {lines} END || ' 个步骤。' END")


def _id_sql(source_file: str, source_type: str, page: str, path: str, content: str) -> str:
    name = f"regexp_extract({source_file}, '([^/]*)$', 1)"
    stem = f"regexp_replace({name}, '\\.[^.]+$', '')"
    key = (f"{source_type} || chr(10) || {name} || chr(10) || {page} || chr(10) || {collapse(path)} || chr(10) || "
           f"{collapse(content)}")
    return (f"{source_type} || ':' || lower({stem}) || '-' || substr(sha1({name}), 1, 8) || ':p' || {page} || ':' || "
            f"substr(sha1({key}), 1, 14)")


def _embed_sql(content, path, t, title, description) -> str:
    tags = (f"concat_ws(' ', CASE WHEN contains({path}, ' > ') THEN '[Path: ' || string_split({path}, ' > ')[1] || ']' END, "
            f"CASE WHEN {path} <> '' THEN '[Path: ' || {path} || ']' END, '[Type: ' || {t} || ']', "
            f"CASE WHEN {title} <> '' THEN '[Title: ' || {title} || ']' END)")
    return f"concat_ws(chr(10) || chr(10), {tags}, nullif({description}, ''), {content})"


# items of docs_md before merging
MD_ITEMS = IMAGES + ",\n" + _parts_sql("(SELECT * FROM typed WHERE kind = 'text')",
                                      "doc_id, section_no, block_no, page, heading_path, title, block_type", "parts") + rf""",
items0 AS (
  SELECT doc_id, section_no, block_no, part_no AS sub, page, heading_path, title, block_type, part AS content,
    {_text_desc('part', 'title', 'heading_path', 'block_type')} AS description FROM parts
  UNION ALL SELECT k.doc_id, k.section_no, k.block_no, 0, page, heading_path, title, d.block_type, text, d.description
    FROM blk k JOIN tdesc d USING (doc_id, section_no, block_no)
  UNION ALL SELECT k.doc_id, k.section_no, k.block_no, 0, page, heading_path, title, 'image', i.content, i.description
    FROM blk k JOIN imgs i USING (doc_id, section_no, block_no)),
items AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, block_no, sub) AS i,
    block_type IN ('term', 'text') AND length(content) < {V.MICRO_CHUNK_CHARS} AS tiny FROM items0)
"""
# greedy merging of tiny items: g counts the groups
MICRO = rf"""
micro_r AS (
  SELECT doc_id, i, tiny, heading_path, page, length(content) AS chars, 1 AS g FROM items WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, n.tiny, n.heading_path, n.page,
    CASE WHEN j THEN r.chars + length(n.content) ELSE length(n.content) END, CASE WHEN j THEN g ELSE g + 1 END
  FROM (SELECT r.*, n.doc_id IS NOT NULL AND r.tiny AND n.tiny AND r.heading_path = n.heading_path AND r.page = n.page
          AND r.chars + length(n.content) <= {V.MAX_CHARS} AS j, n.i AS ni
        FROM micro_r r JOIN items n ON n.doc_id = r.doc_id AND n.i = r.i + 1) r
  JOIN items n ON n.doc_id = r.doc_id AND n.i = r.ni),
micro AS (
  SELECT m.doc_id, g - 1 AS seq, CASE WHEN count(*) > 1 THEN '' ELSE any_value(n.heading_path) END AS heading_path,
    CASE WHEN count(*) > 1 THEN '' ELSE any_value(n.title) END AS title, arg_min(n.page, m.i) AS page,
    CASE WHEN count(*) > 1 THEN 'text' ELSE any_value(n.block_type) END AS block_type,
    string_agg(n.content, chr(10) || chr(10) ORDER BY m.i) AS content,
    CASE WHEN count(*) > 1 THEN NULL ELSE any_value(n.description) END AS description
  FROM micro_r m JOIN items n ON n.doc_id = m.doc_id AND n.i = m.i GROUP BY m.doc_id, g)
"""


def _numbered(src: str) -> str:
    base = _id_sql("source_file", "source_type", "page", "heading_path", "content")
    cat = X.sql_category("regexp_extract(source_file, '([^/]*)$', 1) || ' ' || heading_path || ' ' || substr(content, 1, 300)")
    return rf"""
final AS (
  SELECT c.*, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY seq) AS k FROM (
      SELECT c.*, {base} AS base, {cat} AS category,
        {_embed_sql('content', 'heading_path', 'block_type', 'title', 'description')} AS embedding_text
      FROM {src} c)) c)
"""


# flat documents: blank-separated paragraphs, parts, preamble runs, tiny runs, windows
FLAT_ITEMS = X.DOCS_FLAT_SQL + rf""",
fl AS (
  SELECT doc_id, line, {strip('line')} = '' AS blank, li FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS li FROM docs_flat)),
fp AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY li) AS p FROM fl),
para AS (
  SELECT doc_id, p, {strip("string_agg(line, chr(10) ORDER BY li)")} AS text FROM fp WHERE NOT blank GROUP BY doc_id, p),
ptyped AS (SELECT *, {_type_sql(_LINES, 'text', "''")} AS block_type FROM para),
""" + _parts_sql("ptyped", "doc_id, p, block_type", "fparts") + rf""",
fitems AS (
  SELECT doc_id, block_type, part AS content, row_number() OVER (PARTITION BY doc_id ORDER BY p, part_no) AS i FROM fparts)
"""
PREAMBLE = FLAT_ITEMS + rf""",
pre1 AS (
  SELECT *, length(content) < {2 * V.MIN_SECTION_CHARS} AS small,
    sum(CASE WHEN length(content) < {2 * V.MIN_SECTION_CHARS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM fitems),
pre AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS seq,
    CASE WHEN small THEN 'text' ELSE any_value(block_type) END AS block_type,
    string_agg(content, chr(10) || chr(10) ORDER BY i) AS content
  FROM pre1 GROUP BY doc_id, small, r)
"""
_FLAT_MICRO = MICRO.replace("n.heading_path", "''").replace("r.heading_path = ''", "true").replace(
    "heading_path, page,", "'' AS heading_path, page,").replace("any_value(n.title)", "''").replace(
    "any_value(n.description)", "NULL")


def _windows(src: str, strict: bool) -> str:
    """Window fold over ``src(doc_id, seq, block_type, content)``."""
    tail = (f"coalesce(list_filter(range(first, i), lambda k: p[i + 1] - p[k + 2] <= {V.OVERLAP_CHARS})[1], i)")
    if strict:
        tail = f"CASE WHEN p[i + 1] - p[{tail} + 1] + size <= {V.MAX_CHARS} THEN {tail} ELSE i END"
    return rf"""
wsrc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, length(content) AS size FROM {src}),
wdoc AS (
  SELECT doc_id, list(size ORDER BY i) AS sizes, list(content ORDER BY i) AS texts, list(block_type ORDER BY i) AS types,
    count(*) AS n FROM wsrc GROUP BY doc_id),
wpre AS (
  SELECT *, list_transform(range(0, n + 1), lambda j: coalesce(list_sum(sizes[1:j]), 0)) AS p FROM wdoc),
wr AS (
  SELECT doc_id, p, sizes, texts, types, n, 0 AS i, 0 AS first, -1 AS emit_from, -1 AS emit_to FROM wpre
  UNION ALL
  SELECT doc_id, p, sizes, texts, types, n, i + 1,
    CASE WHEN i > first AND p[i + 1] - p[first + 1] + size > {V.MAX_CHARS} THEN {tail} ELSE first END,
    CASE WHEN i > first AND p[i + 1] - p[first + 1] + size > {V.MAX_CHARS} THEN first ELSE -1 END,
    CASE WHEN i > first AND p[i + 1] - p[first + 1] + size > {V.MAX_CHARS} THEN i ELSE -1 END
  FROM (SELECT *, sizes[i + 1] AS size FROM wr WHERE i < n)),
wspan AS (
  SELECT doc_id, texts, types, emit_from AS a, emit_to AS b FROM wr WHERE emit_from >= 0
  UNION ALL SELECT doc_id, texts, types, first, n FROM wr WHERE i = n AND n > first),
flatw AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, a) - 1 AS seq, 0 AS page, '' AS heading_path, '' AS title,
    CASE WHEN b - a > 1 THEN 'text' ELSE types[a + 1] END AS block_type,
    array_to_string(texts[a + 1:b], chr(10) || chr(10)) AS content,
    CASE WHEN b - a = 1 AND types[a + 1] <> 'text' THEN {_text_desc('texts[a + 1]', "CASE types[a + 1] WHEN 'term' THEN '术语' ELSE '操作步骤' END", "'术语'", 'types[a + 1]')} END AS description
  FROM wspan)
"""


ORACLE = {
    "chunk_lines": "WITH " + SECTIONS + "SELECT doc_id, line_no, s AS stripped FROM md_lines",
    "chunk_sections": "WITH " + SECTIONS + "SELECT doc_id, section_no, page, heading_path, text FROM sections",
    "section_lines": "WITH " + BLOCKS + """SELECT sl.doc_id, sl.section_no, first_line + li AS line_no, sl.page,
        sl.heading_path, line FROM sl JOIN sections s ON s.doc_id = sl.doc_id AND s.section_no = sl.section_no""",
    "document_depth": "WITH " + SECTIONS + """SELECT d.doc_id, coalesce(max(CASE WHEN heading_path <> ''
        THEN len(string_split(heading_path, ' > ')) END), 0) AS depth FROM docs_md d LEFT JOIN sections s
        ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "segment_blocks": "WITH " + BLOCKS + "SELECT doc_id, section_no, block_no, kind, line_index, text FROM blk",
    "classify_blocks": "WITH " + TYPED + "SELECT doc_id, section_no, block_no, block_type FROM typed",
    "split_long_blocks": "WITH RECURSIVE " + X.DOCS_FLAT_SQL + "," + _parts_sql("docs_flat", "doc_id", "parts")
        + "SELECT doc_id, part_no, part AS text FROM parts",
    "table_rows": "WITH " + TROWS + "SELECT doc_id, section_no, block_no, row_no, array_to_string(cells, '¦') AS cells FROM trow",
    "table_descriptions": "WITH " + TDESC + "SELECT doc_id, section_no, block_no, block_type, description FROM tdesc",
    "image_context": "WITH " + IMAGES + "SELECT * FROM imgs",
    "text_descriptions": "WITH " + TYPED + f"""SELECT doc_id, section_no, block_no, block_type,
        {_text_desc('text', 'title', 'heading_path', 'block_type')} AS description FROM typed
        WHERE kind NOT IN ('table', 'image')""",
    "chunk_documents_md": "WITH RECURSIVE " + MD_ITEMS + "," + MICRO + """,
        src AS (SELECT m.*, d.source_file, d.source_type FROM micro m JOIN docs_md d USING (doc_id)),"""
        + _numbered("src") + """SELECT doc_id, seq, id, page, heading_path, block_type, content, description, category,
        embedding_text FROM final""",
    "markdown_files_chunks": "WITH RECURSIVE " + MD_ITEMS + "," + MICRO + """,
        src AS (SELECT m.*, 'doc' || d.doc_id || '.md' AS source_file, d.source_type FROM micro m JOIN docs_md d USING (doc_id)),"""
        + _numbered("src") + """SELECT doc_id, seq, page, heading_path, block_type, content, category, embedding_text FROM final""",
    "micro_merge": "WITH RECURSIVE " + MD_ITEMS + "," + MICRO
        + "SELECT doc_id, seq, heading_path, block_type, content FROM micro",
    "preamble_merge": "WITH RECURSIVE " + PREAMBLE + "SELECT doc_id, seq, block_type, content FROM pre",
    "flat_windows_strict": "WITH RECURSIVE " + FLAT_ITEMS
        + ", fseq AS (SELECT doc_id, i - 1 AS seq, block_type, content FROM fitems)," + _windows("fseq", True)
        + "SELECT doc_id, seq, block_type, content FROM flatw",
    "chunk_documents_flat": "WITH RECURSIVE " + PREAMBLE + f""",
        items AS (SELECT doc_id, seq + 1 AS i, block_type, content, '' AS heading_path, '' AS title, 0 AS page,
          CAST(NULL AS VARCHAR) AS description,
          block_type IN ('term', 'text') AND length(content) < {V.MICRO_CHUNK_CHARS} AS tiny FROM pre),""" + MICRO + ","
        + _windows("micro", False) + """,
        src AS (SELECT m.*, d.source_file, d.source_type FROM flatw m JOIN docs_flat d USING (doc_id)),"""
        + _numbered("src") + """SELECT doc_id, seq, id, page, heading_path, block_type, content, category,
        embedding_text FROM final""",
    "stable_ids_per_source": "WITH " + X.CHUNKS_SQL + f""",
        b AS (SELECT doc_id, seq, payload_file, {_id_sql('payload_file', 'source_type', "'0'", "''", 'content')} AS base FROM chunks_t)
        SELECT doc_id, seq, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (
          SELECT *, row_number() OVER (PARTITION BY payload_file, base ORDER BY doc_id, seq) AS k FROM b)""",
    "assign_category": "WITH " + X.CHUNKS_SQL + f"""SELECT doc_id, seq,
        {X.sql_category("payload_file || '  ' || substr(content, 1, 300)")} AS category FROM chunks_t""",
}
