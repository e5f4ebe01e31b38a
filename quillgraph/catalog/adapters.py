"""Corpus-shaped tables derived from the given ones, in Spark and as SQL text.

Every adapter reads whole tables.  The SQL twins are common table expressions with the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.functions import text as T, vocab as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table of fewer files than cores before heavy row-wise work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# ---------------------------------------------------------------- documents
def docs_flat(spark, sf_dir) -> DataFrame:
    return balanced(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        F.lit("markdown").alias("source_type"), "text")


def docs_md(spark, sf_dir) -> DataFrame:
    """Documents with headings, page markers, parameter tables and image lines around their text."""
    d = balanced(table(spark, sf_dir, "documents"))
    doc = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\nOverview of "), F.col("source"), F.lit("\n\n## "), F.col("lang"),
        F.lit("\n\n"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<!-- page: "), (F.col("doc_id") % 7 + 1).cast("string"),
                                                  F.lit(" -->\n"))).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 5 == 0, F.concat(
            F.lit("| name | value |\n| --- | --- |\n| lang | "), F.col("lang"), F.lit(" |\n| chars | "),
            F.col("n_chars").cast("string"), F.lit(" |\n|  | "), F.col("source"), F.lit(" |\n\n"))).otherwise(F.lit("")),
        F.lit("### doc "), doc, F.lit("\n\n"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(
            F.lit("Figure of document:\n![scan "), doc, F.lit("](img/"), doc, F.lit(".png)\n\n"))).otherwise(F.lit("")),
        F.col("text"))
    return d.select("doc_id", F.concat("source", F.lit("/doc_"), doc, F.lit(".md")).alias("source_file"),
                    F.lit("markdown").alias("source_type"), text.alias("text"))


DOCS_FLAT_SQL = """
docs_flat AS (
  SELECT doc_id, source || '/doc_' || doc_id || '.md' AS source_file, 'markdown' AS source_type, text FROM documents)
"""
DOCS_MD_SQL = """
docs_md AS (
  SELECT doc_id, source || '/doc_' || doc_id || '.md' AS source_file, 'markdown' AS source_type,
    '# ' || source || chr(10) || chr(10) || 'Overview of ' || source || chr(10) || chr(10) || '## ' || lang
    || chr(10) || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '<!-- page: ' || (doc_id % 7 + 1) || ' -->' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN '| name | value |' || chr(10) || '| --- | --- |' || chr(10) || '| lang | '
         || lang || ' |' || chr(10) || '| chars | ' || n_chars || ' |' || chr(10) || '|  | ' || source || ' |'
         || chr(10) || chr(10) ELSE '' END
    || '### doc ' || doc_id || chr(10) || chr(10)
    || CASE WHEN doc_id % 7 = 0 THEN 'Figure of document:' || chr(10) || '![scan ' || doc_id || '](img/' || doc_id
         || '.png)' || chr(10) || chr(10) ELSE '' END
    || text AS text
  FROM documents)
"""

# SQL spellings of the whitespace class (RE2) used by the adapters and oracles
SQL_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SQL_WS}]+|[{SQL_WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SQL_WS}]+', ' ', 'g'))"


def sql_category(x: str) -> str:
    tech, biz = "|".join(V.TECH_KEYWORDS), "|".join(V.BUSINESS_KEYWORDS)
    return (f"CASE WHEN regexp_matches(lower({x}), '{tech}') THEN 'tech_manual' "
            f"WHEN regexp_matches(lower({x}), '{biz}') THEN 'business_sop' ELSE 'general' END")


# ---------------------------------------------------------------- chunk rows
def chunks_t(spark, sf_dir) -> DataFrame:
    """One chunk per non-blank line: the first lines carry heading paths, later ones have none."""
    d = balanced(table(spark, sf_dir, "documents"))
    lines = d.select("doc_id", "source", "lang", F.posexplode(T.split_lines("text")).alias("line_no", "line"))
    lines = lines.withColumn("content", T.strip("line")).filter(F.col("content") != "")
    n = F.col("line_no")
    path = (F.when(n == 0, F.col("source")).when(n == 1, F.concat_ws(" > ", "source", "lang"))
            .when(n <= 5, F.concat_ws(" > ", "source", "lang", F.concat(F.lit("p"), n.cast("string"))))
            .otherwise(F.lit("")))
    rows = lines.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), n.cast("string")).alias("id"), "content",
        F.lit("markdown").alias("source_type"), path.alias("heading_path"),
        F.concat("source", F.lit(".md")).alias("payload_file"), (F.col("doc_id") * 100000 + n).alias("seq"),
        "doc_id", "lang")
    return rows.select(
        "id", "content", "source_type", F.col("id").alias("anchor_id"), "heading_path", "payload_file",
        T.chunk_category("payload_file", "heading_path", "content").alias("category"),
        F.lit(False).alias("is_manual"), F.lit("2024-01-01T00:00:00").alias("created_at"),
        F.lit(1).alias("version"), "seq", "doc_id", "lang")


CHUNKS_SQL = f"""
doc_lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
chunk_rows AS (
  SELECT 'c' || doc_id || '-' || line_no AS id, {sql_strip('line')} AS content, 'markdown' AS source_type,
    CASE WHEN line_no = 0 THEN source WHEN line_no = 1 THEN source || ' > ' || lang
         WHEN line_no <= 5 THEN source || ' > ' || lang || ' > p' || line_no ELSE '' END AS heading_path,
    source || '.md' AS payload_file, doc_id * 100000 + line_no AS seq, doc_id, lang
  FROM doc_lines WHERE {sql_strip('line')} <> ''),
chunks_t AS (
  SELECT id, content, source_type, id AS anchor_id, heading_path, payload_file,
    {sql_category("payload_file || ' ' || heading_path || ' ' || substr(content, 1, 300)")} AS category,
    false AS is_manual, '2024-01-01T00:00:00' AS created_at, 1 AS version, seq, doc_id, lang
  FROM chunk_rows)
"""


# ---------------------------------------------------------------- L2 rows and a store that differs from them
def l2_t(spark, sf_dir) -> DataFrame:
    c = chunks_t(spark, sf_dir).filter(F.col("lang") != "es")
    return c.select(
        F.col("id").alias("chunk_id"), "anchor_id", F.col("payload_file").alias("source_file"), "source_type",
        "content", F.col("content").alias("display_content"), F.col("content").alias("embedding_text"),
        "heading_path", "is_manual", F.lit(False).alias("user_edited"), "seq")


def store_t(spark, sf_dir) -> DataFrame:
    """Chunks of the labelled documents; French content is an older wording."""
    c = chunks_t(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    old = F.when(F.col("lang") == "fr", F.concat("content", F.lit(" (old)"))).otherwise(F.col("content"))
    return c.withColumn("content", old).select(
        "id", "content", "source_type", "anchor_id", "heading_path", "payload_file", "category", "is_manual",
        "created_at", "version", "seq")


L2_SQL = CHUNKS_SQL + """,
l2_t AS (
  SELECT id AS chunk_id, anchor_id, payload_file AS source_file, source_type, content, heading_path, is_manual, seq
  FROM chunks_t WHERE lang <> 'es'),
store_t AS (
  SELECT id, CASE WHEN lang = 'fr' THEN content || ' (old)' ELSE content END AS content, source_type, anchor_id,
         heading_path, payload_file, category, is_manual, created_at, version, seq
  FROM chunks_t WHERE doc_id IN (SELECT doc_id FROM labels))
"""


def l2_all(spark, sf_dir, chunks: DataFrame | None = None) -> DataFrame:
    """L2 rows of all documents."""
    return (chunks_t(spark, sf_dir) if chunks is None else chunks).select(
        F.col("id").alias("chunk_id"), "anchor_id", F.col("payload_file").alias("source_file"), "source_type",
        "content", F.col("content").alias("display_content"), F.col("content").alias("embedding_text"),
        "heading_path", "is_manual", F.lit(False).alias("user_edited"), "seq")


def store_all(spark, sf_dir, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents; French content is an older wording."""
    old = F.when(F.col("lang") == "fr", F.concat("content", F.lit(" (old)"))).otherwise(F.col("content"))
    return (chunks_t(spark, sf_dir) if chunks is None else chunks).withColumn("content", old).select(
        "id", "content", "source_type", "anchor_id", "heading_path", "payload_file", "category", "is_manual",
        "created_at", "version", "seq")


ALL_SQL = CHUNKS_SQL + """,
l2_all AS (
  SELECT id AS chunk_id, anchor_id, payload_file AS source_file, source_type, content, heading_path, is_manual, seq
  FROM chunks_t),
store_all AS (
  SELECT id, CASE WHEN lang = 'fr' THEN content || ' (old)' ELSE content END AS content, source_type, anchor_id,
         heading_path, payload_file, category, is_manual, created_at, version, seq
  FROM chunks_t)
"""


# ---------------------------------------------------------------- questions and turns
def queries_t(spark, sf_dir) -> DataFrame:
    """Every sentence of every benchmark item, and every source with its language."""
    b = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"[.]")).alias("k", "s"))
    first = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit("-"), F.col("k").cast("string"))
                     .alias("query_id"), T.strip("s").alias("query")).filter(F.col("query") != "")
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    second = d.select(F.concat_ws("-", F.lit("s"), "source", "lang").alias("query_id"),
                      F.concat_ws(" ", "source", "lang").alias("query"))
    return first.unionByName(second)


QUERIES_SQL = f"""
bench_parts AS (
  SELECT item_id, unnest(string_split(text, '.')) AS s,
         generate_subscripts(string_split(text, '.'), 1) - 1 AS k FROM benchmark),
queries_t AS (
  SELECT 'b' || item_id || '-' || k AS query_id, {sql_strip('s')} AS query FROM bench_parts
  WHERE {sql_strip('s')} <> ''
  UNION ALL
  SELECT DISTINCT 's-' || source || '-' || lang, source || ' ' || lang FROM documents)
"""


def turns_t(spark, sf_dir) -> DataFrame:
    """User turns with the assistant turn that follows.  A marker word makes some of them follow-ups."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("_t"))
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    marked = F.when((F.col("turn") > 1) & (F.length("_t") % 2 == 0), F.concat(F.lit("那 "), F.col("_t"))).otherwise(
        F.col("_t"))
    return user.join(reply, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", T.strip(marked).alias("query"), F.coalesce("answer", F.lit("")).alias("answer"))


TURNS_SQL = f"""
turns_t AS (
  SELECT u.conv_id, u.turn,
    {sql_strip("CASE WHEN u.turn > 1 AND length(u.text) % 2 = 0 THEN '那 ' || u.text ELSE u.text END")} AS query,
    coalesce(a.text, '') AS answer
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')
"""


# ---------------------------------------------------------------- media and runs
def _seconds(ts: F.Column) -> F.Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts) / 1e6


def segments_t(spark, sf_dir) -> DataFrame:
    """Events of one user as the transcript of one video; a segment ends where the next one starts."""
    from quillgraph.operators.ordering import position_in_group
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("video_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("video_file"), "event_id",
        F.round(_seconds(F.col("ts")), 3).alias("start_sec"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), "event_type")
    placed = position_in_group(e, ["video_file"], ["start_sec", "event_id"], "pos")
    nxt = placed.select("video_file", (F.col("pos") - 1).alias("pos"), F.col("start_sec").alias("end_sec"))
    return placed.join(nxt, ["video_file", "pos"], "left").select(
        "video_file", F.col("event_id").alias("seq"), "start_sec",
        F.coalesce("end_sec", F.col("start_sec") + 1.0).alias("end_sec"), "text",
        (F.col("event_type") == "signup").alias("is_clip"))


SEGMENTS_SQL = """
segments_t AS (
  SELECT 'video_' || user_id || '.mp4' AS video_file, event_id AS seq, start_sec,
    coalesce(lead(start_sec) OVER (PARTITION BY user_id ORDER BY start_sec, event_id), start_sec + 1.0) AS end_sec,
    event_type || ' ' || event_id AS text, event_type = 'signup' AS is_clip
  FROM (SELECT *, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 3) AS start_sec FROM events))
"""


def clips_t(spark, sf_dir) -> DataFrame:
    """Purchases as clips of their user's video."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    start = F.round(_seconds(F.col("ts")), 3)
    return e.select(
        F.concat(F.lit("clip-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("video_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("video_file"),
        start.alias("start_sec"), (start + F.round(F.col("value") - 10, 2)).alias("end_sec"),
        F.when(F.col("value") < 5, F.lit(" ")).otherwise(F.concat(F.lit("purchase of "), F.col("value").cast("string")))
        .alias("semantic_summary"), F.col("event_id").alias("created_at"))


def bindings_t(spark, sf_dir) -> DataFrame:
    """Clips bound to chunks of labelled documents, some to clips or chunks that do not exist."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return e.join(lab, e.user_id == lab.doc_id).select(
        F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("clip-"), F.col("event_id").cast("string")).alias("video_clip_id"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("quality").cast("string"))
        .alias("pdf_anchor_id"),
        F.when(F.col("value") > 20, F.concat(F.lit("note "), F.col("value").cast("string"))).otherwise(F.lit(""))
        .alias("note"), F.col("event_id").alias("created_at"))


MEDIA_SQL = """
clips_t AS (
  SELECT 'clip-' || event_id AS id, 'video_' || user_id || '.mp4' AS video_file, s AS start_sec,
    s + round(value - 10, 2) AS end_sec,
    CASE WHEN value < 5 THEN ' ' ELSE 'purchase of ' || value END AS semantic_summary, event_id AS created_at
  FROM (SELECT *, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 3) AS s FROM events)
  WHERE event_type = 'purchase'),
bindings_t AS (
  SELECT 'm-' || event_id AS id, 'clip-' || event_id AS video_clip_id, 'c' || doc_id || '-' || quality AS pdf_anchor_id,
    CASE WHEN value > 20 THEN 'note ' || value ELSE '' END AS note, event_id AS created_at
  FROM events JOIN labels ON user_id = doc_id WHERE event_type IN ('purchase', 'signup'))
"""


def runs_t(spark, sf_dir) -> DataFrame:
    """Events as benchmark runs of one parser per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("parser"),
        (F.col("event_id") % 10 == 0).alias("is_warmup"), (F.col("value") < 40).alias("ok"),
        F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("int").alias("block_count"))


RUNS_SQL = """
runs_t AS (
  SELECT event_id AS run_id, event_type AS parser, event_id % 10 = 0 AS is_warmup, value < 40 AS ok, value AS seconds,
    CAST(json_extract_string(props, '$.k') AS INT) AS block_count FROM events)
"""
