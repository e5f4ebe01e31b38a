"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.llm.common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.mixing import pareto_mix
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.exact_dedup import mark_duplicates
    return mark_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.warc import archive
    return archive(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.line_dedup import line_report
    return line_report(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.near_dedup import components
    return components(table(spark, sf_dir, "documents"), similarity=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.url_filter import filter_urls, rule_table
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quillgraph.llm.byte_bpe import VOCABULARY, encode_digests
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.licenses import scan_licenses
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quillgraph.llm.token_counts import MODEL, token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.ranked_search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op13_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.hash_ring import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pareto_mix, op2_byte_bpe, op3_exact_dedup, op4_warc_bundles, op5_line_dedup, op6_minhash_components, op7_url_filter, op8_quality,
    op9_license_scan, op10_token_counts, op11_ranked_search, op12_collocations, op13_hash_ring)}


def _template_values() -> str:
    from quillgraph.llm.licenses import template_words
    return ", ".join(f"({t}, '{name}', '{word}', {tf})" for t, name, word, tf in template_words())


_ANCHOR = ("licen[sc]e|copyright|all rights reserved|spdx|creative commons|public domain|permission is hereby|"
           "redistribution and use|cc[- ]by")
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hash52(text: str, first: int) -> str:
    return f"('0x' || substr(md5({text}), {first}, 13))::BIGINT"


def _xor_bits(value: str, images: str, n: int) -> str:
    """The exclusive or of images[j + 1] over the bits j of a value."""
    out = "0::BIGINT"
    for j in range(n):
        out = f"xor({out}, (({value} >> {j}) & 1) * {images}[{j + 1}])"
    return out


def _ring_sql(shards: int = 8, rounds: int = 80) -> str:
    """The ring by window functions, its closing turns by unrolled rounds (more than needed change nothing), CRC-32 by linearity.

    ``adv`` moves a CRC state on by one zero byte; ``short`` holds its powers 0 to 255 on eight byte bits and on the start
    value, ``long`` the powers 256 a on all 32 bits, so a text's CRC is a sum over blocks of 256 bytes, counted from its end.
    """
    from quillgraph.llm.hash_ring import POINTS, SLACK, TURNS
    adv = "xor(x >> 8, tab[(x & 255) + 1])"
    last = "t0 AS (SELECT [" + ", ".join([str(TURNS)] * shards) + "] AS t)"
    for k in range(1, rounds + 1):
        last += f""",
s{k} AS (SELECT list_filter(walk, lambda x: turn < t[x + 1])[1] AS shard, turn, sum(mass) AS mass FROM loads, t{k - 1} GROUP BY ALL),
t{k} AS MATERIALIZED (
  SELECT list(least(t[i + 1], coalesce(e, {TURNS})) ORDER BY i) AS t FROM range({shards}) n(i) CROSS JOIN t{k - 1} LEFT JOIN (
    SELECT shard, min(turn) + 1 AS e FROM (SELECT shard, turn, sum(mass) OVER (PARTITION BY shard ORDER BY turn) AS upto FROM s{k})
    WHERE upto::DOUBLE >= (SELECT {1 + SLACK}::DOUBLE * sum(mass)::DOUBLE / {shards} FROM loads) GROUP BY shard) ON shard = i)"""
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
tables AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM range(256) r(i)),
short AS (
  SELECT 0 AS b, list_append(list_transform(range(8), lambda j: tab[(1 << j) + 1]), 4294967295) AS v, tab FROM tables
  UNION ALL SELECT b + 1, list_transform(v, lambda x: {adv}), tab FROM short WHERE b < 256),
basis AS (
  SELECT 0 AS b, list_transform(range(32), lambda j: 1::BIGINT << j) AS m, tab FROM tables
  UNION ALL SELECT b + 1, list_transform(m, lambda x: {adv}), tab FROM basis WHERE b < 256),
step AS (SELECT m FROM basis WHERE b = 256),
long AS (
  SELECT 0 AS a, list_transform(range(32), lambda j: 1::BIGINT << j) AS l, (SELECT max(n) // 256 FROM docs) AS most
  UNION ALL SELECT a + 1, list_transform(l, lambda x: {_xor_bits('x', 'm', 32)}), most FROM long, step WHERE a < most),
bytes AS (
  SELECT row, n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS hex, unnest(range(n)) AS i FROM docs),
powers AS (
  SELECT row, n, ('0x' || hex)::BIGINT AS byte, (n - 1 - i) // 256 AS a, (n - 1 - i) % 256 AS b FROM bytes),
blocks AS (SELECT row, a, bit_xor({_xor_bits('byte', 'v', 8)}) AS x FROM powers JOIN short USING (b) GROUP BY row, a
           UNION ALL SELECT row, n // 256, v[9] FROM docs JOIN short ON b = n % 256),
crcs AS (SELECT row, xor(bit_xor({_xor_bits('x', 'l', 32)}), 4294967295) AS crc FROM blocks JOIN long USING (a) GROUP BY row),
places AS (
  SELECT s AS shard, {_hash52("'shard:' || s || ':' || v", 1)} AS point FROM range({shards}) a(s), range({POINTS}) b(v)),
arcs AS (SELECT row_number() OVER (ORDER BY point, shard) - 1 AS place, point, shard FROM places),
ahead AS (
  SELECT x.place, y.shard, min((y.place - x.place + {shards * POINTS}) % {shards * POINTS}) AS far
  FROM arcs x CROSS JOIN arcs y GROUP BY x.place, y.shard),
walks AS (SELECT place, list(shard ORDER BY far) AS walk FROM ahead GROUP BY place),
keyed AS (
  SELECT *, {_hash52('key', 1)} AS point, floor({_hash52('key', 14)} / ({float((1 << 52) // TURNS)}::DOUBLE))::INT AS turn FROM docs),
placed AS (
  SELECT keyed.*, coalesce(p.place, 0) AS place FROM keyed ASOF LEFT JOIN (SELECT point, min(place) AS place FROM arcs GROUP BY point) p
  ON keyed.point <= p.point),
loads AS MATERIALIZED (SELECT walk, turn, sum(n + 1) AS mass FROM placed JOIN walks USING (place) GROUP BY place, walk, turn),
{last},
done AS (
  SELECT placed.*, walk[1]::INT AS home, list_filter(walk, lambda x: turn < t[x + 1])[1]::INT AS shard
  FROM placed JOIN walks USING (place) CROSS JOIN t{rounds})
SELECT doc_id, (n + 1)::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, home, NULL::INT AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY point, doc_id, n, crc) - 1 AS slot
FROM done JOIN crcs USING (row)"""


ORACLE = {
    "op1_pareto_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS cut, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest,
         sum(source_size) OVER () AS total
  FROM per WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (
  SELECT source, source_size, w, cut, (1.5::DOUBLE * total::DOUBLE - cut::DOUBLE) / rest::DOUBLE AS rate FROM steps),
level AS (SELECT arg_min(rate, cut) FILTER (WHERE 2 * source_size::DOUBLE > rate * w) AS rate FROM rates),
targets AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE, level.rate * w) AS target FROM rates, level),
drawn AS (
  SELECT doc_id, size, sized.source, source_size, target, floor(CASE WHEN size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS sure,
         CASE WHEN size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN size > 0 THEN target / source_size ELSE 0 END) AS p,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn),
ordered AS (
  SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS wanted,
         coalesce(sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (sure + CASE WHEN q IS NOT NULL AND before + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered""",
    "op3_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n""",
    "op4_warc_bundles": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM q""",
    # links with an absolute target, given by one canonical element in the usual order of attributes
    "op7_url_filter": r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
named AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<link rel="canonical" href="([^"]*)"', 1) AS target FROM pages),
links AS (SELECT url AS a, target AS b FROM named WHERE target LIKE '%://%'
          UNION SELECT target, url FROM named WHERE target LIKE '%://%'),
walk AS (SELECT a, b FROM links UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT b FROM walk),
parts AS (
  SELECT url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
fits AS (
  SELECT url, rules.host || rules.path AS rule, verdict,
         row_number() OVER (PARTITION BY url ORDER BY length(rules.host || rules.path) DESC, rules.host || rules.path DESC) AS n
  FROM parts JOIN rules ON (parts.host = rules.host OR parts.host LIKE '%.' || rules.host) AND starts_with(parts.path, rules.path)),
alias AS (SELECT a AS url, min(verdict) AS verdict FROM walk JOIN fits ON fits.url = walk.b AND fits.n = 1 GROUP BY a)
SELECT page_id, host, path, fits.rule, coalesce(fits.verdict, alias.verdict, 'allow') AS verdict
FROM pages JOIN parts ON pages.url IS NOT DISTINCT FROM parts.url LEFT JOIN fits ON fits.url = pages.url AND fits.n = 1
LEFT JOIN alias ON alias.url = pages.url""",
    # pairs of different sets that share a shingle are counted; equal sets are one node
    "op6_minhash_components": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS items FROM w),
sets AS (SELECT min(doc_id) AS node, items FROM s WHERE len(items) > 0 GROUP BY items),
tokens AS (SELECT node, len(items) AS n, unnest(items) AS item FROM sets),
pairs AS (
  SELECT x.node AS a, y.node AS b FROM tokens x JOIN tokens y ON x.item = y.item AND x.node < y.node
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT node, node AS other FROM sets UNION SELECT walk.node, edges.b FROM walk JOIN edges ON walk.other = edges.a),
named AS (SELECT node, min(other) AS component FROM walk GROUP BY node)
SELECT doc_id, len(items)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id,
       doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN sets USING (items) LEFT JOIN named USING (node)""",
    # sets that share one of their rarest words are compared, rarity being the number of sets with the word
    "op5_line_dedup": rf"""
WITH split_text AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines)))::INT AS line, unnest(lines) AS text FROM split_text),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS items FROM lines),
classes AS (SELECT row_number() OVER () AS c, items, len(items) AS n, min((doc_id, line)) AS first FROM sets WHERE len(items) > 0 GROUP BY items),
words AS (SELECT c, n, unnest(items) AS word FROM classes WHERE n >= 4),
df AS (SELECT word, count(*) AS f FROM words GROUP BY word),
ranked AS (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS place FROM words JOIN df USING (word)),
prefix AS (SELECT c, n, word FROM ranked WHERE place <= n - ceil(0.8::DOUBLE * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT x.c AS a, y.c AS b FROM prefix x JOIN prefix y ON x.word = y.word AND x.c < y.c
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
near AS (
  SELECT a.c AS a, b.c AS b, a.first AS fa, b.first AS fb FROM pairs JOIN classes a ON pairs.a = a.c JOIN classes b ON pairs.b = b.c
  WHERE 100 * len(list_intersect(a.items, b.items)) >= 80 * (a.n + b.n - len(list_intersect(a.items, b.items)))),
late AS (SELECT DISTINCT CASE WHEN fa > fb THEN a ELSE b END AS c FROM near),
marked AS (
  SELECT sets.doc_id, sets.line, classes.c IS NOT NULL AND (late.c IS NOT NULL OR (sets.doc_id, sets.line) <> classes.first) AS gone
  FROM sets LEFT JOIN classes USING (items) LEFT JOIN late USING (c))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (WHERE gone), '') AS removed
FROM marked GROUP BY doc_id""",
    # no path names a licence file, so only documents that are a licence text as a whole hold for a directory
    "op9_license_scan": rf"""
WITH t(template, license, word, tf) AS (VALUES {_template_values()}),
docs AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, coalesce(text, '') AS text, {_NORM} AS norm FROM documents),
seen AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(norm, '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*')) AS word FROM docs),
df AS (SELECT word, count(*) AS f FROM seen WHERE word IN (SELECT word FROM t) GROUP BY word),
n AS (SELECT count(*)::DOUBLE AS n FROM docs),
idf AS (
  SELECT DISTINCT t.word, ln((n.n + 1) / (coalesce(f, 0) + 1)) + 1 AS idf FROM t CROSS JOIN n LEFT JOIN df USING (word)),
posts AS (
  SELECT template, license, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS t FROM t JOIN idf USING (word)),
marked AS (SELECT * FROM docs WHERE regexp_matches(norm, '{_ANCHOR}')),
parts AS (
  SELECT doc_id, path, trim(text, ' ') AS whole, unnest(list_concat(
    string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n'), string_split(text, chr(10)),
    string_split_regex(text, '\n\s*\n'), [text])) AS part FROM marked),
found AS (
  SELECT DISTINCT doc_id, path, trim(part, ' ') AS passage, trim(part, ' ') = whole AS whole FROM parts
  WHERE regexp_matches(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ANCHOR}')),
words AS (
  SELECT passage, unnest(regexp_extract_all(translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*')) AS word FROM (SELECT DISTINCT passage FROM found)),
vectors AS (
  SELECT passage, words.word, count(*) * coalesce(any_value(idf), any_value(ln(n.n + 1) + 1)) AS p
  FROM words CROSS JOIN n LEFT JOIN idf ON idf.word = words.word GROUP BY passage, words.word),
sizes AS (SELECT passage, sqrt(sum(p * p)) AS norm FROM vectors GROUP BY passage),
near AS (
  SELECT passage, license, round(sum(p * t) / any_value(norm), 6) AS cosine
  FROM vectors JOIN posts USING (word) JOIN sizes USING (passage) GROUP BY passage, template, license),
best AS (
  SELECT doc_id, path, max((cosine, license, whole)) AS b FROM found JOIN near USING (passage) WHERE cosine >= 0.7 GROUP BY doc_id, path),
own AS (SELECT doc_id, path, b[1] AS cosine, b[2] AS license, b[3] AS whole, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM best),
dirs AS (SELECT dir, max((cosine, license)) AS b FROM own WHERE whole GROUP BY dir),
climb AS (
  SELECT d.dir AS dir, max((length(dirs.dir), dirs.dir, b[2], b[1])) AS near
  FROM (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM docs) d
  JOIN dirs ON d.dir = dirs.dir OR dirs.dir = '' OR starts_with(d.dir, dirs.dir || '/') GROUP BY d.dir)
SELECT docs.doc_id, docs.path, coalesce(own.license, near[3]) AS license, coalesce(own.cosine, near[4]) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NULL THEN near[2] END AS license_dir
FROM docs LEFT JOIN own ON docs.doc_id = own.doc_id AND docs.path = own.path
LEFT JOIN climb ON climb.dir = regexp_extract(docs.path, '^(.*)/[^/]*$', 1)""",
    "op11_ranked_search": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (
  SELECT item_id, unnest(regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
sizes AS (SELECT count(*) AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM docs WHERE len(terms) > 0),
found AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM found, sizes GROUP BY term, all_docs),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms))) AS part
  FROM found JOIN weights USING (term), sizes),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(norm, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, {_NORM} AS norm FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces CROSS JOIN range(1, 5) s(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM counts WHERE k > 1) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS cover
  FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 2), range(2, 4) a(n), range(1, 4) b(i)
  WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_phrases o ON o.lang = best.lang AND o.phrase = best.phrase
  WHERE cover IS NULL OR 100 * cover < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op13_hash_ring": _ring_sql(),
}
