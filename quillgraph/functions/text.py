"""Column functions on text.  Every function takes and returns Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quillgraph.functions import vocab as V


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_BUILT: dict = {}


def built_once(key: tuple, build) -> Column:
    """Column expression built once per session: large ones cost many calls into the JVM."""
    from pyspark import SparkContext
    full = (id(SparkContext._active_spark_context), *key)
    if full not in _BUILT:
        _BUILT[full] = build()
    return _BUILT[full]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def nullif_blank(x) -> Column:
    return F.when(strip(x) != "", _c(x))


def strip(x) -> Column:
    """Trim every whitespace character Python's ``strip`` trims."""
    return F.btrim(_c(x), F.lit(V.WS_CHARS))


def rstrip(x) -> Column:
    return F.rtrim(_c(x), F.lit(V.WS_CHARS))


def collapse_ws(x) -> Column:
    """Every whitespace run becomes one blank."""
    return strip(F.regexp_replace(_c(x), V.WS_RUN, " "))


def split_ws(x) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(_c(x), f"[{V.WS_CLASS}]+"), lambda t: t != "")


def split_lines(x) -> Column:
    """Lines at every boundary ``splitlines`` knows; no empty tail line."""
    return let(
        F.split(_c(x), V.LINE_BREAK, -1),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def preview(x, n: int) -> Column:
    flat = collapse_ws(F.coalesce(_c(x), F.lit("")))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def truncate(x, n: int) -> Column:
    s = strip(F.coalesce(_c(x), F.lit("")))
    cut = F.concat(rstrip(F.substring(s, 1, n)), F.lit("..."))
    return F.when(F.length(s) > n, cut).otherwise(s)


def ascii_lower(x) -> Column:
    return F.translate(_c(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _scaled(x: Column, digits: int) -> Column:
    """|x| * 10^digits as a whole number, rounded half-even on the exact binary value.

    The product is split into its double and its rounding error, so a decimal that only
    looks like a tie (167554.85) goes the way its stored value lies.
    """
    a, scale = F.abs(x), F.lit(float(10 ** digits))
    p = a * scale
    c = a * F.lit(134217729.0)
    high = c - (c - a)
    error = (high * scale - p) + (a - high) * scale
    low = F.floor(p)
    part = p - low
    up = F.when(part > 0.5, True).when(part < 0.5, False).when(error > 0, True).when(error < 0, False).otherwise(
        low % 2 == 1)
    return F.when(up, low + 1).otherwise(low)


def py_round(x, digits: int) -> Column:
    """Rounding as Python's ``round`` does it."""
    v = _c(x).cast("double")
    return F.when(v < 0, -1.0).otherwise(1.0) * _scaled(v, digits) / float(10 ** digits)


def fixed(x, digits: int) -> Column:
    """A double with a fixed number of decimals, as ``%.nf`` prints it."""
    v = _c(x).cast("double")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    unit = 10 ** digits
    return let(_scaled(v, digits), lambda n: F.concat(
        sign, F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0")))


def time_range(start, end) -> Column:
    zero = F.lit(0.0)
    return F.concat(
        fixed(F.coalesce(_c(start), zero), 1), F.lit("s-"),
        fixed(F.coalesce(_c(end), zero), 1), F.lit("s"),
    )


def mm_ss(sec) -> Column:
    whole = _c(sec).cast("bigint")
    mins, secs = F.floor(whole / 60), F.pmod(whole, F.lit(60))
    padded = lambda v: F.when(v < 100, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    return F.when(_c(sec).isNull(), F.lit("--")).otherwise(
        F.concat(padded(mins), F.lit(":"), padded(secs))
    )


def safe_label(x, n: int = 36) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    cut = F.btrim(F.substring(cleaned, 1, n), F.lit("._-"))
    return F.lower(F.when(cut == "", F.lit("item")).otherwise(cut))


def _safe_name(x, default: str) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.when(cleaned == "", F.lit(default)).otherwise(cleaned)


def safe_type(x) -> Column:
    return _safe_name(x, "document")


def safe_stem(x) -> Column:
    return _safe_name(stem(x), "pdf")


def basename(x) -> Column:
    return F.regexp_extract(_c(x), r"([^/]*)/*$", 1)


def stem(x) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(x), r"(?<=.)\.[^.]+$", "")


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def heuristic_category(x) -> Column:
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(_contains_any(low, V.TECH_KEYWORDS), F.lit("tech_manual"))
        .when(_contains_any(low, V.BUSINESS_KEYWORDS), F.lit("business_sop"))
        .otherwise(F.lit("general"))
    )


def chunk_category(source_file, heading_path, content) -> Column:
    """Category of a chunk from its file name, heading path and the start of its content."""
    return heuristic_category(
        F.concat_ws(" ", F.coalesce(_c(source_file), F.lit("")),
                    F.coalesce(_c(heading_path), F.lit("")),
                    F.substring(F.coalesce(_c(content), F.lit("")), 1, 300))
    )


def query_phrase(x) -> Column:
    return collapse_ws(F.lower(F.coalesce(_c(x), F.lit(""))))


def _tokens(x) -> Column:
    return F.transform(
        F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(V.QUERY_TOKEN), F.lit(0)), F.lower
    )


def query_terms(x, min_phrase: int = 1) -> Column:
    """Whole phrase, then distinct tokens, in order of first appearance."""
    phrase = query_phrase(x)
    head = F.when(F.length(phrase) >= min_phrase, F.array(phrase)).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(head, _tokens(x)))


def rank_terms(x) -> Column:
    words = F.filter(split_ws(F.coalesce(_c(x), F.lit(""))), lambda t: F.length(t) > 1)
    return F.array_distinct(F.concat(F.transform(words, F.lower), _tokens(x)))


def char_bigrams(terms) -> Column:
    """All two-character pieces of all terms, repeats kept."""
    long_enough = F.filter(_c(terms), lambda t: F.length(t) >= 2)
    return F.flatten(F.transform(long_enough, lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))


def is_followup(x) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike("|".join(V.FOLLOWUP_MARKERS))


def json_object_text(x) -> Column:
    """First ``{`` to last ``}``, or the trimmed text when there is none."""
    s = strip(F.coalesce(_c(x), F.lit("")))
    obj = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(obj != "", obj).otherwise(s)


def first_json_object(x, schema) -> Column:
    """Parsed object or null when the text holds no valid object."""
    text = json_object_text(x)
    return F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"),
                  F.from_json(text, schema))


def json_or_empty(x, schema) -> Column:
    """Payload column: malformed or missing JSON becomes a struct of nulls."""
    return F.coalesce(F.from_json(_c(x), schema), F.from_json(F.lit("{}"), schema))


def unfenced(x) -> Column:
    """Model response without the code fence around it."""
    s = strip(F.coalesce(_c(x), F.lit("")))
    return strip(F.regexp_replace(F.regexp_replace(s, "^```(?:json)?(?:```)?", ""), "```$", ""))


def escape_html(x) -> Column:
    out = _c(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _regex_quote(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def highlight_terms(query) -> Column:
    """Whole query and its pieces of two or more characters, longest first."""
    q = strip(F.coalesce(_c(query), F.lit("")))
    pieces = F.split(q, rf"""[{V.WS_CLASS},，。！？；:：/\\|()\[\]{{}}<>"'`]+""")
    terms = F.filter(F.concat(F.array(q), pieces), lambda t: F.length(t) >= 2)
    indexed = F.transform(terms, lambda t, i: F.struct(
        (-F.length(t)).alias("neg_len"), i.alias("i"), t.alias("t")))
    ordered = F.transform(F.array_sort(indexed), lambda s: s["t"])
    lowered = F.transform(ordered, F.lower)
    return F.filter(ordered, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def highlight(text, query) -> Column:
    """Mark query terms; everything is HTML-escaped.  Matching ignores case."""
    terms = highlight_terms(query)
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(terms, _regex_quote), "|"))
    # private-use markers survive escaping, so the match runs on the unescaped text
    marked = F.regexp_replace(_c(text), pattern, F.lit("\ue000$0\ue001"))
    tagged = F.replace(F.replace(escape_html(marked), F.lit("\ue000"), F.lit("<mark>")),
                       F.lit("\ue001"), F.lit("</mark>"))
    return F.when(F.size(terms) == 0, escape_html(text)).otherwise(tagged)


def has_rich_content(x) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    return t.rlike(V.RICH_TAG) | t.rlike(V.IMAGE) | t.rlike(V.LINK)


def strip_legacy_prefix(x) -> Column:
    """Drop a leading 'Heading path: …' paragraph when another one follows it."""
    s = strip(x)
    tail = strip(F.regexp_replace(s, r"(?s)^Heading path: .*?\n\n", ""))
    return F.when(s.startswith("Heading path: ") & s.contains("\n\n"), tail).otherwise(s)


def iso_now() -> Column:
    """Current time as ISO-8601 text in the session's zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def asr_confidence(avg_logprob) -> Column:
    return py_round(_c(avg_logprob) + F.lit(1.0), 3)


def normalize_heading(x) -> Column:
    """NFKC, three radical repairs, and no blanks between CJK ideographs.

    Plain ASCII headings need none of this.  Other headings go through the
    ICU normalizer that ships with Spark, so no Python worker is started.
    """
    s = F.coalesce(_c(x), F.lit(""))
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), s, F.lit(True))
    repaired = F.regexp_replace(
        F.translate(composed, V.RADICALS_FROM, V.RADICALS_TO), V.CJK_GAP, "")
    return F.when(s.rlike(r"[^\x00-\x7f]"), repaired).otherwise(s)
