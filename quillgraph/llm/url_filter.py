"""URL filters that follow redirects: a decision about one address holds for its aliases.

Rules name a host and the start of a path, and allow or block; a rule covers subdomains, and the longest rule that fits
an address wins.  Addresses that redirect to each other or name each other as canonical form one component; components are
found over all links in rounds of star steps.  An address without a rule of its own takes the decision of its
component: allowed if any address in it is explicitly allowed, else blocked if any is blocked, else ``default``.  An address with
a rule always keeps that rule's decision.

Links come from the pages themselves (canonical link elements, refresh redirects) and from an optional table of
redirects.  Their targets are judged by the rules even where no page was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm.common import ascii_lower, write_table
from quillgraph.operators.traversal import component_labels

#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The form in which addresses are compared: no fragment, scheme and host in lower case; null without ``://``."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*?://)[^/?#]*", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(ascii_lower(F.trim(whole)), host_of(url), rest))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def fitting_rule(rows: DataFrame, rules: DataFrame, key: str = "_key") -> DataFrame:
    """(key, rule, rule_verdict): the longest rule that fits, for the rows (key, host, path) that any fits.

    Two equi-joins: host suffixes with the hosts that have rules, which know the lengths of their rules' paths, and then
    (host, path start) with the rules.  A row meets one candidate per suffix and length, not one per rule.
    """
    lengths = rules.groupBy(F.col("host").alias("_suffix")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = rows.filter("host <> ''").select(F.col(key), "path", F.explode(suffixes).alias("_suffix")).join(lengths, "_suffix").select(
        key, "_suffix", "path", F.explode("_lengths").alias("_n")).filter(F.length("path") >= F.col("_n")).select(
        key, "_suffix", F.expr("substring(path, 1, _n)").alias("_start"))
    own = rules.groupBy(F.col("host").alias("_suffix"), F.col("path").alias("_start")).agg(
        F.min("verdict").alias("_verdict"))  # of two verdicts for one rule, allow holds
    name = F.concat("_suffix", "_start")
    return starts.join(own, ["_suffix", "_start"]).groupBy(key).agg(F.max(F.struct(
        F.length(name).alias("n"), name.alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best")).select(
        key, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def _resolved(target: Column, base: Column) -> Column:
    """An address from the text of a link, relative to the page's own."""
    clean = F.trim(F.regexp_replace(target, "(?i)&amp;", "&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#/]*/)*)?)", 1)
    return F.when(F.length(clean) == 0, F.lit(None)).when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), clean).when(
        clean.startswith("//"), F.concat(scheme, F.lit(":"), clean)).when(clean.startswith("/"), F.concat(root, clean)).when(
        clean.rlike(r"^([#?]|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None)).otherwise(
        F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), clean))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses from canonical link elements and refresh redirects in ``pages`` (url, html)."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    links = F.expr(r"""regexp_extract_all(_html, '(?is)<link\\b[^>]*>', 0)""")
    metas = F.expr(r"""regexp_extract_all(_html, '(?is)<meta\\b[^>]*>', 0)""")
    href = lambda tag: F.coalesce(*[F.nullif(F.regexp_extract(tag, p, 1), F.lit("")) for p in (
        r"""(?is)\bhref\s*=\s*"([^"]*)\"""", r"""(?is)\bhref\s*=\s*'([^']*)'""", r"""(?is)\bhref\s*=\s*([^\s"'>]+)""")])
    jump = lambda tag: F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'>]+)""", 1)
    canonical = F.transform(F.filter(links, lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b""")), href)
    refresh = F.transform(F.filter(metas, lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b""")), jump)
    marked = pages.select("url", html.alias("_html")).filter(F.col("_html").rlike("(?i)canonical|refresh"))
    found = marked.select("url", F.explode(F.concat(canonical, refresh)).alias("_to"))
    return found.select(address(url).alias("src"), address(_resolved(F.col("_to"), url)).alias("dst"))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html); ``redirects`` has (src, dst) urls.

    A null url or one without ``://`` has empty host and path, fits no rule, links to nothing and gets ``default``.  Null html
    has no links.  Of rules of equal length the last in order of text wins, and of two verdicts for the same rule allow.  Repeated
    rows are judged alike; empty tables give no rows, no rules or no links.  Other columns are ignored.
    """
    key = address(F.col("url"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    links, _ = write_table(links.filter("src <> dst").distinct(), "links")
    labels, _ = write_table(component_labels(links), "aliases")

    nodes = labels.select(F.col("node").alias("_key"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    judged = labels.join(fitting_rule(nodes, rules).withColumnRenamed("_key", "node"), "node").groupBy("label").agg(
        F.min("rule_verdict").alias("_by_alias"))  # allow before block
    aliases = labels.join(judged, "label").select(F.col("node").alias("_key"), "_by_alias")

    # urls that are no address get keys of their own, so they do not meet in one task
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))).alias("_key"))
    ruled = fitting_rule(rows.select("_key", "host", "path").distinct(), rules)
    return rows.join(ruled, "_key", "left").join(aliases, "_key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "_by_alias", F.lit(default)).alias("verdict"))
