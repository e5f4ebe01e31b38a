import hashlib
import io
import random
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from quillgraph.llm import licenses, url_filter, warc
from quillgraph.operators.ordering import scratch_path

PAGES = "page_id long, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3).withColumns({c: F.lit("own") for c in ("payload", "rule", "_key", "bundle")})


# archives

LONG = "é" * 60
ROWS = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (4, "http://a/3", "short"), (2, "http://a/4", "short"),
        (7, "http://b\r\nX: y", ""), (8, "http://c", None), (3, "http://a/2", LONG), (None, "http://d", LONG), (11, "http://e", "x" * 300_000),
        (12, "http://e", "x" * 300_000), (None, "http://f", "y" * 200), (13, "", "line\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


def archive_brute(rows):
    first = defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        least = min([x for x in first[h or ""] if x is not None], default=None)
        refers = least if len(raw) >= 100 and least is not None and i != least else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_archive_against_brute_force(spark):
    got = warc.archive(pages_of(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=repr) == archive_brute(ROWS)
    assert warc.archive(pages_of(spark, [])).count() == 0


def test_frames_seek_table_and_index(spark):
    folder = "file://" + scratch_path(spark, "warc").removeprefix("file:")
    index = warc.write_bundles(pages_of(spark, ROWS), folder, frame_bytes=1000, bundle_bytes=2000)
    rows = index.collect()
    assert len({r["bundle"] for r in rows}) > 1 and max(r["frame"] for r in rows) >= 1
    for r in rows:
        data = open(f"{folder.removeprefix('file://')}/{r['bundle']}", "rb").read()
        start, packed, plain = warc.read_seek_table(io.BytesIO(data))[r["frame"]]
        frame = zstandard.ZstdDecompressor().decompress(data[start:start + packed])
        assert (start, packed, plain) == (r["frame_start"], r["frame_size"], len(frame))
        fields, _, _ = warc.parse_record(frame[r["offset"]:r["offset"] + r["length"]])
        assert fields["WARC-Record-ID"] == f"<{r['record_id']}>"
        # a plain reader that skips what it doesn't know sees all records
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert text.count(f"<{r['record_id']}>".encode()) >= 1
    got = warc.fetch(index, folder, spark.createDataFrame([(4,), (11,)], "page_id long")).collect()
    assert {(r["page_id"], r["html"]) for r in got} == {(4, "short"), (11, "x" * 300_000)}


# urls

def test_hosts_and_paths(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.ORG/Es/1?q#f", "http://a.b?x/y", "http://a.b#x", "http://a.b", "x://y://z/w", "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).collect()]
    assert got == [("", ""), ("", ""), ("", ""), ("www.example.org", "/Es/1"), ("a.b", ""), ("a.b", ""), ("a.b", ""), ("y:", "//z/w"), ("", "/p")]


def test_rules(spark):
    rules = url_filter.rule_table(spark)
    rows = [(1, "http://x.example.org/es/a", None), (2, "http://x.example.org/en/12", None), (3, "http://x.example.org/fr/", None),
            (4, "http://example.com/de/x", None), (5, "http://notexample.org/es/", None), (6, "http://example.net/de/", None),
            (7, "http://org/", None), (8, "http://org", None), (9, None, None), (9, None, None), (10, "http://a.com/fr/x", "<html>")]
    got = {tuple(r) for r in url_filter.filter_urls(pages_of(spark, rows), rules).select("page_id", "rule", "verdict").collect()}
    assert got == {(1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, "org/", "allow"), (4, "com/de/", "block"),
                   (5, "org/", "allow"), (6, None, "allow"), (7, "org/", "allow"), (8, None, "allow"), (9, None, "allow"), (10, "com/fr/", "allow")}
    assert url_filter.filter_urls(pages_of(spark, rows), rules).count() == len(rows)
    assert url_filter.filter_urls(pages_of(spark, []), rules).count() == 0
    none = spark.createDataFrame([], rules.schema)
    assert {r["verdict"] for r in url_filter.filter_urls(pages_of(spark, rows), none).collect()} == {"allow"}


def test_decisions_follow_links(spark):
    canonical = '<head><LINK href="{}" rel=canonical></head>'
    refresh = "<meta http-equiv='refresh' content='0; URL=\"{}\"'>"
    rows = [(1, "http://n.net/a", canonical.format("http://example.com/de/1")),  # alias of a blocked address
            (2, "http://n.net/b#top", refresh.format("/a?x=1&amp;y=2")), (3, "http://n.net/a?x=1&y=2", canonical.format("a")),  # aliases of 1
            (4, "http://m.net/", canonical.format("//example.com/de/2")), (5, "http://m.net/sub/", canonical.format("http://m.net/")),
            (6, "http://e.org/x", canonical.format("http://m.net/sub/")),  # an explicit allow in the component of 4 and 5
            (7, "http://example.com/de/2", None), (8, "http://lonely.net/", canonical.format("http://lonely.net/")),
            (9, "http://bad.net/", canonical.format("javascript:x")), (10, None, canonical.format("http://example.com/de/1")),
            (11, "http://r.net/", None)]
    redirects = spark.createDataFrame([("http://r.net/", "http://n.net/b"), (None, "http://x/"), ("http://x/", None)], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages_of(spark, rows), url_filter.rule_table(spark), redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "block"}


def test_long_alias_chain_and_star(spark):
    chain = [(f"http://c.net/{i}", f"http://c.net/{i + 1}") for i in range(40)] + [("http://c.net/40", "http://example.com/de/z")]
    star = [(f"http://s.net/{i}", "http://s.net/hub") for i in range(300)]
    redirects = spark.createDataFrame(chain + star, "src string, dst string")
    rows = [(i, u, None) for i, u in enumerate(["http://c.net/0", "http://c.net/23", "http://s.net/7", "http://s.net/hub"])]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages_of(spark, rows), url_filter.rule_table(spark), redirects).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


# licences

def scan(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit("own") for c in ("license", "cosine", "word")})
    return {r["doc_id"]: r for r in licenses.scan_licenses(df.drop("license").withColumn("license", F.lit("own")), **options).collect()}


def test_statements_headers_and_inheritance(spark):
    filler = " ".join(f"w{random.Random(1).randrange(99)}{i}" for i in range(300))
    mit = licenses.TEMPLATES[6][1]
    rows = [(1, "p/LICENSE", mit), (2, "p/a.py", filler), (3, "p/q/deep/b.py", filler), (4, "p/q/c.py", f"{filler}\nLicensed under CC BY-NC 4.0. {filler}"),
            (5, "other/x.py", filler), (6, "p/vendor/COPYING.txt", "This program is free software: you can redistribute it and/or modify it\n"
             "under the terms of the GNU General Public License as published by the\nFree Software Foundation, either version 3 of the License,\n"
             "or (at your option) any later version.\n\n" + filler), (7, "p/vendor/z/m.c", None), (8, "pq/n.c", ""), (9, None, filler),
            (10, "other/y.py", "The licence of the driver was revoked in the end."), (11, "other/z.py", filler + "\nAll rights reserved.\n" + filler)]
    got = scan(spark, rows)
    assert {i: (r["license"], r["origin"], r["license_dir"]) for i, r in got.items()} == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "p"), 3: ("MIT", "inherited", "p"), 4: ("CC-BY-NC-4.0", "own", None), 5: (None, None, None),
        6: ("GPL-3.0", "own", None), 7: ("GPL-3.0", "inherited", "p/vendor"), 8: (None, None, None), 9: (None, None, None), 10: (None, None, None),
        11: ("all-rights-reserved", "own", None)}


def test_top_directory_repeats_and_empty(spark):
    got = scan(spark, [(1, "LICENSE", "Released under the MIT License."), (2, None, "plain"), (3, "a/b/c", "plain"), (3, "a/b/c", "plain")])
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT"}
    assert scan(spark, []) == {}


def test_license_scan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "MIT License")], "doc_id long, path string, text string")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"])
def test_cosine_against_brute_force(spark, name):
    import math
    import re
    from collections import Counter
    docs = [(1, "a", f"Some text. Licensed under the {name} License, version 3"), (2, "b", "unrelated words"), (3, "c", "the License under which")]
    df = spark.createDataFrame(docs, "doc_id long, path string, text string")
    own = {r["doc_id"]: r for r in licenses.own_licenses(df, threshold=0.05).collect()}
    token = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
    words = lambda t: Counter(token.findall(t.lower()))
    vocabulary = {w for _, _, w, _ in licenses.template_words()}
    idf = lambda w: math.log(4 / (1 + (w in vocabulary and sum(w in words(t) for _, _, t in docs)))) + 1
    vector = lambda t: {w: n * idf(w) for w, n in words(t).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    parts = [docs[0][2], "Some text.", f"Licensed under the {name} License, version 3"]
    best = max(sum(x * vector(p).get(w, 0) for w, x in vector(t).items()) / length(vector(t)) / length(vector(p))
               for _, t in licenses.TEMPLATES for p in parts[2:] + parts[:1])
    assert own[1]["cosine"] == pytest.approx(best, abs=2e-6)


def test_statements_without_usual_words(spark):
    rnd = random.Random(3)
    filler = [(100 + i, f"f/{i}", " ".join(f"w{rnd.randrange(500)}" for _ in range(30)) + " under the license of this work") for i in range(300)]
    rows = [(1, "a/x", "Released under MIT"), (2, "b/x", "This work is under the GNU General Public, version 3"),
            (3, "c/LICENSE", "This is free and unencumbered software"), (4, "c/d/x", "nothing"), (5, "e/x", "Released by somebody")]
    got = scan(spark, rows + filler)
    assert {i: (r["license"], r["origin"]) for i, r in got.items() if i < 100} == {
        1: ("MIT", "own"), 2: ("GPL-3.0", "own"), 3: ("Unlicense", "own"), 4: ("Unlicense", "inherited"), 5: (None, None)}


def test_templates_of_the_caller_need_no_usual_words(spark):
    own = (("Beer", "Buy the author a beer in return"), ("Ask", "Ask first"))
    got = scan(spark, [(1, "a/x", "w1 w2\nBuy the author a beer\nw3"), (2, "b/x", "ask first"), (3, "c/x", "the author in a")], templates=own)
    assert {i: r["license"] for i, r in got.items()} == {1: "Beer", 2: "Ask", 3: None}


def test_needed_words_lose_no_passage():
    rnd = random.Random(9)
    for threshold in (0.05, 0.5, 0.7, 0.95):
        words = [f"w{i}" for i in range(12)]
        idf = {w: 1 + rnd.random() * 6 for w in words}
        vector = {w: rnd.randrange(1, 3) for w in rnd.sample(words, 8)}
        needed = set(licenses.needed_words([(0, "x", w, tf) for w, tf in vector.items()], idf, threshold))
        # the best passage without a needed word is the template cut down to its other words
        norm = sum((tf * idf[w]) ** 2 for w, tf in vector.items())
        rest = sum((tf * idf[w]) ** 2 for w, tf in vector.items() if w not in needed)
        assert (rest / norm) ** 0.5 < threshold
