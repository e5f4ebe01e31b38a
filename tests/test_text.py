import random
import unicodedata

from pyspark.sql import functions as F

from quillgraph.functions import text as T, vocab as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_whitespace_follows_python(spark):
    samples = ["\x1c a　b \x85", "  x y ", "\t\n", "", "a  b\x0b\x0cc", "\xa0q\x1f"]
    df = spark.createDataFrame([(s,) for s in samples], "x string").select(
        "x", T.strip("x").alias("s"), T.collapse_ws("x").alias("c"), T.split_lines("x").alias("l"))
    for r in df.collect():
        assert r["s"] == r["x"].strip()
        assert r["c"] == " ".join(r["x"].split())
        assert r["l"] == r["x"].splitlines()


def test_fixed_and_round_follow_python(spark):
    rnd = random.Random(5)
    values = [rnd.randrange(0, 10**9) / 1000 for _ in range(500)] + [0.05, 0.15, 0.25, 2.675, 167554.85, 0.0, 5e-4]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", T.fixed("x", 1).alias("a"), T.fixed("x", 2).alias("b"), T.py_round("x", 3).alias("c"))
    for r in df.collect():
        assert r["a"] == f"{r['x']:.1f}" and r["b"] == f"{r['x']:.2f}" and r["c"] == round(r["x"], 3)


def test_normalize_heading(spark):
    samples = ["快速⼊ ⻔", "⻆度 ①", "ﬁne Ａ", "plain text", "㬵 水", "a 中 文 b", "Å ½ ㍿"]
    fix = str.maketrans("⻆⻔㬵", "角门胶")
    import re
    for s in samples:
        want = unicodedata.normalize("NFKC", s).translate(fix)
        want = re.sub(r"(?<=[一-鿿㐀-䶿])[ \t]+(?=[一-鿿㐀-䶿])", "", want)
        assert one(spark, s, T.normalize_heading) == want


def test_terms_and_categories(spark):
    assert one(spark, "  The API  of 配置文件 a ", T.query_terms) == ["the api of 配置文件 a", "the", "api", "of", "配置文件"]
    assert one(spark, "The API a 配置", T.rank_terms) == ["the", "api", "配置"]
    assert one(spark, ["abc", "x"], T.char_bigrams, "array<string>") == ["ab", "bc"]
    assert one(spark, "the capital", T.heuristic_category) == "tech_manual"     # holds "api"
    assert one(spark, "请假审批", T.heuristic_category) == "business_sop"
    assert one(spark, "hello", T.heuristic_category) == "general"
    assert one(spark, "它怎么用", T.is_followup) is True


def test_small_helpers(spark):
    assert one(spark, "a/b/My file (1).md", T.safe_label) == "a_b_my_file__1_.md".replace("__", "_")[:36]
    assert one(spark, "x/.hidden", T.stem) == ".hidden"
    assert one(spark, "x/a.b.md", T.stem) == "a.b"
    assert one(spark, 65.9, T.mm_ss, "double") == "01:05"
    assert one(spark, None, T.mm_ss, "double") == "--"
    assert one(spark, "x" * 20, lambda c: T.truncate(c, 16)) == "x" * 16 + "..."
    assert one(spark, "ab  cd", lambda c: T.preview(c, 4)) == "ab c..."
    assert one(spark, "Heading path: a > b\n\nbody", T.strip_legacy_prefix) == "body"
    assert one(spark, 'say {"a": 1} ok', lambda c: T.first_json_object(c, "a int"))["a"] == 1
    assert one(spark, "say {broken", lambda c: T.first_json_object(c, "a int")) is None
    assert one(spark, "```json\n{}\n```", T.unfenced) == "{}"
    assert one(spark, -0.25, T.asr_confidence, "double") == 0.75


def test_highlight(spark):
    df = spark.createDataFrame([("A <b> & API api.v2", "api, v2"), ("x", "")], "t string, q string")
    got = [r[0] for r in df.select(T.highlight(F.col("t"), F.col("q"))).collect()]
    assert got == ["A &lt;b&gt; &amp; <mark>API</mark> <mark>api</mark>.<mark>v2</mark>", "x"]


def test_levenshtein(spark):
    pairs = [("kitten", "sitting", 3), ("config", "cnfig", 1), ("abc", "", 3), ("", "", 0), ("工控机IP", "工控IP", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert df.filter(F.levenshtein("a", "b") != F.col("d")).count() == 0
