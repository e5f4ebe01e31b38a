import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators use for themselves or return.
CLASHING = ("size", "kept", "label", "node", "band", "bucket", "removed", "_size", "_row", "_doc", "_id", "_set", "path2")


@pytest.fixture(scope="session")
def make(spark):
    """docs from (doc_id, text) or (doc_id, text, source) rows."""
    def build(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clashing:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
        return df
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null and empty text, a long text, repeated rows, ties, odd white space and characters."""
    words = [f"word{i % 977} x{i % 13}" for i in range(40_000)]
    return [(1, None), (2, ""), (3, " \t\r\n\x0b "), (None, "no id here but words enough"), (4, " ".join(words)),
            (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "ONE two three four five six seven"),
            (7, "É é ﬁ 　x ​ 𝒳\nsecond line\n\nsecond line"), (8, "a"), (9, "a b"), (10, "x" * 5000), (11, "!!! ### $$$ |")]
