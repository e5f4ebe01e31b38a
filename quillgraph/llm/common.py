"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quillgraph.operators.ordering import scratch_path

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower_str(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_TO_LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: StructType | str,
             per_batch: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``per_batch`` to plain lists of the named columns, batch by batch, without a shuffle.

    Batches are Arrow record batches, whose rows and bytes Spark bounds, and pieces of at most ``STEP``
    rows are turned into Python objects at a time.
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = to_arrow(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                got = per_batch({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out_schema)


#: Rows of a batch that are Python objects at the same time.
STEP = 512


def to_arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def write_table(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write to the shared work folder and read back: the frame, and its path for ``drop_table``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables of ``write_table`` that no later plan reads."""
    for path in paths:
        if path is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based global position in ``order``, from range partitions and one count per partition."""
    parts, _ = write_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_local", local).join(shift, "_part").withColumn(
        name, (F.col("_local") + F.col("_shift")).cast("long")).drop("_part", "_local", "_shift")


def mix64(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values with good avalanche (shift, xor, multiply by odd constants)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Word -> stable 64-bit hash; a bounded memo, emptied when full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
