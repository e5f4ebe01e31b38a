"""Order-dependent steps that stay balanced when one group is huge.

A window partitioned by a hot key would put the whole group into one task.  The
helpers here range-partition by (group, order) instead, so a group is spread over
as many tasks as its size needs, and stitch partitions with one small table that
has at most a row per partition.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillgraph.session import local_work_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only a local session may do without: there the folder of ``local_work_folder`` is used.  A cluster that
    names none is an error, since executors could not read each other's tables.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or local_work_folder())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, on the storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it back.

    Survives executor loss, keeps iterative plans short, fixes range boundaries and row order once,
    and gives the next plan true sizes, so that Spark itself decides which sides are small.
    ``release`` removes the table once no later plan reads it.  ``reader`` is the session that reads, if it is another one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    back = (reader or spark).read.schema(df.schema).parquet(path)
    back._scratch = path
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(back)
    return back


def release(*frames: DataFrame) -> None:
    """Remove the tables of ``cut_lineage`` behind these frames."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_open = threading.local()


class temporary_tables:  # noqa: N801
    """The tables that ``cut_lineage`` writes inside this block, by this thread, are removed at its end.

    ``keep`` leaves a table to the block around this one, or to the caller.  What the block hands on must be kept or written elsewhere.
    """

    def __enter__(self) -> temporary_tables:
        if not hasattr(_open, "scopes"):
            _open.scopes = []
        _open.scopes.append([])
        self._kept: list[DataFrame] = []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df)
        return df

    def __exit__(self, *exc) -> None:
        made = _open.scopes.pop()
        kept = {df._scratch for df in self._kept}
        release(*(df for df in made if df._scratch not in kept))
        if _open.scopes:
            _open.scopes[-1].extend(df for df in made if df._scratch in kept)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the key columns come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def position_in_group(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "pos",
                      weight: str | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its group; a null key is a group like any other.

    With ``weight`` a row stands for that many places, and gets the first of them.

    ``keys`` + ``order`` should identify a row.  Rows are range-partitioned, numbered inside each
    partition, and shifted by the number of rows of the same group in earlier partitions.  Only
    the first group of a partition can have such rows, so the shift table has a row per partition at most.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_cols).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    numbered = tagged.withColumn(name, F.row_number().over(local) - 1 if weight is None else F.sum(weight).over(
        local.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tagged.groupBy("_pid", *keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")).withColumn(
        "_shift", F.sum("_n").over(before)).filter("_shift > 0").drop("_n")
    return join_null_safe(numbered, shifts, ["_pid", *keys], "left").withColumn(
        name, (F.col(name) + F.coalesce(F.col("_shift"), F.lit(0))).cast("bigint")).drop("_pid", "_shift")


def with_previous(df: DataFrame, keys: list[str], pos: str, n: int, fields: list[str], name: str,
                  bucket: int = 4096) -> DataFrame:
    """Add an array of the previous ``n`` rows (as structs, oldest first) of the same group.

    ``pos`` is the dense position in the group.  Groups are cut into buckets of ``bucket``
    positions, and the last ``n`` rows of a bucket are copied into the next one, so no task
    ever sees more than one bucket of a group.
    """
    if n > bucket:
        raise ValueError("n must not exceed the bucket size")
    own = df.withColumn("_b", F.floor(F.col(pos) / bucket)).withColumn("_halo", F.lit(False))
    copies = own.filter(F.col(pos) % bucket >= bucket - n).withColumn("_b", F.col("_b") + 1).withColumn(
        "_halo", F.lit(True))
    w = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(-n, -1)
    both = own.unionByName(copies)
    return both.withColumn(name, F.collect_list(F.struct(*fields)).over(w)).filter(~F.col("_halo")).drop(
        "_b", "_halo")


def last_marked_position(df: DataFrame, keys: list[str], pos: str, marked: Column, name: str,
                         bucket: int = 4096) -> DataFrame:
    """Add the position of the latest row at or before this one for which ``marked`` holds.

    Running maximum inside buckets of positions, plus the maximum of the earlier buckets of the
    group, which is taken from a table with one row per bucket.
    """
    rows = df.withColumn("_b", F.floor(F.col(pos) / bucket)).withColumn("_m", F.when(marked, F.col(pos)))
    upto = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_b").agg(F.max("_m").alias("_bm")).withColumn(
        "_carry", F.max("_bm").over(before)).drop("_bm")
    return join_null_safe(rows.withColumn("_in", F.max("_m").over(upto)), carried, [*keys, "_b"]).withColumn(
        name, F.coalesce("_in", "_carry")).drop("_b", "_m", "_in", "_carry")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join in which every group of ``big`` above ``hot_rows`` rows is salted.

    Only hot groups are salted: their rows get one of ceil(rows / hot_rows) salts and their rows
    of ``small`` are copied once per salt.  The list of hot groups has at most rows / hot_rows entries.
    """
    hot = big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(
        *keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    spread = big.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys]), one).cast("int")).drop("_salts")
    copied = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return spread.join(copied, [*keys, "_salt"]).drop("_salt")
