"""Cutting lineage in the folder that the cluster shares, and global orders without a single task."""

from __future__ import annotations

import atexit
import functools
import hashlib
import shutil
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a single machine names none, as in tests."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if got is None and sc._jsc.sc().getCheckpointDir().isDefined():
        got = sc._jsc.sc().getCheckpointDir().get()
    if got is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = _temporary()
    return got


@functools.cache
def _temporary() -> str:
    got = tempfile.mkdtemp(prefix="citelab-")
    atexit.register(shutil.rmtree, got, ignore_errors=True)
    return got


def cut(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint: computed once, and safe from lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Names, sizes and times of all files below some paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        out += sorted(found)
    return hashlib.sha256("\n".join(out).encode()).hexdigest()[:24]


def made_once(spark: SparkSession, name: str, inputs: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files `inputs`, written to the shared folder the first time that an application asks for it and
    read from there afterwards; files that have changed meanwhile give a new one."""
    path = f"{shared_folder(spark)}/citelab-{spark.sparkContext.applicationId}/{name}-{_state(spark, inputs)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def global_prefix(df: DataFrame, order: str, value: Column, out: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows that come before in `order` (a unique column).

    Rows are range-partitioned and summed within their partitions; only one number a partition is put together.
    """
    ordered = cut(df.orderBy(order).withColumns({"_v": value, "_m": F.monotonically_increasing_id()}).withColumn("_p", F.shiftright("_m", 33)))
    parts = ordered.groupBy("_p").agg(F.sum("_v").alias("_s"))
    offsets = parts.select("_p", (F.sum("_s").over(W.orderBy("_p")) - F.col("_s")).alias("_o"))  # as many rows as partitions
    own = F.sum("_v").over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_v")
    return ordered.withColumn("_w", own).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_w") + F.col("_o")).drop("_v", "_m", "_p", "_w", "_o")


def same(by: Sequence[str], a: str, b: str) -> Column:
    """Whether two aliased tables agree in some columns, nulls included."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def ranks(df: DataFrame, by: Sequence[str], order: str, out: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's place in its group by `order`, from 0 and nulls first, and the group's size.

    Rows are range-partitioned by group and order, equal ones at random, so a group of any size is dealt over
    partitions; a place is the one within a partition and what the group has in the partitions before."""
    by = list(by)
    rows = cut(df.orderBy(*by, order, F.rand(7)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    own = W.partitionBy(*by)  # a row for each group and partition
    parts = parts.withColumns({"_before": F.sum("_c").over(own.orderBy("_part")) - F.col("_c"), "_n": F.sum("_c").over(own)})
    j = rows.alias("a").join(parts.alias("b"), same(by, "a", "b") & (F.col("a._part") == F.col("b._part")))
    return j.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias(out), F.col("_n").alias(size))
