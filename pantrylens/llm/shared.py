"""Folders, checkpoints and arithmetic that several operators use."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine that names none (as in tests) gets one made here."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="pantrylens-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Folders that new_path has named, in order.
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _named.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def release(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more, and let the JVM drop the shuffles of what is done."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _named:
            _named.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), stored; the folders that it wrote on the way are deleted."""
    before = len(_named)
    out = stored(make(), name)
    release(spark, *_named[before:-1])
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n: the folds of labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def running_sums(df: DataFrame, groups: list[str], order: list[str], value: str) -> DataFrame:
    """df with `before` (sum of value over earlier rows of the group) and `total` (of the group).

    df has a column `fine`, an integer below 65536 that ascends with `order`
    and spreads a group's rows evenly.  Sums are hierarchical - rows in a fine
    range, fine ranges in a coarse one, coarse ones in the group - so a group
    that holds most rows is spread over many tasks.
    """
    earlier = lambda keys, by: F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = groups or [F.lit(0)]
    fine = df.groupBy(*groups, "fine").agg(F.sum(value).alias(value)).withColumn("coarse", F.shiftright("fine", 8))
    coarse = fine.groupBy(*groups, "coarse").agg(F.sum(value).alias(value))
    coarse = coarse.select(*groups, "coarse", earlier(top, ["coarse"]).alias("b1"), F.sum(value).over(W.partitionBy(*top)).alias("total"))
    fine = fine.select(*groups, "coarse", "fine", earlier([*groups, "coarse"], ["fine"]).alias("b2"))
    ranges = fine.join(coarse, [*groups, "coarse"]).select(*groups, "fine", "total", (F.col("b1") + F.col("b2")).alias("b1"))
    rows = df.join(ranges, [*groups, "fine"])
    return rows.withColumn("before", F.col("b1") + earlier([*groups, "fine"], order)).drop("b1")
