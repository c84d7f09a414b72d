"""Intermediate tables in the folder that driver and executors share, and row numbers over sorted rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only on a local master (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(sc, "_emberlog_root"):
        sc._emberlog_root = tempfile.mkdtemp(prefix="emberlog-")
    return sc._emberlog_root


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    The files outlive lost executors; they are deleted by `forget`, or when the driver's Python ends.  The shuffles that
    made them aren't needed again, so Spark may drop these at once.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of staged frames that no later plan reads."""
    for df in frames:
        delete(df.sparkSession, df._staged_at)


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; cleaning up is best effort
        pass


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """`df` with the place of each row in `order` (first: `start`), staged.

    Rows are dealt out by ranges of the order and numbered within each; a range's rows are counted, and only these
    counts (one for each partition) meet in one place.  Equal rows of the order get numbers in any order.
    """
    part, at, before = (f"__{x}_{name}" for x in ("part", "at", "before"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of Spark's growing id count the rows of a partition.
    rows = staged(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy(part).agg(F.count("*").alias(before))
    ends = counts.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    return rows.join(F.broadcast(ends), part).withColumn(name, F.col(before) + F.col(at) + start).drop(part, at, before)
