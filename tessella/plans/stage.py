"""Cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and everything runs in one process, as in tests, a
    temporary folder is made. A cluster without the setting is an error: each
    executor would write to its own disk.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder with master {master}")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="tessella-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        there = "file://" + _own["dir"]
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    That cuts lineage: what follows survives the loss of executors without
    computing df again, and plans get the true size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes stages that no later result reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            delete(df.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Size on disk of a stage, for the decision to broadcast it."""
    p, fs = _hadoop(df.sparkSession, df._staged_path)
    return int(fs.getContentSummary(p).getLength())


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of value (a long) over the rows before, in the order of some columns that tell rows apart.

    Rows are range-sorted and staged with the number of their partition; sums of
    partitions are added up on their own, so that no window holds all rows.
    """
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each partition
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def as_of(points: DataFrame, marks: DataFrame, at: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """points with value: that of the last mark at or before their place ``at``, of the same ``by``; null before the first.

    No two marks stand on one place; points and marks have the columns by and at. Both
    are range-sorted together and staged with the number of their partition; what a
    partition begins with is carried over from the ones before, so that neither a group
    nor the whole is one task's.
    """
    key = [*by, at]
    rows = points.withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_is_mark", F.lit(False))
    rows = rows.unionByName(marks.select(*key, F.col(value).alias("_mark"), F.lit(True).alias("_is_mark")), allowMissingColumns=True)
    dealt = staged(rows.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()), "as-of")
    order = [F.asc(c) for c in key]
    place = F.struct(*key)
    last = dealt.where("_is_mark").groupBy("_part").agg(F.max_by(F.struct(*by, "_mark"), place).alias("_last"))
    parts = dealt.select("_part").distinct().join(last, "_part", "left")  # a row for each partition
    carried = parts.select("_part", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = Window.partitionBy("_part", *by).orderBy(*order[len(by):], F.desc("_is_mark")).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.last("_mark", ignorenulls=True).over(within)).where(~F.col("_is_mark")).join(F.broadcast(carried), "_part")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_carried.{c}"))
    return found.select(*points.columns, F.coalesce("_own", F.when(same, F.col("_carried._mark"))).alias(value))
