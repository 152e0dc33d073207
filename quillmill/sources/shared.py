"""The shared folder for tables on the way, small inputs dealt to all cores, and row numbers without one large window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used before, in the folder of ``spark.checkpoint.dir``; one of this machine only where all of Spark is this process."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer bytes than the least split for each core (often one row group, which is one task) is dealt to all cores.

    It costs a shuffle of so little; a larger table keeps its splits.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < least * cores else df


#: Bytes of a file that a task gets where rows are dealt anew.
SHARE = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A scan for costly work on each row: one of few bytes is :func:`spread`, and one whose largest task has more than twice a core's share is dealt to all cores.

    A file of one row group is one task however large it is. Rows of a task are counted by the files' footers; conditions on the rows
    stay behind the shuffle, as in front of it they would be tested in those few tasks.
    """
    small = spread(df)
    if small is not df:
        return small
    spark = df.sparkSession
    tasks = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    largest, rows = tasks.agg(F.max("n"), F.sum("n")).first()
    cores = spark.sparkContext.defaultParallelism
    if not rows or largest * cores <= 2 * rows:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(2 * cores, size // SHARE), F.xxhash64(*df.columns)).where(F.spark_partition_id() >= 0)


def ordinal(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with its rows numbered from 0 in an order, in column ``name``.

    Rows are dealt by ranges of the order and written; each range is numbered by itself behind the number of rows
    before it, so no task sees more than a range. Only a count for each range meets in one place. The borders of the ranges
    come from a pass of their own over the rows, which are written first so that they are not computed twice.
    """
    df = written(df, "rows")
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__range", before.alias("__before")))
    here = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(offsets, "__range").withColumn(name, (F.col("__before") + here).cast("int")).drop("__range", "__before")
