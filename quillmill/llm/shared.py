"""What the operators of this subpackage have in common: the shared folder, cut lineages, sizes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.shared import spread


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint
    folder exists and all of Spark is this process (tests), a folder of this machine is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        context = spark.sparkContext
        named = context.getCheckpointDir() or ""
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
            named = context.getCheckpointDir()
    return (named if "://" in named or named.startswith("file:") else f"file://{named}").rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file where their number is known.
FILE_ROWS = 200_000


def materialize(df: DataFrame, name: str, rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as a table into the shared folder and read it from there.

    ``rows``: about how many narrow rows there can be; then they are dealt anew to no more files than they
    fill, as many small files are slow to write and to list.
    """
    path = fresh_dir(df.sparkSession, name)
    if rows is not None:
        df = df.repartition(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    relieve(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no result reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Give back what finished jobs, whose tables are written, have left: Spark deletes their shuffle files and broadcasts once
    the driver's collector has run, and it runs late: old plans fill the heap first. Operators of many jobs call this between them.
    Python's collector goes first, as a frame in a cycle holds its plan in the JVM."""
    gc.collect()
    spark._jvm.System.gc()


#: Part of the driver's largest heap that it may take from the machine before it is asked to give some back.
TAKEN = 0.5


def relieve(spark: SparkSession) -> None:
    """:func:`release` where the driver's heap has grown; a heap that is seldom collected takes all it may, whatever it needs."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > TAKEN * runtime.maxMemory():
        release(spark)


#: A key of more than this part of all rows is heavy, so there are fewer heavy keys than its inverse.
HEAVY = 2000


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, total: int | None = None) -> DataFrame:
    """Inner join with a table of one row a key, of which ``n_col`` tells how many rows of ``left`` have the key, ``total`` in all.

    The at most ``HEAVY`` keys of the most rows meet their rows where those lie, the others by a shuffle in which
    no key has more than that part of all rows. ``n_col`` goes.
    """
    if total is None:
        total = right.agg(F.sum(n_col)).first()[0] or 0
    mine = [c for c in right.columns if c not in keys and c != n_col]
    heavy, light = (right.where(c).drop(n_col) for c in (F.col(n_col) * HEAVY >= total, F.col(n_col) * HEAVY < total))
    tagged = left.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    near = tagged.where("__heavy").drop("__heavy")
    return near.unionByName(tagged.where("__heavy is null").drop("__heavy", *mine).join(light, keys))


def free_name(df: DataFrame, name: str) -> str:
    """A name for a further column that no column of ``df`` has, whatever its case."""
    used = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in used:
        name += "_"
    return name


#: Whole texts can be long, so batches between the JVM and Python hold few rows.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches on both sides; sets a limit of the session where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one too small to have a split for every core is dealt to all."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
