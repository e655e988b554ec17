"""The shared folder, and cutting lineage with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may lack the setting."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set, and a cluster has no other shared folder")
    return "file:///tmp/checkpoints/pulseframe"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, so that a lost executor costs
    only its own tasks. The file goes when the application ends; the shuffle files that the write made go at once, as no other
    plan can use them. They are known by their numbers; where another thread's jobs run meanwhile, its numbers can't be told from
    ours, so all are left to Spark's own cleaner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    df.write.parquet(path)
    last = context.newShuffleId()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if context.cleaner().isDefined() and not list(context.statusTracker().getActiveJobIds()):
        for shuffle in range(first + 1, last):
            context.cleaner().get().doCleanupShuffle(shuffle, True)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut wrote and that no plan needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
