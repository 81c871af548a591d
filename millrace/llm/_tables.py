"""Intermediate tables in the shared folder, which lost executors don't take with them."""

from __future__ import annotations

import pickle
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spark's own setting: a finished query's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if the session is a single process, as in tests; on a
    cluster an error, since executors would each write to their own disk."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, and the shuffle files behind it are freed.

    The tables of an application are deleted when its driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    home = f"{shared_folder(spark)}/tables-{sc.applicationId}"
    path = f"{home}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
    at = sc._jvm.org.apache.hadoop.fs.Path(home)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: object) -> Broadcast:
    """value for all executors, classes of this package included: workers read it with `received` and need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt out by ranges of an order, with `rank`, each row's place in that order from 0 on; written once.

    Rows are numbered within their partition, and partitions by the rows of those before them: one small row a partition. Equal
    keys meet in one partition, so an order that may have many of them should end in a tie-break. df is read twice, since ranges are
    sampled first; give it saved if it is dear to make."""
    spot = F.monotonically_increasing_id()
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot))
    parts = placed.groupBy(F.shiftright("_spot", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_spot").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = saved(parts.withColumn("_shift", before - F.col("_first")).select("_part", "_shift"))
    return placed.join(F.broadcast(parts), F.shiftright("_spot", 33) == F.col("_part")).withColumn("rank", F.col("_spot") + F.col("_shift")).drop("_spot", "_part", "_shift")
