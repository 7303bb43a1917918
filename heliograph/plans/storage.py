"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master that names none, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again, so that a loop's plan stays short; deleted with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to as many parts as Spark shuffles to; joins and groups on key, or on more than it, shuffle it no further."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept(df: DataFrame, key: str, deal: bool = True) -> DataFrame:
    """df dealt by key and kept on the executors' disks, so that a loop's joins on it shuffle their other side alone.

    Parts that are lost with an executor are made again. unpersist() it when what was made of it is stored. Without
    deal df is of one or several dealt() by key already.
    """
    return (dealt(df, key) if deal else df).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
