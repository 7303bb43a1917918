"""Results of micro-batches, saved so that a repeated batch changes nothing and readers see whole batches only.

A store is a folder: `data/<table>/batch=<number>` holds what a batch wrote, `commits/<number>.json` says that all of
its tables are whole. A batch whose record is there is left alone; one without is written again from the start.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMIT = "batch long, tables array<string>, written_ms long"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, root: str, batch: int) -> bool:
    fs, at = _path(spark, f"{root}/commits/{batch}.json")
    return fs.exists(at)


def commit(spark: SparkSession, root: str, batch: int, tables: list[str]) -> None:
    """Write the batch's record. It takes its name in one step, so it is there whole or not at all."""
    fs, name = _path(spark, f"{root}/commits/{batch}.json")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/_{batch}-{time.time_ns()}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"batch": batch, "tables": sorted(tables), "written_ms": time.time_ns() // 1_000_000}).encode()))
    out.close()
    if not fs.rename(made, name) and not fs.exists(name):
        raise OSError(f"batch {batch} can't be committed")


def save(tables: dict[str, DataFrame], root: str, batch: int) -> bool:
    """Write all tables of a batch, then its record; False, and nothing is written, if the batch is committed already.

    Of a batch that failed before its record, whatever it left is replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, root, batch):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/data/{name}/batch={batch}")
    commit(spark, root, batch, list(tables))
    return True


def commits(spark: SparkSession, root: str) -> DataFrame:
    """batch, tables, written_ms of the committed batches; none of a store that isn't there yet."""
    fs, at = _path(spark, f"{root}/commits")
    if not fs.exists(at):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{root}/commits")


def load(spark: SparkSession, root: str, table: str, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a table in committed batches, with their batch; with keys only the last batch's of each key.

    Rows of a batch that isn't committed are never seen. A table that no batch has written is empty.
    """
    fs, at = _path(spark, f"{root}/data/{table}")
    if not fs.exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/data/{table}").parquet(f"{root}/data/{table}")
    rows = rows.join(commits(spark, root).select("batch").distinct(), "batch", "left_semi").select(*rows.columns)
    if not keys:
        return rows
    last = F.max("batch").over(Window.partitionBy(*keys))
    return rows.withColumn("__last", last).where("batch = __last").drop("__last")
