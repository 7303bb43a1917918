"""Heap graphs kept as Parquet tables, and pulled together again; formats and readers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import collapsed, hprof, pprof

#: Tables of a kept heap graph; those after the first three may be absent.
TABLES = ["objects", "refs", "roots", "class_objects", "classes", "class_fields", "dominators"]


def save(tables: dict[str, DataFrame], path: str, codec: str = "zstd") -> list[str]:
    """Write a heap's tables under path, a folder each; the names written. Dictionaries of names are Parquet's own."""
    missing = [n for n in TABLES[:3] if n not in tables]
    if missing:
        raise ValueError(f"a heap graph needs {', '.join(missing)}")
    names = [n for n in TABLES if n in tables]
    for name in names:
        tables[name].write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    return names


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that save() wrote under path, whatever their compression."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = {f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory()}
    if not set(TABLES[:3]) <= folders:
        raise ValueError(f"no heap graph under {path}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in TABLES if n in folders}


#: Tables kept for look-ups: each is a table of the graph, or of sizes, by one of its ids.
BY_ID = {"objects": ("objects", "obj_id"), "sizes": ("sizes", "obj_id"), "refs_from": ("refs", "from_id"), "refs_to": ("refs", "to_id"), "roots": ("roots", "obj_id")}


def bucket_of(obj_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(obj_id.cast("long")), F.lit(buckets)).cast("int")


def save_lookups(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Write the tables of BY_ID that are there under path, for Lookups: a folder a bucket of ids, sorted by id, with Bloom filters.

    References are kept in both directions. A bucket is written by as many tasks as a range sort over (bucket, ids)
    gives it, so an object that a third of all references lead to is no one task's. References are stored first, as
    they are looked at four times: by two sorts, each of which also looks where its ranges end.
    """
    tables = {**tables, "refs": stored(tables["refs"], "refs")} if "refs" in tables else tables
    for name, (table, key) in BY_ID.items():
        if table not in tables:
            continue
        rows = tables[table].withColumn("bucket", bucket_of(F.col(key), buckets))
        other = [c for c in ("from_id", "to_id") if c in rows.columns and c != key]
        tasks = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartitionByRange(tasks, "bucket", key, *other).sortWithinPartitions("bucket", key, *other)
        rows.write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/lookups-{buckets}/{name}")


class Lookups:
    """Tables that save_lookups() wrote: rows of one id, or of few, from the buckets that can hold them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().startswith("lookups-")]
        if len(found) != 1:
            raise ValueError(f"{len(found)} sets of look-ups under {path}")
        self.buckets = int(found[0].split("-")[1])
        self.tables = {n: spark.read.parquet(f"{path}/{found[0]}/{n}") for n in BY_ID if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{found[0]}/{n}"))}

    def of(self, name: str, obj_id: int) -> DataFrame:
        """A table's rows of one id."""
        key = BY_ID[name][1]
        return self.tables[name].where((F.col("bucket") == bucket_of(F.lit(obj_id), self.buckets)) & (F.col(key) == obj_id)).drop("bucket")

    def joined(self, rows: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
        """rows with a table's other columns by rows' id `key`; the buckets of few rows are told while the join runs."""
        own = BY_ID[name][1]
        table = self.tables[name].withColumnsRenamed({own: "__id", "bucket": "__bucket"})
        return rows.join(table, (bucket_of(F.col(key), self.buckets) == F.col("__bucket")) & (F.col(key) == F.col("__id")), how).drop("__id", "__bucket")


#: Readers by format; each takes (spark, path) and gives a table, or several by name. Add more.
READERS: dict[str, Callable] = {**dict.fromkeys(collapsed.FORMATS, collapsed.read), "pprof": pprof.read, "hprof": hprof.read, "graph": load}


def read(spark: SparkSession, path: str, kind: str, **options):
    """Profiles or a heap in one of the READERS' formats."""
    name = kind.strip().lower()
    if name not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, path, **options)
