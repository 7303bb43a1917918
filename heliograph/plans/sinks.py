"""Results as files: JSON lines or one JSON text a profile, summaries by kind of result, and files of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, flamegraph

#: Codecs of text and Parquet files by name.
CODECS = {"none": "none", "gzip": "gzip", "zstd": "zstd"}
#: How files of a codec begin, in hexadecimal.
MAGIC = {"1F8B": "gzip", "28B52FFD": "zstd"}


def codec_of(content: Column | str) -> Column:
    """gzip or zstd by a file's first bytes, else none."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 4))
    out = None
    for magic, name in MAGIC.items():
        out = (F if out is None else out).when(head.startswith(magic), name)
    return out.otherwise("none")


def write_json(rows: DataFrame, path: str, codec: str = "gzip", by: list[str] = (), mode: str = "overwrite") -> None:
    """rows as JSON lines under path, written by tasks; `by` gives a folder for each value."""
    writer = rows.write.mode(mode).option("compression", CODECS[codec])
    (writer.partitionBy(*by) if by else writer).json(path)


def write_documents(documents: DataFrame, path: str, codec: str = "gzip", key: str = "profile_id", mode: str = "overwrite") -> None:
    """Each document (key, document) as one JSON text in the folder key=value under path."""
    rows = documents.select(key, F.col("document").alias("value"))
    rows.write.mode(mode).partitionBy(key).option("compression", CODECS[codec]).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents under path with the key of their folder; compression is told by the files' names."""
    return spark.read.text(path).withColumnRenamed("value", "document")


def write_flame(nodes: DataFrame, path: str, min_percent: float = 0.1, codec: str = "gzip") -> None:
    write_documents(flamegraph.documents(flamegraph.prune(nodes, min_percent)), path, codec)


def write_folded(nodes: DataFrame, path: str, codec: str = "none") -> None:
    """Folded lines of each profile, in a folder of its own."""
    flamegraph.folded(nodes).withColumnRenamed("line", "value").write.mode("overwrite").partitionBy("profile_id").option("compression", CODECS[codec]).text(path)


def write_call_graph(points: DataFrame, links: DataFrame, path: str, min_node: float = 0.5, min_edge: float = 0.1, codec: str = "gzip") -> None:
    write_documents(callgraph.documents(*callgraph.prune(points, links, min_node, min_edge)), path, codec)


def write_dot(points: DataFrame, links: DataFrame, path: str) -> None:
    """A Graphviz text of one profile's graph, lines in order; prune first, as one task writes it."""
    lines = callgraph.dot_lines(points, links).orderBy("ord", "line").select("line")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_heap(results: dict[str, DataFrame], path: str, codec: str = "gzip") -> list[str]:
    """A heap's results (histogram, biggest objects, roots, retainers, ...) as JSON lines, a folder each; the folders."""
    for name, rows in results.items():
        write_json(rows, f"{path}/{name}", codec)
    return sorted(results)


def write_leaks(reports: DataFrame, profiles: DataFrame, path: str, codec: str = "gzip") -> None:
    """Leak reports by kind, and the profiles that they compare."""
    write_json(reports, f"{path}/reports", codec, ["kind"])
    write_json(profiles.select("profile_id", "profile_type", "captured_at").distinct(), f"{path}/profiles", codec)


def fields(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """A formatter that gives the columns that are there as one JSON text a row, in the order named."""

    def run(rows: DataFrame) -> DataFrame:
        kept = [c for c in columns if c in rows.columns]
        keys = [c for c in ("profile_id",) if c in rows.columns]
        return rows.select(*keys, F.to_json(F.struct(*(kept or rows.columns))).alias("summary"))

    return run


#: Formatters by kind of result; rows of a kind without one are given whole. Add more.
FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "functions": fields("rank", "func", "self", "self_pct", "flat", "cum", "flat_pct", "cum_pct"),
    "threads": fields("tid", "thread_name", "samples", "pct"),
    "histogram": fields("class_name", "instances", "total_size", "pct", "retained"),
    "leaks": fields("kind", "severity", "growth", "growth_pct", "per_minute"),
}


def summary(rows: DataFrame, kind: str) -> DataFrame:
    """rows as (profile_id,) summary, by the kind's formatter."""
    return FORMATTERS.get(kind, fields())(rows)


def results_upsert(results: DataFrame, new: DataFrame, key: str = "tid") -> DataFrame:
    """results with new's rows in place of those of the same key; of equal keys in new the greatest version counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), "version").alias("__r")).select("__r.*")
    return results.join(last.select(key), key, "left_anti").select(*results.columns).unionByName(last.select(*results.columns))


def results_updated(results: DataFrame, new: DataFrame, key: str = "tid") -> DataFrame:
    """results_upsert() that raises where new names a key that results lacks."""
    if not new.join(results, key, "left_anti").isEmpty():
        raise ValueError("an update names a result that doesn't exist")
    return results_upsert(results, new, key)


def suggestions_kept(suggestions: DataFrame) -> DataFrame:
    """Suggestions that say something."""
    return suggestions.where(F.trim(F.coalesce("suggestion", F.lit(""))) != "")


class Store:
    """Files under a root that Hadoop can open: local, HDFS, or an object store whose connector is there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def url(self, key: str) -> str:
        if ".." in key.split("/"):
            raise ValueError("a key can't leave its store")
        return f"{self.root}/{key.lstrip('/')}"

    def _fs(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.url(key))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, key: str) -> bool:
        fs, path = self._fs(key)
        return fs.exists(path)

    def delete(self, key: str) -> bool:
        """Whether there was such a file or folder."""
        fs, path = self._fs(key)
        return fs.delete(path, True)

    def get(self, key: str) -> DataFrame:
        """path, modificationTime, length, content of the file, or of the files of a folder."""
        return self.spark.read.format("binaryFile").load(self.url(key))

    def put(self, source: str, key: str) -> str:
        """Copy a file that Hadoop can open into the store; its url."""
        fs, path = self._fs(key)
        origin = self.spark._jvm.org.apache.hadoop.fs.Path(source)
        configuration = self.spark._jsc.hadoopConfiguration()
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(origin.getFileSystem(configuration), origin, fs, path, False, True, configuration)
        return self.url(key)
