"""What a reader of results asks for: artifacts of an analysis, one heap's objects and roots, tasks, leak reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.values import analysis_status_name, format_bytes, format_time, is_high_priority, resource_type, task_type_name
from ..operators import flamegraph, heap, leaks, retainers, stats
from ..sources import collapsed
from ..sources.graphs import Lookups
from .sinks import read_documents

#: Where the flame document of each kind of profile lies under a task's folder: the first that is there counts.
FLAME_FOLDERS: dict[str, list[str]] = {
    "cpu": ["flame_documents", "cpu.flame_documents"], "alloc": ["flame_documents", "alloc.flame_documents"], **{k: [f"{k}.flame_documents", "flame_documents"] for k in ("heap", "goroutine", "block", "mutex", "pprof-cpu", "tracing")},
}


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def flame_document(spark: SparkSession, folder: str, kind: str = "cpu", min_percent: float = 0.1, collapsed_text: str | None = None) -> DataFrame:
    """profile_id, document of a kind's flame graph under a task's folder; for CPU, else made from its collapsed text."""
    for name in FLAME_FOLDERS.get(kind, []):
        if _is_there(spark, f"{folder}/{name}"):
            return read_documents(spark, f"{folder}/{name}")
    if kind == "cpu" and collapsed_text and _is_there(spark, collapsed_text):
        return flamegraph.documents(flamegraph.prune(flamegraph.roll_up(collapsed.read(spark, collapsed_text)), min_percent))
    raise FileNotFoundError(f"no {kind} flame graph under {folder}")


def artifact(spark: SparkSession, folder: str, name: str, kind: str | None = None) -> DataFrame:
    """One result that modes.run() wrote under folder; kind tells those of several profiles apart."""
    return spark.read.json(f"{folder}/{kind}.{name}" if kind else f"{folder}/{name}")


def retainers_of(spark: SparkSession, folder: str, class_name: str | None = None) -> DataFrame:
    rows = artifact(spark, folder, "retainers")
    return retainers.ordered(rows if class_name is None else rows.where(F.col("target_class") == class_name))


def biggest(spark: SparkSession, folder: str, class_name: str | None = None, sort: str = "idea", n: int = 100) -> DataFrame:
    """Biggest objects of a written heap analysis, of one class if it is named, by retained, idea or shallow size."""
    if sort not in ("retained", "idea", "shallow"):
        raise ValueError(f"no size called {sort}")
    rows = artifact(spark, folder, "biggest")
    return (rows if class_name is None else rows.where(F.col("class_name") == class_name)).orderBy(F.desc(sort), "obj_id").limit(n)


def object_info(objects: DataFrame, sizes: DataFrame, roots: DataFrame, obj_id: int | str) -> DataFrame:
    """One object: obj_id, hex, class_name, shallow, retained, retained_text, root_type; the id as a number or 0x text."""
    number = fn.parse_object_id(F.lit(str(obj_id))) if isinstance(obj_id, str) else F.lit(obj_id)
    one = objects.where(F.col("obj_id") == number).select("obj_id", "class_name", "shallow").limit(1)
    rows = one.join(sizes.select("obj_id", "retained"), "obj_id", "left").join(roots.groupBy("obj_id").agg(F.min("root_type").alias("root_type")), "obj_id", "left")
    return rows.select("obj_id", fn.hex_address("obj_id").alias("hex"), "class_name", "shallow", "retained", format_bytes("retained").alias("retained_text"), "root_type")


def heap_views(tables: dict[str, DataFrame], sizes: DataFrame) -> dict[str, Callable[..., DataFrame]]:
    """Questions about one heap by name, each a function of its own arguments."""
    objects, refs, roots = tables["objects"], tables["refs"], tables["roots"]
    return {
        "info": lambda obj_id: object_info(objects, sizes, roots, obj_id),
        "fields": lambda obj_id: heap.object_fields(objects, refs, tables["classes"], tables["class_fields"], sizes, obj_id),
        "gc-roots": lambda obj_id, n=3, depth=15: heap.paths_to_roots(refs, roots, objects.where(F.col("obj_id") == obj_id), depth, n),
        "gc-roots-summary": lambda: heap.roots_by_class(roots, sizes).orderBy(F.desc("retained"), "class_name"),
        "gc-roots-list": lambda n=50: retainers.roots_by_size(roots, sizes, n),
        "gc-root-retained": lambda obj_id, n=50: heap.held_by(refs, sizes, obj_id, n),
        "retainers": lambda obj_id, n=20: heap.holders_of(refs, objects, obj_id, n),
        "biggest-by-class": lambda class_name, n=50: heap.biggest_objects(sizes, n, class_name=class_name),
    }


def kept_views(kept: Lookups) -> dict[str, Callable[..., DataFrame]]:
    """heap_views()'s questions about one object of a kept graph with sizes: they read the buckets of its id, not the heap."""

    def info(obj_id: int) -> DataFrame:
        return object_info(kept.of("objects", obj_id), kept.of("sizes", obj_id), kept.of("roots", obj_id), obj_id)

    def held_by(obj_id: int, n: int = 50) -> DataFrame:
        first = kept.of("refs_from", obj_id).orderBy("field", "to_id").limit(n).select("field", "to_id")
        return kept.joined(first, "to_id", "sizes").select("field", "to_id", "class_name", "shallow", "retained").orderBy(F.desc("retained"), "to_id")

    def holders_of(obj_id: int, n: int = 20) -> DataFrame:
        first = kept.of("refs_to", obj_id).orderBy("from_id", "field").limit(n).select("from_id", "field")
        return kept.joined(first, "from_id", "objects").select("from_id", "class_name", "field", "shallow")

    return {"info": info, "gc-root-retained": held_by, "retainers": holders_of}


def task_list(tasks: DataFrame, n: int = 100) -> DataFrame:
    """tid, type, resource, status, priority, changed of the n tasks that changed last (column modified)."""
    rows = tasks.orderBy(F.desc("modified"), F.desc("id")).limit(n)
    return rows.select("tid", task_type_name("type").alias("type"), resource_type("type").alias("resource"), analysis_status_name("analysis_status").alias("status"), is_high_priority("duration").alias("priority"), format_time("modified").alias("changed"))


def latest_task(tasks: DataFrame, by: str = "master_tid") -> DataFrame:
    """The task that changed last of each master: (by), tid."""
    return tasks.groupBy(by).agg(F.max_by("tid", F.struct("modified", "id")).alias("tid"))


#: Tables of a task store, and the column that names a row of each.
LOOKUPS = {"task": "tid", "result": "tid", "suggestion": "tid", "master": "master_tid"}


def look_up(rows: DataFrame, kind: str, key: str | int) -> DataFrame:
    """Rows of a kind by their name; tasks also by id. Deleted rows (column deleted) are left out."""
    if kind not in LOOKUPS:
        raise ValueError(f"no such table: {kind}")
    found = rows.where(F.col("id" if isinstance(key, int) else LOOKUPS[kind]) == key)
    return found.where("deleted is null") if "deleted" in rows.columns else found


def sub_tasks(masters: DataFrame, tasks: DataFrame) -> DataFrame:
    """masters (master_tid, ...) with the tasks under them: tid, status, analysis_status."""
    return masters.join(tasks.select("master_tid", "tid", "status", "analysis_status"), "master_tid")


def leak_report(reports: DataFrame, kind: str | None = None) -> DataFrame:
    return leaks.of_kind(reports, kind).orderBy(F.desc("growth"), "kind")


def found_in_analysis(functions: DataFrame, threads: DataFrame, part: str, n: int = 50) -> DataFrame:
    """kind, profile_id, name, samples: functions and threads whose name holds the part, most samples first."""
    rows = functions.select(F.lit("function").alias("kind"), "profile_id", F.col("func").alias("name"), F.col("self").alias("samples"))
    return stats.search(rows.unionByName(threads.select(F.lit("thread").alias("kind"), "profile_id", F.col("thread_name").alias("name"), "samples")), ["name"], part, "samples", n)


def columns_of(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that rows has, in their order; unknown names are left out."""
    return rows.select(*[c for c in wanted if c in rows.columns])
