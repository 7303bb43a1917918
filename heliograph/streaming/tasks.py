"""The analysis queue: pending tasks, admission by priority, status, roll-up to master tasks; see intake for its streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.values import is_high_priority
from ..operators import advisor
from ..plans import saved

COMPLETED, PENDING, FAILED = 2, 0, 3
#: What analysed() saves of each batch.
SAVED = {"results": "tid string, func string, self_pct double", "suggestions": "tid string, master_tid string, rule string, func string, value double", "status": "tid string, master_tid string, analysis_status int"}


def pending(tasks: DataFrame, n: int = 10) -> DataFrame:
    """Completed recordings that no analysis has begun on, newest first."""
    return tasks.where((F.col("status") == COMPLETED) & (F.col("analysis_status") == PENDING)).orderBy(F.desc("id")).limit(n)


def admit(batch: DataFrame, workers: int = 5, reserved: int = 2) -> DataFrame:
    """The batch's tasks that find a worker: short ones any free one, others none of the reserved.

    Only as many tasks as there are workers are ranked: each Spark task keeps its first ones.
    """
    rows = batch.withColumn("high", is_high_priority("duration")).orderBy(F.desc("high"), F.desc("id")).limit(workers)
    rows = rows.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("high"), F.desc("id"))))
    return rows.where(F.col("slot") <= F.when(F.col("high"), workers).otherwise(workers - reserved))


def incomplete(tasks: DataFrame) -> DataFrame:
    """master_tid, incomplete: sub-tasks that are neither analysed nor failed."""
    return tasks.where((F.col("analysis_status") <= 1) & (F.col("status") != 3)).groupBy("master_tid").agg(F.count("*").alias("incomplete"))


def master_status(tasks: DataFrame) -> DataFrame:
    """master_tid, sub_tasks, complete."""
    open_ = F.count(F.when((F.col("analysis_status") <= 1) & (F.col("status") != 3), 1))
    return tasks.groupBy("master_tid").agg(F.count("*").alias("sub_tasks"), (open_ == 0).alias("complete"))


def with_suggestions(masters: DataFrame, tasks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """masters (master_tid, groups) with a group of suggestions for each analysed sub-task that has any, and `complete`.

    groups is array<struct<tid, items array<struct<func, suggestion>>>>, ordered by tid; a sub-task's new group takes
    its old one's place. suggestions is (tid, func, suggestion); empty ones are left out.
    """
    said = suggestions.where(F.trim(F.coalesce("suggestion", F.lit(""))) != "").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("func", "suggestion"))).alias("items"))
    new = tasks.where(F.col("analysis_status") == COMPLETED).select("master_tid", "tid").join(said, "tid").select("master_tid", F.struct("tid", "items").alias("g"), F.lit(1).alias("order"))
    old = masters.select("master_tid", F.explode("groups").alias("g"), F.lit(0).alias("order"))
    last = old.unionByName(new).groupBy("master_tid", F.col("g.tid").alias("tid")).agg(F.max_by("g", "order").alias("g"))
    groups = last.groupBy("master_tid").agg(F.array_sort(F.collect_list("g")).alias("__groups"))
    rows = masters.join(groups, "master_tid", "left").join(master_status(tasks).select("master_tid", F.col("complete").alias("__complete")), "master_tid", "left")
    return rows.withColumn("groups", F.coalesce("__groups", "groups")).withColumn("complete", F.coalesce("__complete", F.lit(False))).drop("__groups", "__complete")


def with_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """tasks with the latest of updates (tid, analysis_status, seq); raises if an update names no task."""
    last = updates.groupBy("tid").agg(F.max_by("analysis_status", "seq").alias("__new"))
    lost = last.join(tasks, "tid", "left_anti")
    if not lost.isEmpty():
        raise ValueError("an update names a task that doesn't exist")
    return tasks.join(last, "tid", "left").withColumn("analysis_status", F.coalesce("__new", "analysis_status")).drop("__new")


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, workers: int = 5, reserved: int = 2, waiting: str | None = None) -> DataStreamWriter:
    """A writer that hands each micro-batch's admitted tasks to handle(); pending ones that find no worker go to `waiting`.

    A folder of waiting tasks that is also an intake offers them again, so none stays behind. Tasks that aren't
    pending, as they failed or were analysed before, are done with. Spark repeats a batch after a failure: handle has
    to be idempotent by batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        ready = batch.where((F.col("status") == COMPLETED) & (F.col("analysis_status") == PENDING))
        admitted = admit(ready, workers, reserved)
        handle(admitted, number)
        if waiting:
            rest = ready.join(admitted.select("id"), "id", "left_anti").drop("source")
            if not rest.isEmpty():
                rest.write.mode("overwrite").json(f"{waiting}/batch-{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def analysed(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], rules: Callable[[], DataFrame], root: str, checkpoint: str) -> DataStreamWriter:
    """A writer that analyses each micro-batch's pending tasks and saves results, suggestions and status to the store `root`.

    analyse(tasks) gives (tid, func, self_pct); rules() is called for every batch, so a rule that was added, changed
    or deleted since holds from the next batch on. A task without a result row failed. All three tables of a batch
    become visible together, once; a batch that Spark repeats changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        if saved.committed(batch.sparkSession, root, number):
            return
        ready = batch.where((F.col("status") == COMPLETED) & (F.col("analysis_status") == PENDING)).select("tid", "master_tid").distinct()
        results = analyse(ready).select("tid", "func", "self_pct").persist()
        try:
            suggestions = advisor.by_rule_table(results, rules(), "tid").join(ready, "tid").select("tid", "master_tid", "rule", "func", "value")
            done = results.select("tid", F.lit(True).alias("done")).distinct()
            status = ready.join(done, "tid", "left").select("tid", "master_tid", F.when(F.col("done"), COMPLETED).otherwise(FAILED).alias("analysis_status"))
            saved.save({"results": results, "suggestions": suggestions, "status": status}, root, number)
        finally:
            results.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def of_store(spark, root: str, table: str) -> DataFrame:
    """A table of analysed()'s store, of committed batches; of tasks analysed again the last batch's rows."""
    return saved.load(spark, root, table, SAVED[table], ("tid",))
