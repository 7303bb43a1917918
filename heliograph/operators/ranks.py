"""Places of rows within groups of any size: a range sort over all groups, and counts of what its tasks have of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored


def ranked(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """rows with pos, the place within the group (from 0), and n, the group's rows. order has to tell all rows apart.

    No group is gathered: a group of a third of all rows is sorted by a third of the tasks.
    """
    keys = [F.col(g) for g in groups]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    table = stored(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranked")
    # A row for each group and task that meet: about as many as there are groups and tasks.
    counts = table.groupBy(*groups, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__part").alias("__task"), F.sum("__rows").over(whole).alias("n"), (F.col("__first") - before).alias("__shift"))
    here = F.col("__part") == F.col("__task")
    for g in groups:
        here = here & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return table.join(counts, here).select(*rows.columns, (F.col("__at") - F.col("__shift")).alias("pos"), "n")
