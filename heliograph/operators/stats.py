"""Top functions, threads and thread groups of samples; every result is keyed by profile_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.values import percent


def top(df: DataFrame, by: list[str], order: list[Column], n: int | None, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; all if n is None or not positive. Spark keeps n rows a task before it shuffles."""
    if n is None or n <= 0:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if rank else df
    name = rank or "__rank"
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return df if rank else df.drop(name)


def totals(samples: DataFrame, idle: Callable[[str], Column] = fn.is_idle) -> DataFrame:
    """profile_id, total_samples, idle_samples, busy_samples."""
    spare = F.sum(F.when(idle("thread_name"), F.col("value")).otherwise(0))
    return samples.groupBy("profile_id").agg(F.sum("value").alias("total_samples"), spare.alias("idle_samples")).withColumn("busy_samples", F.col("total_samples") - F.col("idle_samples"))


def self_by_function(samples: DataFrame, include_idle: bool = False) -> DataFrame:
    """profile_id, func, self, self_pct: samples by leaf; the share is of the same samples' total."""
    rows = samples if include_idle else samples.where(~fn.is_idle("thread_name"))
    rows = rows.where(F.size("stack") > 0).groupBy("profile_id", fn.leaf("stack").alias("func")).agg(F.sum("value").alias("self"))
    whole = totals(samples).select("profile_id", (F.col("total_samples") if include_idle else F.col("busy_samples")).alias("total"))
    # One row a profile: of a bounded size only if profiles are few, so Spark chooses the join.
    return rows.join(whole, "profile_id").select("profile_id", "func", "self", percent("self", "total").alias("self_pct"))


def top_functions(samples: DataFrame, n: int = 15, include_idle: bool = False) -> DataFrame:
    return top(self_by_function(samples, include_idle), ["profile_id"], [F.desc("self"), F.asc("func")], n, "rank")


def stacks_by_function(samples: DataFrame, n: int | None = 5, include_idle: bool = False) -> DataFrame:
    """profile_id, func, stack, samples, distinct_stacks: the n most frequent stacks of each leaf."""
    rows = samples if include_idle else samples.where(~fn.is_idle("thread_name"))
    rows = rows.where(F.size("stack") > 0).groupBy("profile_id", fn.leaf("stack").alias("func"), fn.stack_to_string("stack").alias("stack")).agg(F.sum("value").alias("samples"))
    many = rows.groupBy("profile_id", "func").agg(F.count("*").alias("distinct_stacks"))
    best = top(rows, ["profile_id", "func"], [F.desc("samples"), F.asc("stack")], n, "rank")
    return best.join(many, ["profile_id", "func"])


def threads(samples: DataFrame) -> DataFrame:
    """profile_id, tid, thread_name (of the first sample), samples, pct of all samples, idle ones included."""
    rows = samples.groupBy("profile_id", "tid").agg(F.min_by("thread_name", "sample_id").alias("thread_name"), F.sum("value").alias("samples"))
    whole = totals(samples).select("profile_id", F.col("total_samples").alias("total"))
    return rows.join(whole, "profile_id").select("profile_id", "tid", "thread_name", "samples", percent("samples", "total").alias("pct"))


def top_threads(samples: DataFrame, n: int | None = None) -> DataFrame:
    return top(threads(samples), ["profile_id"], [F.desc("samples"), F.asc("tid")], n, "rank")


def thread_summary(samples: DataFrame, thread_is_frame: bool = False) -> DataFrame:
    """profile_id, total_threads, active_threads, unique_functions, max_depth; the functions' rows are never gathered."""
    by = samples.groupBy("profile_id", "tid").agg(F.sum("value").alias("v"), F.max(F.size("stack")).alias("depth"))
    by = by.groupBy("profile_id").agg(F.count("*").alias("total_threads"), F.count(F.when(F.col("v") > 0, 1)).alias("active_threads"), (F.max("depth") + int(thread_is_frame)).cast("long").alias("max_depth"))
    distinct = samples.select("profile_id", F.explode("stack").alias("f")).distinct().groupBy("profile_id").agg(F.count("*").alias("unique_functions"))
    return by.join(distinct, "profile_id", "left").select("profile_id", "total_threads", "active_threads", F.coalesce("unique_functions", F.lit(0)).alias("unique_functions"), "max_depth")


def thread_groups(samples: DataFrame) -> DataFrame:
    """profile_id, thread_group, threads, samples, pct of the samples that aren't idle, top_thread."""
    rows = threads(samples.where(~fn.is_idle_in_graphs("thread_name")))
    rows = rows.groupBy("profile_id", fn.thread_group("thread_name").alias("thread_group")).agg(
        F.count("*").alias("threads"), F.sum("samples").alias("samples"), F.max_by("thread_name", F.struct("samples", "thread_name")).alias("top_thread")
    )
    whole = totals(samples, fn.is_idle_in_graphs).select("profile_id", F.col("busy_samples").alias("total"))
    return rows.join(whole, "profile_id").select("profile_id", "thread_group", "threads", "samples", percent("samples", "total").alias("pct"), "top_thread")


def filter_threads(rows: DataFrame, idle: bool = False, min_samples: int = 0, min_pct: float = 0.0, group: str | None = None, tids: list[int] | None = None, name: str | None = None) -> DataFrame:
    """Rows of threads() that pass every condition given."""
    keep = (F.col("samples") >= min_samples) & (F.col("pct") >= min_pct)
    if not idle:
        keep = keep & ~fn.is_idle_in_graphs("thread_name")
    if group:
        keep = keep & (fn.thread_group("thread_name") == group)
    if tids:
        keep = keep & F.col("tid").isin(tids)
    if name:
        keep = keep & fn.contains_ignoring_case("thread_name", name)
    return rows.where(keep)


def functions_by_thread(samples: DataFrame, n: int = 15) -> DataFrame:
    """profile_id, tid, func, samples, pct of the thread's samples: the n leading leaves of each thread."""
    rows = samples.where(F.size("stack") > 0).groupBy("profile_id", "tid", fn.leaf("stack").alias("func")).agg(F.sum("value").alias("samples"))
    whole = samples.groupBy("profile_id", "tid").agg(F.sum("value").alias("total"))
    rows = top(rows, ["profile_id", "tid"], [F.desc("samples"), F.asc("func")], n, "rank")
    return rows.join(whole, ["profile_id", "tid"]).select("profile_id", "tid", "func", "samples", percent("samples", "total").alias("pct"), "rank")


def stacks_by_thread(samples: DataFrame, n: int = 200) -> DataFrame:
    rows = samples.where(F.size("stack") > 0).groupBy("profile_id", "tid", fn.stack_to_string("stack").alias("stack")).agg(F.sum("value").alias("samples"))
    return top(rows, ["profile_id", "tid"], [F.desc("samples"), F.asc("stack")], n, "rank")


def function_threads(samples: DataFrame) -> DataFrame:
    """profile_id, func, tid, samples: how each leaf's samples spread over threads."""
    return samples.where((F.size("stack") > 0) & ~fn.is_idle_in_graphs("thread_name")).groupBy("profile_id", fn.leaf("stack").alias("func"), "tid").agg(F.sum("value").alias("samples"))


def group_summaries(samples: DataFrame) -> DataFrame:
    """profile_id, thread_group, threads, samples, pct, top_thread, rank: groups of threads() over all samples, largest first.

    As thread_groups(), but the share is of all samples of the profile, idle ones included.
    """
    rows = threads(samples.where(~fn.is_idle_in_graphs("thread_name"))).groupBy("profile_id", fn.thread_group("thread_name").alias("thread_group")).agg(
        F.count("*").alias("threads"), F.sum("samples").alias("samples"), F.max_by("thread_name", F.struct("samples", "thread_name")).alias("top_thread")
    )
    whole = totals(samples, fn.is_idle_in_graphs).select("profile_id", F.col("total_samples").alias("total"))
    rows = rows.join(whole, "profile_id").select("profile_id", "thread_group", "threads", "samples", percent("samples", "total").alias("pct"), "top_thread")
    return top(rows, ["profile_id"], [F.desc("samples"), F.asc("thread_group")], None, "rank")


def functions_in_detail(samples: DataFrame, n: int = 50, stacks: int = 10) -> DataFrame:
    """profile_id, func, self, self_pct, rank, threads (tid, samples), stacks (stack, samples): top functions with where they stand.

    Threads are all of the function's, largest first; a function has as many entries as threads run it.
    """
    lead = top_functions(samples, n)
    own = lead.select("profile_id", "func")
    by_thread = function_threads(samples).join(own, ["profile_id", "func"], "left_semi")
    entry = F.array_sort(F.collect_list(F.struct((-F.col("samples")).alias("order"), "tid", "samples")))
    by_thread = by_thread.groupBy("profile_id", "func").agg(F.transform(entry, lambda x: F.struct(x["tid"].alias("tid"), x["samples"].alias("samples"))).alias("threads"))
    some = stacks_by_function(samples, stacks).join(own, ["profile_id", "func"], "left_semi")
    entry = F.array_sort(F.collect_list(F.struct("rank", "stack", "samples")))
    some = some.groupBy("profile_id", "func").agg(F.transform(entry, lambda x: F.struct(x["stack"].alias("stack"), x["samples"].alias("samples"))).alias("stacks"))
    return lead.join(by_thread, ["profile_id", "func"], "left").join(some, ["profile_id", "func"], "left")


def with_others(rows: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """name, value of the n largest rows and the sum of the rest as `Others`."""
    ranked = rows.select(name, value).withColumn("__r", F.row_number().over(Window.orderBy(F.desc(value), F.asc(name))))
    # The n largest are found task by task; the rest is a sum, so no ranking of all rows takes place.
    best = ranked.where(F.col("__r") <= n).drop("__r")
    whole = rows.agg(F.sum(value).alias("all"), F.count("*").alias("many"))
    rest = best.agg(F.coalesce(F.sum(value), F.lit(0)).alias("some"), F.count("*").alias("few")).crossJoin(whole).where("many > few")  # one row each
    return best.unionByName(rest.select(F.lit("Others").alias(name), (F.col("all") - F.col("some")).alias(value)))


def search(rows: DataFrame, columns: list[str], part: str, order: str, n: int | None = None) -> DataFrame:
    """Rows any of whose columns holds the part, whatever its case, largest `order` first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(fn.contains_ignoring_case(c, part), F.lit(False))
    found = rows.where(hit).orderBy(F.desc(order), *columns)
    return found.limit(n) if n else found


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page of a sorted table, numbers from 1; order has to be total."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
