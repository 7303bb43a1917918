"""Flame graphs as flat tables of path prefixes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.values import percent


def roll_up(samples: DataFrame, by_thread: bool = False, thread_frame: bool = False) -> DataFrame:
    """profile_id, (tid,) path, depth, name, value, self of every prefix of every stack, and the root of depth 0.

    Equal stacks are summed before they are exploded, so rows follow distinct stacks, not samples. Stacks that are
    empty count at the root. With by_thread each thread has a tree of its own and values of 0 or less are left out.
    """
    keys = ["profile_id", "tid"] if by_thread else ["profile_id"]
    stack = F.concat(F.array("thread_name"), "stack") if thread_frame else F.col("stack")
    rows = samples.where("value > 0") if by_thread else samples
    whole = rows.select(*keys, stack.alias("stack"), "value").groupBy(*keys, "stack").agg(F.sum("value").alias("value"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("stack")), lambda i: F.struct(F.slice("stack", F.lit(1), i).alias("path"), (i == F.size("stack")).alias("last")))
    nodes = whole.select(*keys, "value", F.explode(prefixes).alias("p")).groupBy(*keys, "p.path").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("p.last"), F.col("value")).otherwise(0)).alias("self"))
    return nodes.select(*keys, "path", F.size("path").alias("depth"), F.when(F.size("path") > 0, fn.leaf("path")).otherwise("root").alias("name"), "value", "self")


def prune(nodes: DataFrame, min_percent: float, keys: list[str] = ("profile_id",)) -> DataFrame:
    """Nodes of at least int(root * min_percent / 100), and the root.

    A parent's value is at least each child's, so one comparison with the root's value prunes whole subtrees.
    """
    if min_percent <= 0:
        return nodes
    root = nodes.where("depth = 0").select(*keys, F.floor(F.col("value") * min_percent / 100).alias("__least"))
    return nodes.join(root, list(keys)).where((F.col("depth") == 0) | (F.col("value") >= F.col("__least"))).drop("__least")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """profile_id, total, nodes, distinct_names, max_depth."""
    return nodes.groupBy("profile_id").agg(
        F.max(F.when(F.col("depth") == 0, F.col("value"))).alias("total"), F.count(F.when(F.col("depth") > 0, 1)).alias("nodes"), F.countDistinct(F.when(F.col("depth") > 0, F.col("name"))).alias("distinct_names"), F.max("depth").alias("max_depth")
    )


def search(nodes: DataFrame, part: str) -> DataFrame:
    """Nodes whose name, with or without its allocation mark, holds the part."""
    return nodes.where((F.col("depth") > 0) & (fn.contains_ignoring_case("name", part) | fn.contains_ignoring_case(fn.without_allocation_mark("name"), part)))


def without_functions(samples: DataFrame, filters: list[str]) -> DataFrame:
    """Samples whose stacks leave out system functions, for a roll-up; their callees move up to the next frame kept."""
    return samples.withColumn("stack", F.filter("stack", lambda x: ~fn.is_system_function(x, filters)))


def folded(nodes: DataFrame) -> DataFrame:
    """Lines `path value` of the leaves, as folded writers print them: inner nodes' own time isn't in them."""
    parents = nodes.where("depth > 0").select("profile_id", F.slice("path", F.lit(1), F.col("depth") - 1).alias("path")).distinct()
    leaves = nodes.where("depth > 0").join(parents, ["profile_id", "path"], "left_anti")
    return leaves.select("profile_id", F.concat_ws(" ", F.concat_ws(";", "path"), F.col("value").cast("string")).alias("line"))


def global_top(samples: DataFrame, n: int = 50) -> DataFrame:
    """profile_id, func, samples, pct, threads, rank: leading leaves, idle threads left out."""
    from .stats import top, totals

    busy = samples.where(~fn.is_idle_in_graphs("thread_name") & (F.size("stack") > 0))
    rows = busy.groupBy("profile_id", fn.leaf("stack").alias("func")).agg(F.sum("value").alias("samples"), F.countDistinct("tid").alias("threads"))
    rows = top(rows, ["profile_id"], [F.desc("samples"), F.asc("func")], n, "rank")
    whole = totals(samples, fn.is_idle_in_graphs).select("profile_id", F.col("busy_samples").alias("total"))
    return rows.join(whole, "profile_id").select("profile_id", "func", "samples", percent("samples", "total").alias("pct"), "threads", "rank")


def merged(nodes: DataFrame, name: str = "all") -> DataFrame:
    """One tree of all profiles' trees: each profile's root, named by profile_id, stands under a root of their sum."""
    under = nodes.select(F.lit(name).alias("profile_id"), F.concat(F.array("profile_id"), "path").alias("path"), "name", "value", "self", F.col("profile_id").alias("__p"))
    rows = under.select("profile_id", "path", F.size("path").alias("depth"), F.when(F.size("path") == 1, F.col("__p")).otherwise(F.col("name")).alias("name"), "value", "self")
    whole = nodes.where("depth = 0").agg(F.sum("value").alias("value")).where("value is not null")
    root = whole.select(F.lit(name).alias("profile_id"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.lit(name).alias("name"), "value", F.lit(0).cast("bigint").alias("self"))
    return rows.unionByName(root)


def documents(nodes: DataFrame, keys: list[str] = ("profile_id",)) -> DataFrame:
    """keys and document: each tree as one JSON text of nested {name, value, self, children}, children largest first.

    Built from the deepest level up, a grouped job a level, so a subtree is one row and never passes through the
    driver. A document is as large as its tree: prune() first.
    """
    from ..plans.storage import stored

    keys = list(keys)
    rows = stored(nodes.select(*keys, "path", "depth", "name", "value", "self"), "nodes")
    deepest = rows.agg(F.max("depth")).head()[0]
    if deepest is None:
        return rows.select(*keys, F.lit("").alias("document"))
    inner = F.to_json(F.struct("name", "value", "self"))
    done = None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("children", F.lit(""))
        else:
            order = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "name", "text")))
            above = done.groupBy(*keys, F.slice("path", F.lit(1), F.lit(depth)).alias("path")).agg(F.array_join(F.transform(order, lambda x: x["text"]), ",").alias("children"))
            level = level.join(above, [*keys, "path"], "left").withColumn("children", F.coalesce("children", F.lit("")))
        text = F.concat(F.substring(inner, F.lit(1), F.length(inner) - 1), F.lit(',"children":['), "children", F.lit("]}"))
        done = stored(level.select(*keys, "path", "name", "value", text.alias("text")), "level")
    return done.select(*keys, F.col("text").alias("document"))


def nested(nodes: DataFrame, profile_id: str) -> dict:
    """One profile's document as nested dictionaries; prune() first, as the driver holds it."""
    row = documents(nodes.where(F.col("profile_id") == profile_id)).head()
    return json.loads(row.document) if row else {}
