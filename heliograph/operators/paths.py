"""Ways from the roots of a heap to its objects, with the fields they go over; the largest objects with all of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import kept, stored
from .heap import biggest_objects
from .stats import top
from .trees import TABLES, few, renamed


#: One of so many objects as a target is enough to build all paths from the roots down.
MANY = 4


def shortest_ways(refs: DataFrame, roots: DataFrame, per_node: int = 3) -> DataFrame:
    """obj_id, way, level, by, by_way, field: the per_node first shortest ways to every object that a root reaches.

    Way k of an object ends with a reference from `by`, over `field`, the least of several, after that one's way
    by_way; a root has one way, of level 0. Ways are ordered by the last referrer's id, then by its own ways. The graph
    is made once, a join a level over links that are dealt by referrer once; rows have no arrays, and an object has
    per_node rows at most.
    """
    links = kept(refs.groupBy("from_id", "to_id").agg(F.min("field").alias("field")), "from_id")
    start = roots.select("obj_id").distinct()
    none = F.lit(None).cast("long")
    level = stored(start.select("obj_id", F.lit(0).alias("way"), F.lit(0).alias("level"), none.alias("by"), F.lit(None).cast("int").alias("by_way"), F.lit(None).cast("string").alias("field")), "ways")
    found, depth = level, 0
    while True:
        depth += 1
        onward = links.join(renamed(level, from_id="obj_id", by_way="way"), "from_id").join(renamed(found, to_id="obj_id").distinct(), "to_id", "left_anti")
        # Of an object's referrers each task passes on per_node ways.
        first = top(onward, ["to_id"], [F.asc("from_id"), F.asc("by_way")], per_node, "way")
        level = first.select(F.col("to_id").alias("obj_id"), (F.col("way") - 1).cast("int").alias("way"), F.lit(depth).alias("level"), F.col("from_id").alias("by"), "by_way", "field")
        level = stored(level, "ways")
        if level.isEmpty():
            links.unpersist()
            return found
        found = found.unionByName(level)
        found = found if depth % TABLES else stored(found, "ways")


def leading_to(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The refs that lie on ways to the targets (obj_id): to them, and to whatever refers to them directly or not."""
    front = seen = stored(targets.select("obj_id").distinct(), "above")
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        step = refs.join(few(renamed(front, to_id="obj_id")), "to_id", "left_semi").select(F.col("from_id").alias("obj_id")).distinct()
        front = stored(step.join(seen, "obj_id", "left_anti"), "above")
        seen = seen.unionByName(front)
        seen = seen if rounds % TABLES else stored(seen, "above")
    return refs.join(few(renamed(seen, to_id="obj_id")), "to_id", "left_semi")


def ways_to(refs: DataFrame, roots: DataFrame, targets: DataFrame, per_node: int = 3) -> DataFrame:
    """shortest_ways() of the targets (obj_id) and of all on their ways: for few targets, as other objects are left alone."""
    return shortest_ways(leading_to(refs, targets), roots, per_node)


def root_paths(ways: DataFrame, objects: DataFrame, targets: DataFrame) -> DataFrame:
    """target, rank (from 1), length, path of the targets (obj_id): path is array<obj_id, class_name, field>, root first.

    A step's field is what the step before refers to it by, null for the root. Targets that no root reaches have no
    row. ways is shortest_ways(); it is read once a level up from the targets, or, where one of MANY objects is a
    target, once in all.
    """
    if targets.count() * MANY >= objects.count():
        return _paths_of_all(ways, objects, targets)
    step = renamed(ways, node="obj_id", node_way="way", level="level", by="by", by_way="by_way", field="field")
    own = stored(targets.select(F.col("obj_id").alias("target")).distinct(), "targets")
    at = step.join(renamed(own, node="target"), "node").select(F.col("node").alias("target"), (F.col("node_way") + 1).alias("rank"), "node", "level", "by", "by_way", "field")
    at = stored(at, "steps")
    found, rounds = at, 0
    while not (up := at.where("by is not null")).isEmpty():
        rounds += 1
        further = up.select("target", "rank", F.col("by").alias("node"), F.col("by_way").alias("node_way"))
        at = stored(further.join(step, ["node", "node_way"]).select(*found.columns), "steps")
        found = found.unionByName(at)
        found = found if rounds % TABLES else stored(found, "steps")
    named = found.join(renamed(objects, node="obj_id", class_name="class_name"), "node", "left")
    steps = F.array_sort(F.collect_list(F.struct("level", F.col("node").alias("obj_id"), "class_name", "field")))
    rows = named.groupBy("target", "rank").agg(steps.alias("steps"))
    return rows.select("target", "rank", F.size("steps").alias("length"), F.transform("steps", lambda s: F.struct(s["obj_id"].alias("obj_id"), s["class_name"].alias("class_name"), s["field"].alias("field"))).alias("path"))


def _paths_of_all(ways: DataFrame, objects: DataFrame, targets: DataFrame) -> DataFrame:
    """root_paths() from the roots down: a way's path is that of the way that it goes on from, and its own last step."""
    # Which ways are asked for is told before they have paths, so that no path is shuffled for it.
    wanted = targets.select("obj_id", F.lit(True).alias("wanted")).distinct()
    named = ways.join(renamed(objects, obj_id="obj_id", class_name="class_name"), "obj_id", "left").join(wanted, "obj_id", "left")
    last = F.array(F.struct("obj_id", "class_name", "field"))
    named = stored(named.select("obj_id", "way", "level", "by", "by_way", last.alias("last"), "wanted"), "steps")
    front = found = stored(named.where("level = 0").select("obj_id", "way", F.col("last").alias("path"), "wanted"), "paths")
    depth = 0
    while not front.isEmpty():
        depth += 1
        before = renamed(front, by="obj_id", by_way="way", path="path")
        front = stored(named.where(F.col("level") == depth).join(before, ["by", "by_way"]).select("obj_id", "way", F.concat("path", "last").alias("path"), "wanted"), "paths")
        found = found.unionByName(front)
        found = found if depth % TABLES else stored(found, "paths")
    return found.where("wanted").select(F.col("obj_id").alias("target"), (F.col("way") + 1).alias("rank"), F.size("path").alias("length"), "path")


def described(big: DataFrame, refs: DataFrame, sizes: DataFrame, ways: DataFrame, fields: int = 50) -> DataFrame:
    """big (obj_id, ...) with fields (array<name, to_id, class_name, retained>, largest first) and path, its first way from a root.

    The first `fields` references of an object by name and target are looked at. Objects without references have an
    empty array. big is few: it is stored, and only its references are read.
    """
    some = stored(big, "big")
    held = refs.join(renamed(some, from_id="obj_id"), "from_id", "left_semi").select("from_id", F.col("field").alias("name"), "to_id").distinct()
    held = top(held, ["from_id"], [F.asc("name"), F.asc("to_id")], fields)
    held = held.join(renamed(sizes, to_id="obj_id", class_name="class_name", retained="retained"), "to_id")
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("retained")).alias("less"), "name", "to_id", "class_name", "retained")))
    held = held.groupBy(F.col("from_id").alias("obj_id")).agg(by_size.alias("__fields"))
    shape = F.transform("__fields", lambda f: F.struct(*(f[c].alias(c) for c in ("name", "to_id", "class_name", "retained"))))
    way = root_paths(ways, sizes, some).where("rank = 1").select(F.col("target").alias("obj_id"), "path")
    rows = some.join(held, "obj_id", "left").join(way, "obj_id", "left")
    empty = F.array().cast("array<struct<name:string,to_id:bigint,class_name:string,retained:bigint>>")
    return rows.select(*big.columns, F.coalesce(shape, empty).alias("fields"), "path")


def biggest_described(sizes: DataFrame, refs: DataFrame, roots: DataFrame, n: int = 100, by: str = "retained", fields: int = 50) -> DataFrame:
    """biggest_objects() with their fields and a path from a root."""
    big = biggest_objects(sizes, n, by)
    return described(big, refs, sizes, ways_to(refs, roots, big, 1), fields)
