"""Heap graphs as tables: objects (obj_id, class_name, shallow), refs (from_id, to_id, field), roots (obj_id, root_type).

Graph walks are loops of joins, a level a job, written to the shared folder; no heap is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..functions.values import percent_scaled
from ..plans.storage import dealt, kept, stored
from . import bits, trees, walks
from .ranks import ranked
from .stats import top

SUPER_ROOT = trees.TOP


def distinct_refs(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """from_id, to_id of different pairs whose both ends are objects."""
    ids = lambda name: objects.select(F.col("obj_id").alias(name))
    return refs.select("from_id", "to_id").distinct().join(ids("from_id"), "from_id", "left_semi").join(ids("to_id"), "to_id", "left_semi")


def levels(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """obj_id, level: least number of references from a root; objects that no root reaches have no row."""
    links = kept(refs.select("from_id", "to_id"), "from_id")
    frontier = seen = stored(roots.select("obj_id").distinct().withColumn("level", F.lit(0)), "level")
    level = 0
    while True:
        level += 1
        step = links.join(frontier.select(F.col("obj_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("obj_id")).distinct()
        frontier = stored(step.join(seen.select("obj_id"), "obj_id", "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            links.unpersist()
            return seen
        seen = seen.unionByName(frontier)
        seen = seen if level % trees.TABLES else stored(seen, "level")


def dominators(refs: DataFrame, roots: DataFrame, keep: bool = True) -> DataFrame:
    """obj_id, idom of every object a root reaches: its immediate dominator, SUPER_ROOT above all roots.

    Rounds follow the logarithm of the dominator tree's depth for chains of single references; see trees. refs may have
    pairs repeatedly. Without keep they are kept by from_id already.
    """
    return trees.renamed(trees.dominator_tree(refs, roots, keep), obj_id="obj_id", idom="up")


def retained(objects: DataFrame, doms: DataFrame) -> DataFrame:
    """obj_id, class_name, shallow, idom, reachable, retained: what would go with the object; an unreachable one retains itself."""
    held = dealt(objects, "obj_id").join(dealt(doms.select("obj_id", "idom"), "obj_id"), "obj_id", "left").select("obj_id", "class_name", "shallow", "idom")
    held = kept(held, "obj_id", deal=False)
    inside = trees.subtree_sums(held.where("idom is not null").select("obj_id", F.col("idom").alias("up"), "shallow"), "shallow", keep=False)
    rows = held.join(inside, "obj_id", "left")
    return rows.select("obj_id", "class_name", "shallow", "idom", F.col("idom").isNotNull().alias("reachable"), F.coalesce("total", "shallow").alias("retained"))


def shared_through_arrays(refs: DataFrame, objects: DataFrame, sizes: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, field, child_retained: references to objects that the referrer doesn't dominate, though only arrays of collections share them.

    With few (from_id) those of a few objects: only references to what these refer to are looked at for arrays.
    """
    child = sizes.select(F.col("obj_id").alias("to_id"), "idom", F.col("retained").alias("child_retained"))
    pairs = refs.select("from_id", "to_id", "field")
    pairs = pairs if few is None else pairs.join(trees.few(few.select("from_id")), "from_id", "left_semi")
    pairs = pairs.join(child, "to_id").where(~F.col("idom").eqNullSafe(F.col("from_id")))
    inside = refs
    if few is not None:
        pairs = stored(pairs, "pairs")
        inside = refs.join(trees.few(pairs.select("to_id").distinct()), "to_id", "left_semi")
    arrays = objects.where("class_name = 'java.lang.Object[]'").select(F.col("obj_id").alias("array_id"))
    held = objects.where(classes.is_collection("class_name")).select(F.col("obj_id").alias("from_id"))
    owned = trees.renamed(refs.join(held, "from_id", "left_semi"), array_id="to_id").join(arrays, "array_id", "left_semi").distinct()
    through = trees.renamed(inside, array_id="from_id", to_id="to_id").distinct().join(owned, "array_id", "left_semi").groupBy("to_id").agg(F.count("*").alias("n"), F.min("array_id").alias("one"))
    return pairs.join(through, "to_id").where((F.col("n") > 1) | (F.col("one") != F.col("from_id"))).select("from_id", "to_id", "field", "child_retained")


def retained_with_collections(sizes: DataFrame, refs: DataFrame, deal: bool = True) -> DataFrame:
    """sizes with `idea`: a parent also gets children it doesn't dominate that an array of a collection holds.

    One level and no recursion: base sizes are added. sizes is retained()'s result, stored, or as it comes without deal.
    Sizes are dealt by object once, and references by what they refer to, however many looks at them there are; refs
    that are dealt by from_id before are shuffled for nothing else.
    """
    whole = kept(sizes, "obj_id", deal)
    links = refs.select("from_id", "to_id").distinct()
    held = links.join(trees.renamed(whole.where(classes.is_collection("class_name")), from_id="obj_id"), "from_id", "left_semi").select(F.col("to_id").alias("obj_id")).distinct()
    owned = stored(whole.where("class_name = 'java.lang.Object[]'").join(held, "obj_id", "left_semi").select(F.col("obj_id").alias("from_id"), F.lit(True).alias("owned")), "owned")
    into = kept(links.join(owned, "from_id", "left"), "to_id")
    through = into.where("owned").groupBy("to_id").agg(F.count("*").alias("n"), F.min("from_id").alias("one"))
    pairs = into.join(through, "to_id").where((F.col("n") > 1) | (F.col("one") != F.col("from_id"))).select("from_id", "to_id")
    child = whole.select(F.col("obj_id").alias("to_id"), "idom", F.col("retained").alias("child_retained"))
    more = pairs.join(child, "to_id").where(~F.col("idom").eqNullSafe(F.col("from_id"))).groupBy(F.col("from_id").alias("obj_id")).agg(F.sum("child_retained").alias("__more"))
    return whole.join(more, "obj_id", "left").withColumn("idea", F.col("retained") + F.coalesce("__more", F.lit(0))).drop("__more")


def histogram(objects: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """class_name, instances, total_size, avg_size, pct of all objects, or of those in reachable (obj_id)."""
    rows = objects if reachable is None else objects.join(reachable.select("obj_id"), "obj_id", "left_semi")
    by = rows.groupBy("class_name").agg(F.count("*").alias("instances"), F.sum("shallow").alias("total_size"))
    whole = by.agg(F.sum("total_size").alias("__all"))  # one row
    return by.crossJoin(F.broadcast(whole)).select("class_name", "instances", "total_size", (F.col("total_size") / F.col("instances")).alias("avg_size"), percent_scaled("total_size", "__all").alias("pct"))


def top_classes(histogram_rows: DataFrame, n: int = 50) -> DataFrame:
    rows = histogram_rows.orderBy(F.desc("total_size"), "class_name")
    return rows.limit(n) if n > 0 else rows


def class_retained(sizes: DataFrame) -> DataFrame:
    """class_name, retained (of objects whose dominator is of another class), attributed (to the nearest such dominator's class)."""
    kind = lambda name: sizes.select(F.col("obj_id").alias(name), F.col("class_name").alias("above"), F.lit(True).alias("is_object"))
    inside = sizes.where("reachable").select("obj_id", "class_name", "shallow", "retained", "idom").join(kind("idom"), "idom", "left")
    # What is dominated by one of its own class waits for the first above that isn't, with its chain; others are summed at once.
    own = F.coalesce("is_object", F.lit(False)) & F.col("class_name").eqNullSafe(F.col("above"))
    by = stored(inside.groupBy("class_name", "above", "is_object", own.alias("own")).agg(F.sum("retained").alias("retained"), F.sum("shallow").alias("attributed")), "by_class")
    outer = by.where("not class_name <=> above").groupBy("class_name").agg(F.sum("retained").alias("retained"))
    attributed = by.where("not own and is_object").select(F.col("above").alias("class_name"), "attributed")
    if not by.where("own").isEmpty():
        chains = stored(inside.where(own).select("obj_id", F.col("idom").alias("up"), "shallow"), "chains")
        sums = trees.chain_heads(chains).join(chains.select("obj_id", "shallow"), "obj_id").groupBy(F.col("head").alias("obj_id")).agg(F.sum("shallow").alias("attributed"))
        heads = sums.join(sizes.select("obj_id", "idom"), "obj_id").groupBy("idom").agg(F.sum("attributed").alias("attributed"))
        attributed = attributed.unionByName(heads.join(kind("idom"), "idom").select(F.col("above").alias("class_name"), "attributed"))
    return outer.join(attributed.groupBy("class_name").agg(F.sum("attributed").alias("attributed")), "class_name", "full")


def root_list(roots: DataFrame, class_objects: DataFrame | None = None) -> DataFrame:
    """obj_id, root_type: explicit roots, the last type of each (by seq), and class objects as sticky classes."""
    explicit = roots.groupBy("obj_id").agg(F.max_by("root_type", "seq").alias("root_type")) if "seq" in roots.columns else roots.select("obj_id", "root_type").dropDuplicates(["obj_id"])
    if class_objects is None:
        return explicit
    more = class_objects.select("obj_id").distinct().join(explicit, "obj_id", "left_anti").select("obj_id", F.lit("STICKY_CLASS").alias("root_type"))
    return explicit.unionByName(more)


def roots_by_class(roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """class_name, roots, shallow, retained, root_type (the most frequent, ties by name)."""
    rows = roots.join(sizes, "obj_id").groupBy("class_name", "root_type").agg(F.count("*").alias("n"), F.sum("shallow").alias("s"), F.sum("retained").alias("r"))
    best = F.min_by("root_type", F.struct(-F.col("n"), F.col("root_type")))
    return rows.groupBy("class_name").agg(F.sum("n").alias("roots"), F.sum("s").alias("shallow"), F.sum("r").alias("retained"), best.alias("root_type"))


def retainers(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """target_class, retainer_class, field, count, size, pct: who refers to the objects of each class directly."""
    kind = objects.select(F.col("obj_id").alias("from_id"), F.col("class_name").alias("retainer_class"))
    sized = objects.select(F.col("obj_id").alias("to_id"), F.col("class_name").alias("target_class"), "shallow")
    # Summed for each object referred to before its own class is looked up, in parts that aren't drawn together however small they look.
    named = dealt(refs, "from_id").join(dealt(kind, "from_id"), "from_id").select("to_id", "retainer_class", "field")
    often = dealt(named, "to_id").groupBy("to_id", "retainer_class", "field").agg(F.count("*").alias("n"))
    rows = often.join(dealt(sized, "to_id"), "to_id")
    by = rows.groupBy("target_class", "retainer_class", "field").agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("shallow")).alias("size"))
    whole = objects.groupBy(F.col("class_name").alias("target_class")).agg(F.sum("shallow").alias("__all"))
    return by.join(whole, "target_class").withColumn("pct", percent_scaled("size", "__all")).drop("__all")


def retainers_by_depth(refs: DataFrame, objects: DataFrame, targets: DataFrame, max_depth: int = 5, stop: Column | None = None) -> DataFrame:
    """retainer_class, field, depth, count, size: breadth-first from targets (obj_id) against references.

    Each target meets an object once, over its least field; count and size are of different targets. A search goes
    no further from an object of which stop holds (over class_name), as for business classes.
    """
    links = refs.groupBy("from_id", "to_id").agg(F.min("field").alias("field")).join(objects.select(F.col("obj_id").alias("from_id"), "class_name"), "from_id")
    once = targets.select("obj_id").distinct()
    if stop is None and walks.worth(objects, once):
        rows = walks.counted(links, objects, objects.join(once, "obj_id", "left_semi"), max_depth, [])
        if rows is not None:
            return rows.groupBy(F.col("label_class").alias("retainer_class"), F.col("label_field").alias("field"), "depth").agg(F.sum("n").alias("count"), F.sum("s").alias("size"))
    links = kept(links, "to_id")
    numbers = bits.numbered(once)
    once = bits.targets_of(bits.search(links, numbers, max_depth, stop), "class_name", "field", "depth")
    links.unpersist()
    sized = numbers.join(objects.select("obj_id", F.col("shallow").alias("target_size")), "obj_id").select("number", "target_size")
    rows = once.join(sized, "number").groupBy(F.col("class_name").alias("retainer_class"), "field", "depth")
    return rows.agg(F.count("*").alias("count"), F.sum("target_size").alias("size"))


def paths_to_roots(refs: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int = 15, per_target: int = 3) -> DataFrame:
    """target, path (root first), length: shortest reference paths from roots to the targets (obj_id), without cycles.

    Each level keeps per_target paths a target and node, the least, so that a hub's many referrers don't multiply.
    """
    ends = stored(roots.select(F.col("obj_id").alias("node")).distinct(), "ends")
    links = stored(refs.select("from_id", "to_id").distinct(), "links")
    front = stored(targets.select(F.col("obj_id").alias("target"), F.col("obj_id").alias("node"), F.array("obj_id").alias("path")), "paths")
    found = front.join(ends, "node", "left_semi")
    for _ in range(max_depth):
        step = links.join(front.join(ends, "node", "left_anti").select("target", "path", F.col("node").alias("to_id")), "to_id").where(~F.array_contains("path", F.col("from_id")))
        step = step.select("target", F.col("from_id").alias("node"), F.concat(F.array("from_id"), "path").alias("path"))
        front = stored(top(step, ["target", "node"], [F.asc("path")], per_target), "paths")
        if front.isEmpty():
            break
        found = found.unionByName(front.join(ends, "node", "left_semi"))
    return top(found.select("target", "path", F.size("path").alias("length")), ["target"], [F.asc("length"), F.asc("path")], per_target)


def biggest_objects(sizes: DataFrame, n: int = 100, by: str = "retained", class_name: str | None = None, all_classes: bool = False) -> DataFrame:
    """The n reachable objects of greatest size; containers and proxies are left out unless all_classes."""
    rows = sizes.where("reachable")
    if class_name:
        rows = rows.where(F.col("class_name") == class_name)
    elif not all_classes:
        rows = rows.where(~classes.is_top_level_filtered("class_name"))
    return rows.orderBy(F.desc(by), "obj_id").limit(n)


def held_by(refs: DataFrame, sizes: DataFrame, obj_id: int, n: int = 50) -> DataFrame:
    """The first n references of one object by field and target, then by retained size."""
    rows = refs.where(F.col("from_id") == obj_id).orderBy("field", "to_id").limit(n)
    return rows.join(sizes, rows.to_id == sizes.obj_id).select("field", "to_id", "class_name", "shallow", "retained").orderBy(F.desc("retained"), "to_id")


def holders_of(refs: DataFrame, objects: DataFrame, obj_id: int, n: int = 20) -> DataFrame:
    rows = refs.where(F.col("to_id") == obj_id).orderBy("from_id", "field").limit(n)
    return rows.join(objects, rows.from_id == objects.obj_id).select("from_id", "class_name", "field", "shallow")


def array_holders(refs: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """holder_class, arrays, children, retained: classes that hold object arrays, and what these hold."""
    arrays = objects.where("class_name like '%[]'").select(F.col("obj_id").alias("array_id"))
    children = refs.select(F.col("from_id").alias("array_id"), F.col("to_id").alias("child")).distinct().join(arrays, "array_id", "left_semi").groupBy("array_id").agg(F.count("*").alias("children"))
    held = refs.select("from_id", F.col("to_id").alias("array_id")).distinct().join(arrays, "array_id", "left_semi")
    held = held.join(children, "array_id", "left").join(sizes.select(F.col("obj_id").alias("array_id"), "retained"), "array_id").join(objects.select(F.col("obj_id").alias("from_id"), F.col("class_name").alias("holder_class")), "from_id")
    return held.where("holder_class not like '%[]'").groupBy("holder_class").agg(F.count("*").alias("arrays"), F.sum(F.coalesce("children", F.lit(0))).alias("children"), F.sum("retained").alias("retained"))


def stratified_sample(objects: DataFrame, n: int = 1000, least_ratio: float = 0.01) -> DataFrame:
    """Per class at most max(n, least_ratio of it) objects: of the largest tenth 40 %, the next four tenths 35 %, the rest 25 %.

    Objects are taken at even steps down each stratum's sizes. Places come from a range sort over all classes, so a
    class of a third of all objects isn't sorted by one task.
    """
    rows = ranked(objects, ["class_name"], [F.desc("shallow"), F.asc("obj_id")]).withColumnsRenamed({"pos": "__i", "n": "__n"})
    size = F.least(F.greatest(F.lit(n), F.floor(F.col("__n") * least_ratio)), F.col("__n"))
    head, middle = F.floor(F.col("__n") / 10), F.floor(F.col("__n") * 4 / 10)
    a, b = F.floor(size * 40 / 100), F.floor(size * 35 / 100)
    strata = [(F.lit(0), head, a), (head, middle, b), (head + middle, F.col("__n") - head - middle, size - a - b)]
    keep = F.col("__n") <= n
    for first, many, wanted in strata:
        step = F.greatest(F.lit(1), F.floor(many / F.greatest(wanted, F.lit(1))))
        at = F.col("__i") - first
        keep = keep | ((at >= 0) & (at < many) & (at % step == 0) & (F.floor(at / step) < wanted))
    return rows.where(keep).drop("__i", "__n")


def graph_stats(objects: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(objects, "objects").crossJoin(count(refs, "refs")).crossJoin(count(roots, "roots"))  # a row each
    return one.crossJoin(refs.agg(F.countDistinct("to_id").alias("referred")))


def class_chain(heap_classes: DataFrame) -> DataFrame:
    """class_id, ancestor_id, depth: each class and all its superclasses, by a join a level.

    A chain that runs in a circle, as a broken dump may have it, ends where it would come back to the class.
    """
    up = stored(heap_classes.select("class_id", "super_class_id"), "classes")
    front = found = up.select("class_id", F.col("class_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    # No chain without a circle is longer than there are classes.
    for depth in range(1, up.count() + 1):
        above = up.select(F.col("class_id").alias("ancestor_id"), F.col("super_class_id").alias("next"))
        step = front.join(above, "ancestor_id").where("next is not null and next <> 0 and next <> class_id")
        front = stored(step.select("class_id", F.col("next").alias("ancestor_id"), F.lit(depth).alias("depth")), "chain")
        if front.isEmpty():
            break
        found = found.unionByName(front)
        found = found if depth % trees.TABLES else stored(found, "chain")
    return found


def object_fields(objects: DataFrame, refs: DataFrame, heap_classes: DataFrame, heap_class_fields: DataFrame, sizes: DataFrame, obj_id: int) -> DataFrame:
    """name, type, declaring class, to_id, class_name, retained of an object's fields, references first, largest first."""
    one = objects.where(F.col("obj_id") == obj_id)
    fields = one.join(class_chain(heap_classes), "class_id").select(F.col("ancestor_id").alias("class_id"), "depth").join(heap_class_fields, "class_id")
    held = refs.where(F.col("from_id") == obj_id).groupBy(F.col("field").alias("name")).agg(F.max("to_id").alias("to_id"))
    rows = fields.join(held, "name", "left").join(sizes.select(F.col("obj_id").alias("to_id"), "class_name", "retained"), "to_id", "left")
    return rows.select("name", "type", "depth", "to_id", "class_name", "retained").orderBy(F.col("to_id").isNull(), F.desc_nulls_last("retained"), "depth", "name")
