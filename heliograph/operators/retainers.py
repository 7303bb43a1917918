"""Who keeps the objects of a class alive: searches against references, for many target classes in one job a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..plans.storage import kept, stored
from . import bits, walks
from .heap import retained, retained_with_collections, shared_through_arrays, stratified_sample
from .stats import top
from .trees import few, renamed

#: Fields whose targets count as their holder's own.
OWNING_FIELDS = ["<loaded_class>", "classes", "loadedClasses", "children", "elements", "entries", "items", "value", "data", "content"]


def _links(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs, each pair once over its least field, with the referrer's class; objects without a class are `(unknown)`."""
    kind = objects.select(F.col("obj_id").alias("from_id"), F.coalesce("class_name", F.lit("(unknown)")).alias("class_name"))
    return refs.groupBy("from_id", "to_id").agg(F.min("field").alias("field")).join(kind, "from_id")


def found_by(refs: DataFrame, objects: DataFrame, numbers: DataFrame, max_depth: int, done=None) -> DataFrame:
    """bits.search() of numbered targets against references."""
    links = kept(_links(refs, objects), "to_id")
    found = bits.search(links, numbers, max_depth, done=done)
    links.unpersist()
    return found


def _known(objects: DataFrame) -> DataFrame:
    return objects.select("obj_id", F.coalesce("class_name", F.lit("(unknown)")).alias("class_name"))


def _sampled(objects: DataFrame, wanted: DataFrame, samples: int) -> tuple[DataFrame, DataFrame]:
    """A stratified sample of each wanted class (class_name): obj_id, target_class, shallow; and per class its totals."""
    rows = objects.join(wanted.select("class_name").distinct(), "class_name", "left_semi")
    whole = stored(rows.groupBy("class_name").agg(F.count("*").alias("instances"), F.sum("shallow").alias("total_size")), "whole")
    if (whole.agg(F.max("instances")).head()[0] or 0) <= samples:
        sample = rows
        taken = whole.select("class_name", F.col("instances").alias("sampled"), F.col("total_size").alias("sampled_size"))
    else:
        sample = stored(stratified_sample(rows, samples).select("obj_id", "class_name", "shallow"), "sample")
        taken = sample.groupBy("class_name").agg(F.count("*").alias("sampled"), F.sum("shallow").alias("sampled_size"))
    whole = whole.join(taken, "class_name").select(F.col("class_name").alias("target_class"), "instances", "total_size", "sampled", "sampled_size")
    return renamed(sample, obj_id="obj_id", target_class="class_name", shallow="shallow"), whole


def _scaled(value: str) -> Column:
    """value of the sample as that of all instances, as the integer below."""
    ratio = F.col("sampled") / F.col("instances")
    return F.when(F.col("sampled") < F.col("instances"), F.floor(F.col(value) / ratio)).otherwise(F.col(value)).cast("bigint")


def by_depth(refs: DataFrame, objects: DataFrame, wanted: DataFrame, n: int | None = 20, max_depth: int = 5, samples: int = 1000) -> DataFrame:
    """target_class, retainer_class, field, depth, count, size, pct, rank: for each wanted class (class_name) who retains it.

    Count and size are of different targets, from a stratified sample of large classes scaled to all of it; no share
    is over 100 per cent. Ranked by depth, then size; the first n of each class.
    """
    sample, whole = _sampled(objects, wanted, samples)
    rows = walks.counted(_links(refs, objects), _known(objects), sample, max_depth, ["target_class"]) if walks.worth(objects, sample) else None
    if rows is not None:
        rows = rows.groupBy("target_class", F.col("label_class").alias("retainer_class"), F.col("label_field").alias("field"), "depth").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    else:
        numbers = bits.numbered(sample, "target_class")
        once = bits.targets_of(found_by(refs, objects, numbers, max_depth), "class_name", "field", "depth")
        once = once.withColumnRenamed("class_name", "retainer_class").join(numbers.drop("obj_id"), "number")
        rows = once.groupBy("target_class", "retainer_class", "field", "depth").agg(F.count("*").alias("n"), F.sum("shallow").alias("s"))
    rows = rows.join(whole, "target_class")
    rows = rows.withColumns({"count": _scaled("n"), "size": _scaled("s")})
    pct = F.when(F.col("total_size") > 0, F.least(F.col("size") * 100.0 / F.col("total_size"), F.lit(100.0))).otherwise(0.0)
    rows = rows.select("target_class", "retainer_class", "field", "depth", "count", F.least("size", "total_size").alias("size"), pct.alias("pct"))
    return top(rows, ["target_class"], [F.asc("depth"), F.desc("size"), F.asc("retainer_class"), F.asc("field")], n, "rank")


def of_top_classes(refs: DataFrame, objects: DataFrame, histogram: DataFrame, retained: DataFrame, many: int = 20, n: int = 20, max_depth: int = 5, samples: int = 1000) -> DataFrame:
    """by_depth() of the `many` largest classes of a histogram, with the class's retained size (class_name, retained)."""
    lead = stored(histogram.orderBy(F.desc("total_size"), "class_name").limit(many).select("class_name"), "lead")
    rows = by_depth(refs, objects, lead, n, max_depth, samples)
    return rows.join(renamed(retained, target_class="class_name", class_retained="retained"), "target_class", "left")


def business(refs: DataFrame, objects: DataFrame, wanted: DataFrame, roots: DataFrame, n: int | None = 20, max_depth: int = 15, samples: int = 500, enough: int = 10) -> DataFrame:
    """target_class, class_name, depth, count, size, pct, is_root, rank: application classes that retain each wanted class.

    A target is searched for until `enough` such classes are found, level by level; each counts once a target. The
    share is of the sampled targets' size; depth and root are those of the nearest of the class's objects.
    """
    sample, whole = _sampled(objects, wanted, samples)
    rooted = roots.select("obj_id", F.lit(True).alias("is_root")).distinct()
    rows = _business_of_many(refs, objects, sample, rooted, max_depth, enough) if walks.worth(objects, sample) else None
    rows = (_business_of_few(refs, objects, sample, rooted, max_depth, enough) if rows is None else rows).join(whole, "target_class")
    pct = F.when(F.col("sampled_size") > 0, F.least(F.col("s") * 100.0 / F.col("sampled_size"), F.lit(100.0))).otherwise(0.0)
    rows = rows.select("target_class", "class_name", "at.depth", _scaled("n").alias("count"), _scaled("s").alias("size"), pct.alias("pct"), (~F.col("at.no_root")).alias("is_root"))
    return top(rows, ["target_class"], [F.desc("size"), F.asc("class_name")], n, "rank")


def _business_of_few(refs: DataFrame, objects: DataFrame, sample: DataFrame, rooted: DataFrame, max_depth: int, enough: int) -> DataFrame:
    """target_class, class_name, at, n, s by a search from the targets, a bit for each."""
    numbers = bits.numbered(sample, "target_class")

    def done(found: DataFrame) -> DataFrame:
        many = bits.targets_of(found.where(classes.is_business("class_name")), "class_name").groupBy("number").agg(F.count("*").alias("n"))
        return many.where(F.col("n") >= enough).select("number")

    found = found_by(refs, objects, numbers, max_depth, done).where(classes.is_business("class_name"))
    near = bits.targets_of(found.join(renamed(rooted, node="obj_id", is_root="is_root"), "node", "left").withColumn("no_root", F.col("is_root").isNull()), "class_name", "depth", "no_root")
    near = near.groupBy("number", "class_name").agg(F.min(F.struct("depth", "no_root")).alias("at")).join(numbers.drop("obj_id"), "number")
    return near.groupBy("target_class", "class_name").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.sum("shallow").alias("s"))


def _business_of_many(refs: DataFrame, objects: DataFrame, sample: DataFrame, rooted: DataFrame, max_depth: int, enough: int) -> DataFrame | None:
    """The same from labels of class and root, which all objects that have the same ones share."""
    links = _links(refs, objects).join(few(renamed(rooted, from_id="obj_id", is_root="is_root")), "from_id", "left")
    links = links.withColumn("field", F.col("is_root").isNull().cast("string"))
    rows = walks.counted(links, _known(objects), sample, max_depth, ["target_class"], classes.is_business("class_name"), fields=False)
    if rows is None:
        return None
    rows = rows.withColumnsRenamed({"label_class": "class_name"}).withColumn("no_root", F.col("label_field") == "true")
    near = stored(rows.groupBy("gid", "target_class", "n", "s", "class_name", "depth").agg(F.min("no_root").alias("no_root")), "near")
    # A search ends with the depth at which there are enough classes.
    first = near.groupBy("gid", "class_name").agg(F.min("depth").alias("end"))
    ends = top(first, ["gid"], [F.asc("end"), F.asc("class_name")], enough, "rank").where(F.col("rank") == enough).select("gid", "end")
    near = near.join(ends, "gid", "left").where(F.col("end").isNull() | (F.col("depth") <= F.col("end")))
    near = near.groupBy("gid", "target_class", "n", "s", "class_name").agg(F.min(F.struct("depth", "no_root")).alias("at"))
    return near.groupBy("target_class", "class_name").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.sum("s").alias("s"))


def sub_graph(refs: DataFrame, objects: DataFrame, class_name: str, seeds: int = 10, max_depth: int = 10, max_nodes: int = 100, few: int = 20, least_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (obj_id, class_name, shallow, depth) and edges (from_id, to_id, field) about a class, for a picture.

    From the class's most referred-to objects against references, level by level, nearest ids first until max_nodes;
    it ends once an application class is among at least `few` nodes at least_depth or deeper. A view, so bounded.
    """
    links = stored(refs.groupBy("from_id", "to_id").agg(F.min("field").alias("field")), "links")
    named = objects.select("obj_id", "class_name", "shallow")
    own = named.where(F.col("class_name") == class_name)
    often = renamed(links, obj_id="to_id").join(own, "obj_id", "left_semi").groupBy("obj_id").agg(F.count("*").alias("n"))
    first = own.join(often, "obj_id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), F.desc("shallow"), "obj_id").limit(min(seeds, max_nodes)).select("obj_id", F.lit(0).alias("depth"))
    nodes = frontier = stored(first, "nodes")
    many, told = nodes.count(), False
    for depth in range(1, max_depth + 1):
        if many >= max_nodes:
            break
        step = links.join(renamed(frontier, to_id="obj_id"), "to_id", "left_semi").select(F.col("from_id").alias("obj_id")).distinct().join(nodes, "obj_id", "left_anti").join(named, "obj_id", "left_semi")
        frontier = stored(step.orderBy("obj_id").limit(max_nodes - many).withColumn("depth", F.lit(depth)), "nodes")
        found = frontier.count()
        if not found:
            break
        nodes, many = nodes.unionByName(frontier), many + found
        told = told or not frontier.join(named, "obj_id").where(classes.is_business("class_name")).isEmpty()
        if told and many >= few and depth >= least_depth:
            break
    nodes = stored(nodes, "nodes")
    edges = links.join(renamed(nodes, from_id="obj_id"), "from_id", "left_semi").join(renamed(nodes, to_id="obj_id"), "to_id", "left_semi")
    return nodes.join(named, "obj_id").select("obj_id", "class_name", "shallow", "depth"), edges.select("from_id", "to_id", "field")


def sub_graphs(refs: DataFrame, objects: DataFrame, wanted: DataFrame, most: int = 20, **limits: int) -> tuple[DataFrame, DataFrame]:
    """sub_graph() of each wanted class (class_name), at most `most` of them: nodes and edges with of_class before them."""
    # A few names reach the driver: a picture for each is asked for.
    names = [r.class_name for r in wanted.select("class_name").distinct().orderBy("class_name").limit(most).collect()]
    nodes = objects.sparkSession.createDataFrame([], "of_class string, obj_id long, class_name string, shallow long, depth int")
    edges = objects.sparkSession.createDataFrame([], "of_class string, from_id long, to_id long, field string")
    for name in names:
        n, e = sub_graph(refs, objects, name, **limits)
        nodes, edges = nodes.unionByName(n.withColumn("of_class", F.lit(name))), edges.unionByName(e.withColumn("of_class", F.lit(name)))
    return nodes, edges


def of_arrays(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """class_name, references: classes, arrays left out, that refer to arrays."""
    arrays = objects.where("class_name like '%[]'").select(F.col("obj_id").alias("to_id"))
    others = objects.where("class_name not like '%[]'").select(F.col("obj_id").alias("from_id"), "class_name")
    return refs.join(arrays, "to_id", "left_semi").join(others, "from_id").groupBy("class_name").agg(F.count("*").alias("references"))


def with_retainers_size(histogram: DataFrame, found: DataFrame) -> DataFrame:
    """histogram (class_name, total_size, ...) with `size`: the retained size that a retainer search gave, where it is positive."""
    sizes = found.groupBy(F.col("target_class").alias("class_name")).agg(F.max("class_retained").alias("__found"))
    return histogram.join(sizes, "class_name", "left").withColumn("size", F.when(F.col("__found") > 0, F.col("__found")).otherwise(F.col("total_size"))).drop("__found")


def owned_sizes(refs: DataFrame, objects: DataFrame, sizes: DataFrame, class_name: str, n: int = 10) -> DataFrame:
    """obj_id, shallow, retained, dominated, loaded_classes, through_arrays, owned: of the n largest objects of a class.

    owned adds to the retained size the children that count as the object's own: those of owning fields, classes, and
    what a class loader has loaded, where only arrays of collections keep them from being dominated.
    """
    best = stored(sizes.where(F.col("class_name") == class_name).orderBy(F.desc("retained"), "obj_id").limit(n).select("obj_id", "class_name", "shallow", "retained"), "best")
    loader = F.lower(F.lit(class_name)).contains("classloader")
    few = refs.join(renamed(best, from_id="obj_id"), "from_id", "left_semi")
    kinds = objects.select(F.col("obj_id").alias("to_id"), F.col("class_name").alias("to_class"))
    pairs = shared_through_arrays(refs, objects, sizes, renamed(best, from_id="obj_id")).join(kinds, "to_id", "left")
    owns = few.where(F.col("field").isin(OWNING_FIELDS)).select("from_id", "to_id").distinct().withColumn("owns", F.lit(True))
    pairs = pairs.join(owns, ["from_id", "to_id"], "left")
    child = pairs.groupBy("from_id", "to_id").agg(
        F.max(loader & (F.col("field") == "<loaded_class>")).alias("loaded"), F.max((F.col("to_class") == "java.lang.Class") | F.col("owns").isNotNull()).alias("own"), F.max("child_retained").alias("size")
    )
    more = child.groupBy(F.col("from_id").alias("obj_id")).agg(F.sum(F.when(F.col("loaded"), F.col("size")).otherwise(0)).alias("l"), F.sum(F.when(~F.col("loaded") & F.col("own"), F.col("size")).otherwise(0)).alias("t"))
    rows = best.join(more, "obj_id", "left").withColumns({"loaded_classes": F.coalesce("l", F.lit(0)), "through_arrays": F.coalesce("t", F.lit(0))})
    return rows.select("obj_id", "shallow", "retained", (F.col("retained") - F.col("shallow")).alias("dominated"), "loaded_classes", "through_arrays", (F.col("retained") + F.col("loaded_classes") + F.col("through_arrays")).alias("owned"))


def diagnosis(refs: DataFrame, objects: DataFrame, sizes: DataFrame, class_name: str, n: int = 10) -> DataFrame:
    """obj_id, fields, dominated_fields, dominated, shared_fields, shared, through_arrays, scenarios: what the n largest objects of a class hold.

    The children of an object are those that it dominates, and those that others hold too. Scenarios are what the
    object's size would be: without its shared children, with those that only arrays of collections share, with all.
    """
    best = stored(sizes.where(F.col("class_name") == class_name).orderBy(F.desc("retained"), "obj_id").limit(n).select("obj_id", "retained"), "best")
    child = sizes.select(F.col("obj_id").alias("to_id"), "idom", F.col("retained").alias("size"))
    held = refs.select("from_id", "to_id").distinct().join(renamed(best, from_id="obj_id"), "from_id", "left_semi").join(child, "to_id")
    through = shared_through_arrays(refs, objects, sizes, renamed(best, from_id="obj_id")).select("from_id", "to_id", F.lit(True).alias("through")).distinct()
    own = F.col("idom").eqNullSafe(F.col("from_id"))
    some = lambda test: F.sum(F.when(test, F.col("size")).otherwise(0))
    by = held.join(through, ["from_id", "to_id"], "left").groupBy(F.col("from_id").alias("obj_id")).agg(
        F.count("*").alias("fields"), F.count(F.when(own, 1)).alias("dominated_fields"), some(own).alias("dominated"), F.count(F.when(~own, 1)).alias("shared_fields"), some(~own).alias("shared"), some(F.col("through")).alias("through_arrays")
    )
    counts = ["fields", "dominated_fields", "dominated", "shared_fields", "shared", "through_arrays"]
    rows = best.join(by, "obj_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return rows.select("obj_id", *counts, F.col("retained").alias("standard"), (F.col("retained") + F.col("through_arrays")).alias("with_arrays"), (F.col("retained") + F.col("shared")).alias("with_shared"))


#: Ways to size objects by name; add more. Each takes (objects, refs, doms) and gives retained() rows with `size`.
CALCULATORS = {
    "standard": lambda objects, refs, doms: retained(objects, doms).withColumn("size", F.col("retained")),
    "collections": lambda objects, refs, doms: retained_with_collections(retained(objects, doms), refs, deal=False).withColumn("size", F.col("idea")),
}
#: Ways to look at a class's largest objects, by name; each takes (refs, objects, sizes, class_name, n).
DIAGNOSES = {"owned": owned_sizes, "scenarios": diagnosis}


def roots_by_head(paths: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """root_type, class_name, targets, paths: paths to roots (target, path) by the type and class of the root they begin at."""
    head = paths.select("target", F.get("path", F.lit(0)).alias("obj_id"))
    rows = head.join(roots.select("obj_id", "root_type"), "obj_id").join(objects.select("obj_id", "class_name"), "obj_id")
    return rows.groupBy("root_type", "class_name").agg(F.countDistinct("target").alias("targets"), F.count("*").alias("paths"))


def roots_by_size(roots: DataFrame, sizes: DataFrame, n: int = 50) -> DataFrame:
    """obj_id, root_type, class_name, shallow, retained of the n roots of greatest retained size."""
    rows = roots.select("obj_id", "root_type").join(sizes.select("obj_id", "class_name", "shallow", "retained"), "obj_id")
    return rows.orderBy(F.desc("retained"), "obj_id").limit(n)


def ordered(found: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of by_depth() or heap.retainers_by_depth() nearest first, then largest; the first n."""
    rows = found.orderBy(F.asc("depth"), F.desc("size"), F.asc("retainer_class"), F.asc("field"))
    return rows.limit(n) if n else rows

