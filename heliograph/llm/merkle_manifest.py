"""Merkle manifest of a table: higher-order SQL over blocks of ordered leaves, level by level, then over block roots.

Every row is a leaf; each group of rows has a tree of its own, and the groups' roots have one above them. A tree's
leaves lie in blocks of FANOUT ** LEVELS. A block is one array; `transform` over a `sequence` of runs hashes a `slice`
each, and `aggregate` stacks the levels. Block roots are the leaves of the next pass, so a tree of n leaves takes
log(n) / log(512) passes. Paths then go the other way: a block's members get the siblings within the block before
those of its root.

Places in a tree come from a range sort over all groups and counts a partition, so that a group of a third of all
rows, or one row that often repeated, is ranked by as many tasks as it has rows for. Only columns' functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a parent has at most, and levels that one pass collapses.
FANOUT, LEVELS = 8, 3
#: Levels that any table's tree can have.
TALLEST = 20


def leaf(*fields: Column) -> Column:
    """Digest of fields in a row: `-` for null, else the bytes' number, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows (of a stored table, column tree) with pos, the place in the tree from 0, and n, the tree's rows.

    Equal rows are told apart by their place in the table, so the sort can cut between them.
    """
    by = ["tree", *order, "__row"]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    table = stored(dealt.drop("__row").withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranked")
    tree = Window.partitionBy("tree")
    before = F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each partition and tree that meet: about as many as there are partitions and trees.
    counts = table.groupBy("tree", "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    counts = counts.select("tree", "__part", F.sum("__rows").over(tree).alias("n"), (F.col("__first") - F.coalesce(before, F.lit(0))).alias("__shift"))
    return table.join(counts, ["tree", "__part"]).withColumn("pos", F.col("__at") - F.col("__shift")).drop("__part", "__at", "__shift")


def parents(tier: Column, fanout: int) -> Column:
    """Digests of every `fanout` consecutive nodes of an array, the last run of fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(tier) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(tier, i * fanout + 1, F.lit(fanout)), ""), 256))


def collapse(nodes: DataFrame, carried: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The passes over trees of nodes (tree, n, pos, hash): stored blocks (tree, n, block, members, tiers, root).

    tiers are the arrays of the block's levels, its members' digests first. In the last pass each tree is one block.
    """
    size, passes = fanout**levels, []
    while True:
        members = F.array_sort(F.collect_list(F.struct("pos", "hash", *(carried if not passes else ()))))
        blocks = nodes.groupBy("tree", "n", F.floor(F.col("pos") / size).alias("block")).agg(members.alias("members"))
        # A tree of n nodes has as many levels more as there are powers of the fan-out below n.
        left = F.size(F.filter(F.array(*(F.lit(min(fanout**k, 2**63 - 1)) for k in range(TALLEST + 1))), lambda power: power < F.col("n")))
        steps = F.slice(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), F.least(left, F.lit(levels)))
        first = F.array(F.transform("members", lambda m: m["hash"]))
        tiers = F.aggregate(steps, first, lambda found, _: F.concat(found, F.array(parents(F.element_at(found, -1), fanout))))
        blocks = stored(blocks.withColumn("tiers", tiers).withColumn("root", F.element_at(F.element_at("tiers", -1), 1)), "blocks")
        passes.append(blocks)
        # One number reaches the driver.
        if (blocks.agg(F.max("n")).head()[0] or 0) <= size:
            return passes
        nodes = blocks.select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.col("root").alias("hash"))


def siblings(i: Column, fanout: int) -> Column:
    """(left, right) of the block's member at place i: its siblings' digests as one text each, a level an element."""

    def of_level(tier: Column, level: Column) -> Column:
        own = F.floor(i / F.pow(F.lit(fanout), level)).cast("int")
        first = F.floor(own / fanout).cast("int") * fanout
        left, right = F.slice(tier, first + 1, own - first), F.slice(tier, own + 2, first + fanout - 1 - own)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice("tiers", F.lit(1), F.size("tiers") - 1), of_level)


def paths(passes: list[DataFrame], above: DataFrame, carried: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """tree, hash, path, subroot, root and the carried columns of every leaf; above has tree, path, subroot, root of the trees."""
    below = above.withColumn("block", F.lit(0).cast("long"))

    def member(m: Column, i: Column) -> Column:
        return F.struct(m["pos"].alias("block"), F.concat(siblings(i, fanout), F.col("path")).alias("path"), *(m[c].alias(c) for c in kept))

    for k, blocks in reversed(list(enumerate(passes))):
        kept = ("hash", *carried) if k == 0 else ()
        joined = blocks.select("tree", "block", "members", "tiers").join(below, ["tree", "block"])
        below = joined.select("tree", "subroot", "root", F.inline(F.transform("members", member)))
    return below


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", carried: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """key, leaf, subroot, root, path (array of left, right) of every row, and the carried columns, counted with the leaf.

    Leaves ascend by key within a group, rows without a key first, equal keys by digest; rows equal in all fields are
    leaves each. A null group is a tree of its own, before all others. An empty table gives no rows. Other columns
    than the fields aren't read, whatever their names.
    """
    carried = carried or {}
    names = ["__key", *(f"__carried_{i}" for i in range(len(carried)))]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("__key"), leaf(*map(F.col, fields)).alias("hash"), *(c.alias(n) for c, n in zip(carried.values(), names[1:], strict=True)))
    passes = collapse(ranked(stored(rows, "leaves"), "__key", "hash"), names, fanout, levels)
    subroots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash"))
    upper = collapse(ranked(stored(subroots, "subroots"), "of"), ["of"], fanout, levels)
    top = upper[-1].select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    above = paths(upper, top, ["of"], fanout).select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    made = paths(passes, above, names, fanout)
    return made.select(F.col("__key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(n).alias(c) for c, n in zip(carried, names[1:], strict=True)))
