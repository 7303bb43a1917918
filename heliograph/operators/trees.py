"""Trees and dominators of large graphs by pointer doubling: rounds follow the logarithm of a tree's depth.

A tree is a table (obj_id, up); roots have up = TOP. Every round is written to the shared folder. Where LAYERS rounds
are enough, a level a round is searched instead, over a table that is dealt by its key once (storage.kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import kept, stored

TOP = -1
#: Rounds whose tables a search keeps apart, before it writes them as one.
TABLES = 16
#: Jumps at most, the last of 2**(SHALLOW - 1) ancestors, of trees whose ways from TOP are kept as arrays.
SHALLOW = 5
#: Levels of graphs and trees that are searched level by level; deeper ones go by pointer doubling.
LAYERS = 12
#: Rows of a few numbers that may be broadcast.
FEW = 500_000


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """The columns named, under new names: renamed(df, new="old")."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def jumps(tree: DataFrame) -> list[DataFrame]:
    """(obj_id, up, steps, way) for jumps of 1, 2, 4, ... ancestors, until every jump ends at TOP: steps is the depth there.

    A jump that would go beyond TOP ends there, after the steps there are. way is the nodes from below `up` down to the
    node itself; beyond SHALLOW jumps it is null, as ways would be long. tree has to be stored.
    """
    found = [tree.select("obj_id", "up", F.lit(1).alias("steps"), F.array("obj_id").alias("way"))]
    while not found[-1].where(F.col("up") != TOP).isEmpty():
        last = found[-1]
        onward = renamed(last, up="obj_id", next="up", more="steps", before="way")
        way = F.concat(F.coalesce("before", F.array().cast("array<bigint>")), "way") if len(found) < SHALLOW else F.lit(None).cast("array<bigint>")
        jump = last.join(onward, "up", "left").select("obj_id", F.coalesce("next", F.lit(TOP)).alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), way.alias("way"))
        found.append(stored(jump, "jumps"))
    return found


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few enough rows, by count; else df, for Spark to shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


def subtree_sums(tree: DataFrame, value: str, keep: bool = True) -> DataFrame:
    """obj_id, total: the sum of value over each node of tree (obj_id, up, value) and all below it.

    In the k-th round a node gets the sum of those k below it, until there are none. Without keep tree is of a table
    that is kept by obj_id already.
    """
    nodes = tree.select("obj_id", "up", F.col(value).alias("total"))
    nodes = kept(nodes, "obj_id") if keep else nodes
    inner = nodes.where(F.col("up") != TOP)
    sent = found = stored(inner.groupBy(F.col("up").alias("obj_id")).agg(F.sum("total").alias("more")), "below")
    for _ in range(LAYERS):
        if sent.isEmpty():
            below = found.groupBy("obj_id").agg(F.sum("more").alias("more"))
            return nodes.join(below, "obj_id", "left").select("obj_id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        sent = stored(inner.join(sent, "obj_id").groupBy(F.col("up").alias("obj_id")).agg(F.sum("more").alias("more")), "below")
        found = found.unionByName(sent)
    return deep_sums(nodes, "total")


def deep_sums(tree: DataFrame, value: str) -> DataFrame:
    """subtree_sums() of a deep tree.

    After k rounds a node has the sum of those less than 2**k below; the node 2**k above each adds its sum.
    """
    rows = stored(tree.select("obj_id", "up", F.col(value).alias("total")), "sums")
    while not rows.where(F.col("up") != TOP).isEmpty():
        below = rows.where(F.col("up") != TOP).groupBy(F.col("up").alias("obj_id")).agg(F.sum("total").alias("more"))
        onward = renamed(rows, up="obj_id", next="up")
        rows = rows.join(onward, "up", "left").join(below, "obj_id", "left")
        rows = stored(rows.select("obj_id", F.coalesce("next", F.lit(TOP)).alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "sums")
    return rows.select("obj_id", "total")


def chain_heads(chains: DataFrame) -> DataFrame:
    """obj_id, head: where each node's way up leaves chains (obj_id, up), a node that isn't in it. Ways mustn't run in a circle.

    Pointer doubling: a chain of n nodes takes log n rounds.
    """
    rows = stored(chains.select("obj_id", "up", F.lit(True).alias("going")), "heads")
    while not rows.where("going").isEmpty():
        onward = renamed(rows, up="obj_id", next="up", more="going")
        step = rows.where("going").join(onward, "up", "left").select("obj_id", F.coalesce("next", "up").alias("up"), F.coalesce("more", F.lit(False)).alias("going"))
        rows = stored(rows.where("not going").unionByName(step), "heads")
    return renamed(rows, obj_id="obj_id", head="up")


def spanning_tree(links: DataFrame, tops: DataFrame) -> DataFrame:
    """obj_id, up of everything that tops (obj_id) reach over links (from_id, to_id), each under one of its referrers.

    Nodes with one referrer go under it: pointer doubling finds where such a chain begins, however long it is. Only
    nodes with several are searched breadth-first, over chains drawn together.
    """
    inner = links.join(renamed(tops, to_id="obj_id"), "to_id", "left_anti")
    by = stored(inner.groupBy(F.col("to_id").alias("obj_id")).agg(F.min("from_id").alias("up"), F.count("*").alias("n")), "referrers")
    alone = by.where("n = 1").select("obj_id", "up")
    # The chain's beginning: a top, a node with several referrers, or nothing, for chains that run in a circle.
    ptr, left = alone, alone.count()
    going = left > 0
    while going and left:
        onward = renamed(ptr, up="obj_id", next="up")
        ptr = stored(ptr.join(onward, "up", "left").select("obj_id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "chains")
        going, left = not ptr.where("moved").isEmpty(), left // 2
    heads = stored(renamed(ptr, obj_id="obj_id", head="up").join(renamed(alone, head="obj_id"), "head", "left_anti").select("obj_id", "head"), "heads")
    circles = renamed(alone, from_id="obj_id").join(renamed(heads, from_id="obj_id"), "from_id", "left_anti")
    several = inner.join(renamed(by.where("n > 1"), to_id="obj_id"), "to_id", "left_semi").join(circles, "from_id", "left_anti")
    short = stored(several.join(renamed(heads, from_id="obj_id", head="head"), "from_id", "left").select("from_id", "to_id", F.coalesce("head", "from_id").alias("head")), "short")
    frontier = seen = stored(tops.select("obj_id", F.lit(TOP).cast("bigint").alias("up")).distinct(), "reached")
    rounds = 0
    while True:
        rounds += 1
        step = short.join(renamed(frontier, head="obj_id"), "head", "left_semi").groupBy(F.col("to_id").alias("obj_id")).agg(F.min("from_id").alias("up"))
        frontier = stored(step.join(seen.select("obj_id"), "obj_id", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if rounds % TABLES else stored(seen, "reached")
    chained = alone.join(heads.join(renamed(seen, head="obj_id"), "head", "left_semi").select("obj_id"), "obj_id", "left_semi")
    return stored(seen.unionByName(chained), "tree")


def common_ancestors(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key, found: of each key's nodes (key, node) the nearest common ancestor, a node being its own.

    levels is jumps(tree). Nodes of a key are lifted to the depth of the highest, then together by halving jumps,
    and those that meet are one from then on. In a tree of few levels the nodes' ways from TOP are short arrays, and
    the common part of many of them is that of the least and the greatest, one grouped job.
    """
    if len(levels) <= SHALLOW:
        way = F.concat(F.array(F.lit(TOP).cast("bigint")), F.coalesce("way", F.array().cast("array<bigint>"))).alias("way")
        ways = pairs.join(renamed(levels[-1], node="obj_id", way="way"), "node", "left").select("key", way)
        ends = ways.groupBy("key").agg(F.min("way").alias("a"), F.max("way").alias("b"))
        n = F.least(F.size("a"), F.size("b"))
        differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("a", i) != F.element_at("b", i))
        return ends.select("key", F.element_at("a", F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)).alias("found"))
    depth = renamed(levels[-1], node="obj_id", depth="steps")
    rows = pairs.distinct().join(depth, "node", "left").select("key", "node", F.coalesce("depth", F.lit(0)).alias("depth"))
    rows = rows.join(rows.groupBy("key").agg(F.min("depth").alias("least")), "key")
    for k in reversed(range(len(levels))):
        far = F.col("depth") - F.col("least") >= 1 << k
        rows = rows.join(renamed(levels[k], node="obj_id", above="up"), "node", "left")
        rows = rows.select("key", F.when(far, F.coalesce("above", F.lit(TOP))).otherwise(F.col("node")).alias("node"), F.when(far, F.col("depth") - (1 << k)).otherwise(F.col("depth")).alias("depth"), "least")
    rows, done = stored(rows.select("key", "node").distinct(), "lifted"), None
    for k in reversed(range(len(levels))):
        above = rows.join(renamed(levels[k], node="obj_id", above="up"), "node", "left").select("key", "node", F.coalesce("above", F.lit(TOP)).alias("above"))
        met = above.groupBy("key").agg((F.min("above") == F.max("above")).alias("meet"), F.count("*").alias("n"))
        moved = above.join(met, "key").select("key", F.when(F.col("meet") | (F.col("n") == 1), F.col("node")).otherwise(F.col("above")).alias("node"), "n").distinct()
        moved = stored(moved, "lifted")
        alone = moved.where("n = 1").select("key", F.col("node").alias("found"))
        done = alone if done is None else done.unionByName(alone)
        rows = moved.where("n > 1").select("key", "node")
    last = rows.join(renamed(levels[0], node="obj_id", above="up"), "node", "left").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min(F.coalesce("above", F.lit(TOP))).alias("above"))
    return done.unionByName(last.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("above")).alias("found")))


def layered(links: DataFrame, tops: DataFrame) -> tuple[DataFrame, bool] | None:
    """(obj_id, up, open) of everything that tops reach over links, and whether any is open; None if more than LAYERS deep.

    links (from_id, to_id) has to be kept by from_id; repeated ones do no harm. It is a spanning tree by breadth-first
    search, each node under its least referrer of the level before, but for nodes whose referrers are below different
    tops: nothing but TOP dominates them, so they go under TOP, and are tops of what is below them. A node of one
    referrer has that for its dominator. All others are open.
    """
    frontier = stored(tops.select("obj_id", F.col("obj_id").alias("top")), "layer")
    first, again, seen = None, None, frontier.select("obj_id")
    for _ in range(LAYERS):
        by = links.join(renamed(frontier, from_id="obj_id", top="top"), "from_id").groupBy(F.col("to_id").alias("obj_id"))
        met = by.agg(F.min("from_id").alias("up"), F.max("from_id").alias("last"), F.min("top").alias("top"), F.max("top").alias("other"))
        met = met.select("obj_id", "up", "top", (F.col("up") != F.col("last")).alias("several"), (F.col("top") != F.col("other")).alias("apart"))
        layer = stored(met.join(seen.select("obj_id", F.lit(True).alias("again")), "obj_id", "left"), "layer")
        new, old = layer.where("again is null").drop("again"), layer.where("again").select("obj_id", "top", "apart")
        first, again = (new, old) if first is None else (first.unionByName(new), again.unionByName(old))
        frontier = new.select("obj_id", F.when(F.col("apart"), F.col("obj_id")).otherwise(F.col("top")).alias("top"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("obj_id"))
    else:
        return None
    more = again.groupBy("obj_id").agg(F.min("top").alias("least"), F.max("top").alias("most"), F.max("apart").alias("also"))
    rows = first.join(few(more), "obj_id", "left")
    apart = F.col("apart") | F.coalesce(F.col("also") | (F.col("least") != F.col("top")) | (F.col("most") != F.col("top")), F.lit(False))
    rows = rows.select("obj_id", F.when(apart, F.lit(TOP).cast("bigint")).otherwise(F.col("up")).alias("up"), (~apart & (F.col("several") | F.col("also").isNotNull())).alias("open"))
    rows = rows.unionByName(tops.select("obj_id", F.lit(TOP).cast("bigint").alias("up"), F.lit(False).alias("open")))
    return rows, not rows.where("open").isEmpty()


def dominator_tree(links: DataFrame, tops: DataFrame, keep: bool = True) -> DataFrame:
    """obj_id, up of everything that tops reach over links (from_id, to_id): its immediate dominator.

    In any spanning tree a node's dominators are ancestors of it and of all its referrers. So each node with several
    referrers goes up to the nearest common ancestor of them, all at once, until none moves; then the tree is that of
    the dominators. Nodes of one referrer never move, and a node that refers to nothing is above nothing, so that its
    move changes nothing else. TOP is above all tops. Without keep links are kept by from_id already.
    """
    tops = stored(tops.select("obj_id").distinct(), "tops")
    every = links.where("from_id <> to_id").select("from_id", "to_id")
    every = kept(every, "from_id") if keep else every
    found = layered(every, tops)
    if found and not found[1]:
        every.unpersist()
        return found[0].select("obj_id", "up")
    links = stored(every.distinct(), "links")
    every.unpersist()
    tree = stored(found[0], "tree") if found else spanning_tree(links, tops)
    live = stored(links.join(renamed(tree.where(F.col("up") != TOP), to_id="obj_id"), "to_id", "left_semi").join(renamed(tree, from_id="obj_id"), "from_id", "left_semi"), "live")
    # Of a tree by layers the others are where they belong.
    several = renamed(tree.where("open"), key="obj_id") if found else live.groupBy(F.col("to_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    tree = tree.select("obj_id", "up")
    pairs = stored(renamed(live, key="to_id", node="from_id").join(several, "key", "left_semi"), "pairs")
    if pairs.isEmpty():
        return tree
    while True:
        # What has got to TOP stays there.
        ends = pairs.join(renamed(tree.where(F.col("up") == TOP), key="obj_id"), "key", "left_anti").select("key", "node")
        found = renamed(common_ancestors(ends, jumps(tree)), obj_id="key", new="found")
        moved = stored(tree.join(found, "obj_id", "left").select("obj_id", F.coalesce("new", "up").alias("up"), (F.coalesce("new", "up") != F.col("up")).alias("moved")), "tree")
        tree = moved.select("obj_id", "up")
        if moved.where("moved").join(renamed(live, obj_id="from_id"), "obj_id", "left_semi").isEmpty():
            return tree
