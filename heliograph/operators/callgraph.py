"""Call graphs: nodes, edges, hot paths, recursion and modules of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.values import fixed, percent
from .stats import top


def busy(samples: DataFrame, include_idle: bool = False) -> DataFrame:
    rows = samples.where(F.size("stack") > 0)
    return rows if include_idle else rows.where(~fn.is_idle_in_graphs("thread_name"))


def frames(samples: DataFrame) -> DataFrame:
    """frames_of() distinct stacks of samples. Where frames feed several results, store the stacks: each reads them twice."""
    return frames_of(stacks(samples))


def stacks(samples: DataFrame) -> DataFrame:
    """profile_id, tid, stack, value, times: equal stacks of a thread as one, with their sum and how many samples they were."""
    return samples.groupBy("profile_id", "tid", "stack").agg(F.sum("value").alias("value"), F.count("*").alias("times"))


def frames_of(whole: DataFrame) -> DataFrame:
    """profile_id, tid, stack_id, pos, node_id, name, module, caller, is_leaf, value, times: frames of stacks().

    A caller is the frame before in the array, so nothing is shuffled to find it. Shares are of the leaves' sum.
    """
    named = lambda x: fn.node_id(fn.frame_function(x), fn.frame_module(x))
    rows = whole.withColumns({"__n": F.transform("stack", named), "stack_id": F.xxhash64("profile_id", "tid", "stack")})
    rows = rows.select("profile_id", "tid", "stack_id", "value", "times", "__n", F.size("stack").alias("__size"), F.posexplode("stack").alias("pos", "frame"))
    return rows.select(
        "profile_id", "tid", "stack_id", "pos", F.get("__n", F.col("pos")).alias("node_id"), fn.frame_function("frame").alias("name"), fn.frame_module("frame").alias("module"),
        F.when(F.col("pos") > 0, F.get("__n", F.col("pos") - 1)).alias("caller"), (F.col("pos") == F.col("__size") - 1).alias("is_leaf"), "value", "times",
    )


def nodes(rows: DataFrame, by_thread: bool = False) -> DataFrame:
    """Per node: self_time, total_time (every occurrence), call_count, max_depth, is_recursive, self_pct, total_pct.

    The share is of the leaves' sum, which is the samples' total of the profile, or of the thread with by_thread.
    """
    keys = ["profile_id", "tid"] if by_thread else ["profile_id"]
    often = rows.groupBy(*keys, "node_id", "stack_id").agg(
        F.sum("value").alias("total"), F.sum(F.when(F.col("is_leaf"), F.col("value")).otherwise(0)).alias("self"), F.sum("times").alias("calls"), F.max("pos").alias("depth"), F.count("*").alias("n"), F.first("name").alias("name"), F.first("module").alias("module")
    )
    found = often.groupBy(*keys, "node_id").agg(
        F.min("name").alias("name"), F.min("module").alias("module"), F.sum("self").alias("self_time"), F.sum("total").alias("total_time"), F.sum("calls").alias("call_count"), F.max("depth").alias("max_depth"), F.max(F.col("n") > 1).alias("is_recursive")
    )
    whole = rows.where("is_leaf").groupBy(*keys).agg(F.sum("value").alias("__all"))
    return found.join(whole, keys).withColumns({"self_pct": percent("self_time", "__all"), "total_pct": percent("total_time", "__all")}).drop("__all")


def edges(rows: DataFrame, by_thread: bool = False) -> DataFrame:
    """Per (source, target): count (samples over the edge) and weight (their share of the total)."""
    keys = ["profile_id", "tid"] if by_thread else ["profile_id"]
    found = rows.where("caller is not null").groupBy(*keys, F.col("caller").alias("source"), F.col("node_id").alias("target")).agg(F.sum("value").alias("count"))
    whole = rows.where("is_leaf").groupBy(*keys).agg(F.sum("value").alias("__all"))
    return found.join(whole, keys).withColumn("weight", percent("count", "__all")).drop("__all")


def degrees(links: DataFrame) -> DataFrame:
    """profile_id, node_id, caller_count, callee_count."""
    both = links.select("profile_id", F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select("profile_id", F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("profile_id", "node_id").agg(F.sum("i").alias("caller_count"), F.sum("o").alias("callee_count"))


def prune(points: DataFrame, links: DataFrame, min_node: float, min_edge: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of at least min_node percent in total; edges of at least min_edge between two of those."""
    kept = points.where(F.col("total_pct") >= min_node)
    ends = lambda side: kept.select("profile_id", F.col("node_id").alias(side))
    return kept, links.where(F.col("weight") >= min_edge).join(ends("source"), ["profile_id", "source"], "left_semi").join(ends("target"), ["profile_id", "target"], "left_semi")


def graph_stats(points: DataFrame, links: DataFrame) -> DataFrame:
    a = points.groupBy("profile_id").agg(F.count("*").alias("nodes"), F.max("self_pct").alias("max_self_pct"), F.max("total_pct").alias("max_total_pct"), F.count(F.when(F.col("is_recursive"), 1)).alias("recursive"))
    return a.join(links.groupBy("profile_id").agg(F.count("*").alias("edges")), "profile_id", "left")


def hot_paths(samples: DataFrame, n: int = 20) -> DataFrame:
    """profile_id, path, samples, pct, depth, rank of the most frequent whole stacks."""
    rows = samples.groupBy("profile_id", fn.stack_to_string("stack").alias("path"), F.size("stack").alias("depth")).agg(F.sum("value").alias("samples"))
    whole = samples.groupBy("profile_id").agg(F.sum("value").alias("__all"))
    best = top(rows, ["profile_id"], [F.desc("samples"), F.asc("path")], n, "rank")
    return best.join(whole, "profile_id").select("profile_id", "path", "depth", "samples", percent("samples", "__all").alias("pct"), "rank")


def modules(rows: DataFrame) -> DataFrame:
    """profile_id, module, total_time, self_time, functions; frames without a module are `[unknown]`."""
    name = F.when(F.col("module") == "", "[unknown]").otherwise(F.col("module"))
    by = rows.groupBy("profile_id", name.alias("module"), "name").agg(F.sum("value").alias("total"), F.sum(F.when(F.col("is_leaf"), F.col("value")).otherwise(0)).alias("self"))
    return by.groupBy("profile_id", "module").agg(F.sum("total").alias("total_time"), F.sum("self").alias("self_time"), F.count("*").alias("functions"))


def module_functions(rows: DataFrame, n: int = 5) -> DataFrame:
    """profile_id, module, name, total_time, rank: each module's leading functions."""
    name = F.when(F.col("module") == "", "[unknown]").otherwise(F.col("module"))
    by = rows.groupBy("profile_id", name.alias("module"), "name").agg(F.sum("value").alias("total_time"))
    return top(by, ["profile_id", "module"], [F.desc("total_time"), F.asc("name")], n, "rank")


def recursive_functions(rows: DataFrame) -> DataFrame:
    """profile_id, node_id of nodes that stand in a stack more than once."""
    return rows.groupBy("profile_id", "node_id", "stack_id").agg(F.count("*").alias("n")).where("n > 1").select("profile_id", "node_id").distinct()


def top_nodes(points: DataFrame, by: str = "self_time", n: int = 50) -> DataFrame:
    return top(points, ["profile_id"], [F.desc(by), F.asc("node_id")], n, "rank")


def neighbours(points: DataFrame, links: DataFrame, side: str = "target", n: int = 10) -> DataFrame:
    """profile_id, node_id, neighbour, count, pct: the callers (side='target') or callees (side='source') of the points.

    The share is of all samples over the node's edges of that side.
    """
    other = "source" if side == "target" else "target"
    found = links.join(points.select("profile_id", F.col("node_id").alias(side)), ["profile_id", side], "left_semi")
    found = found.select("profile_id", F.col(side).alias("node_id"), F.col(other).alias("neighbour"), "count")
    whole = found.groupBy("profile_id", "node_id").agg(F.sum("count").alias("__all"))
    best = top(found, ["profile_id", "node_id"], [F.desc("count"), F.asc("neighbour")], n, "rank")
    return best.join(whole, ["profile_id", "node_id"]).select("profile_id", "node_id", "neighbour", "count", percent("count", "__all").alias("pct"), "rank")


def thread_graphs(rows: DataFrame, n: int = 50) -> DataFrame:
    """Edges of the n threads of most samples, each thread's graph its own."""
    best = top(rows.where("is_leaf").groupBy("profile_id", "tid").agg(F.sum("value").alias("samples")), ["profile_id"], [F.desc("samples"), F.asc("tid")], n)
    return edges(rows, by_thread=True).join(best, ["profile_id", "tid"], "left_semi")


def caller_chains(links: DataFrame, matches: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """node_id, depth of all nodes from which a match can be reached, by breadth-first search against the edges.

    One job a level, each level's frontier without nodes met before; it ends with an empty frontier. For a view it can
    end at max_depth, or at max_nodes: of the level that reaches those the first by name stay.
    """
    from ..plans.storage import stored

    links = stored(links.select("source", "target").distinct(), "links")  # as they are asked for at each level
    first = lambda rows, n: rows if n is None else rows.orderBy("node_id").limit(n)
    frontier = seen = stored(first(matches.select("node_id").distinct().withColumn("depth", F.lit(0)), max_nodes), "level")
    many, depth = seen.count(), 0
    while (max_depth is None or depth < max_depth) and (max_nodes is None or many < max_nodes):
        depth += 1
        step = links.join(frontier.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id")).distinct()
        step = step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(first(step, None if max_nodes is None else max_nodes - many), "level")
        found = frontier.count()
        if not found:
            break
        seen, many = seen.unionByName(frontier), many + found
        seen = seen if depth % 16 else stored(seen, "seen")
    return seen


def passed_on(links: DataFrame) -> DataFrame:
    """links (source, target, ends) where every target with one way on is replaced by where that way ends.

    ends says which targets are ends. Pointer doubling: a chain of n such nodes takes log n rounds. A way that runs in
    a circle has no end; its links are left out.
    """
    from ..plans.storage import stored

    links = stored(links.where("source <> target").distinct(), "links")
    onward = links.join(links.where("not ends").select(F.col("target").alias("source")).distinct(), "source", "left_semi")
    alone = stored(onward.groupBy("source").agg(F.min("target").alias("to"), F.count("*").alias("n")).where("n = 1").select(F.col("source").alias("node"), "to"), "alone")
    ptr, left = alone, alone.count()
    going = left > 0
    while going and left:
        step = ptr.select(F.col("node").alias("to"), F.col("to").alias("next"))
        ptr = stored(ptr.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "ways")
        going, left = not ptr.where("moved").isEmpty(), left // 2
    last = ptr.select("node", "to").join(alone.select(F.col("node").alias("to"), F.lit(True).alias("circles")), "to", "left")
    ways = last.select(F.col("node").alias("target"), F.when(F.col("circles").isNull(), F.col("to")).alias("to"), F.lit(True).alias("alone"))
    rest = links.join(alone.select(F.col("node").alias("source")), "source", "left_anti").join(ways, "target", "left")
    return rest.select("source", F.when(F.coalesce("alone", F.lit(False)), F.col("to")).otherwise(F.col("target")).alias("target")).where("target is not null and source <> target").distinct()


def bridges(links: DataFrame, hidden: DataFrame) -> DataFrame:
    """source, target of visible nodes joined only through hidden ones; hidden has node_id.

    Hidden nodes with one way on are drawn together first, however many follow each other. A path through those that
    branch ends where it would come to a pair that it had before, so the rounds are as many as such nodes on the
    longest way.
    """
    from ..plans.storage import stored

    links, hidden = stored(links.select("source", "target").distinct(), "links"), stored(hidden.select("node_id").distinct(), "hidden")
    is_hidden = lambda side: hidden.select(F.col("node_id").alias(side))
    marked = links.join(hidden.select(F.col("node_id").alias("target"), F.lit(False).alias("ends")), "target", "left").withColumn("ends", F.coalesce("ends", F.lit(True)))
    # Visible sources aren't drawn together: only hidden targets can be passed on from.
    short = stored(passed_on(marked), "short")
    outer = short.join(is_hidden("source"), "source", "left_anti")
    direct = outer.join(is_hidden("target"), "target", "left_anti")
    path = stored(outer.join(is_hidden("target"), "target", "left_semi").select("source", "target"), "paths")
    inner, met = stored(short.select(F.col("source").alias("target"), F.col("target").alias("next")).join(is_hidden("target"), "target", "left_semi"), "inner"), path
    found, rounds = direct.select("source", "target"), 0
    while not path.isEmpty():
        rounds += 1
        step = stored(path.join(inner, "target").select("source", F.col("next").alias("target")).distinct(), "steps")
        found = found.unionByName(step.join(is_hidden("target"), "target", "left_anti"))
        path = stored(step.join(is_hidden("target"), "target", "left_semi").join(met, ["source", "target"], "left_anti").select("source", "target"), "paths")
        met = met.unionByName(path)
        if rounds % 16 == 0:
            met, found = stored(met, "met"), stored(found.distinct(), "bridges")
    return found.where("source <> target").distinct().join(links, ["source", "target"], "left_anti").select("source", "target")


def documents(points: DataFrame, links: DataFrame) -> DataFrame:
    """profile_id, document: each profile's graph as one JSON text {nodes, edges}, nodes by name. Prune first."""
    node = F.struct(F.col("node_id").alias("id"), "name", "module", F.col("self_time").alias("selfTime"), F.col("total_time").alias("totalTime"), F.col("self_pct").alias("selfPct"), F.col("total_pct").alias("totalPct"))
    edge = F.struct("source", "target", "count", "weight")
    a = points.groupBy("profile_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    b = links.groupBy("profile_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    rows = a.join(b, "profile_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(b.schema["edges"].dataType)))
    return rows.select("profile_id", F.to_json(F.struct("nodes", "edges")).alias("document"))


#: Forms of labels in graph texts.
NODE_LABEL, EDGE_LABEL = "%s\n%s%%\n(%s%%)", "%s%%"


def dot_lines(points: DataFrame, links: DataFrame) -> DataFrame:
    """ord, line of a Graphviz text of one profile's graph."""
    quote = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    head = points.limit(1).select(F.lit(0).alias("ord"), F.lit("digraph callgraph {").alias("line"))
    node = points.select(F.lit(1).alias("ord"), F.format_string('  "%s" [label="%s\\n%s%%\\n(%s%%)"];', quote("node_id"), quote("name"), fixed("self_pct", 2), fixed("total_pct", 2)).alias("line"))
    edge = links.select(F.lit(2).alias("ord"), F.format_string('  "%s" -> "%s" [label="%s%%"];', quote("source"), quote("target"), fixed("weight", 2)).alias("line"))
    return head.unionByName(node).unionByName(edge).unionByName(points.limit(1).select(F.lit(3).alias("ord"), F.lit("}").alias("line")))


def xdot(points: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an ordinal and label, edges by the ordinals of their ends. For graphs pruned for display."""
    numbered = points.withColumn("ordinal", F.row_number().over(Window.partitionBy("profile_id").orderBy("node_id")) - 1)
    numbered = numbered.withColumn("label", F.format_string(NODE_LABEL, "name", fixed("self_pct", 2), fixed("total_pct", 2)))
    end = lambda side: numbered.select("profile_id", F.col("node_id").alias(side), F.col("ordinal").alias(f"{side}_ordinal"))
    return numbered, links.join(end("source"), ["profile_id", "source"]).join(end("target"), ["profile_id", "target"])
