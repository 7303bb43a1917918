"""Analyses by mode: what each kind of profile is put through, as named tables, under a preset of limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MODES, parse_mode, parse_preset
from ..operators import advisor, callgraph, flamegraph, heap, leaks, paths, retainers, stats
from ..sources import collapsed, graphs, pprof
from . import sinks
from .storage import kept, stored

Results = dict[str, DataFrame]


@dataclass(frozen=True)
class Preset:
    """Limits of an analysis; percentages are of the profile's total."""

    threads: bool = True
    flame_percent: float = 0.1
    functions_of_thread: int = 15
    functions: int = 50
    stacks_of_thread: int = 200
    stacks_of_function: int = 10
    hot_paths: int = 20
    paths: bool = True
    modules: bool = True
    node_percent: float = 0.5
    edge_percent: float = 0.1
    nodes: int = 50
    thread_graphs: int = 50
    idle: bool = False


#: The presets' limits.
PRESETS = {
    "quick": Preset(False, 0.5, 5, 20, 50, 3, 5, False, False, 1.0, 0.5, 20, 10),
    "standard": Preset(),
    "detailed": Preset(True, 0.05, 30, 100, 500, 20, 50, True, True, 0.1, 0.05, 100, 50),
}


def preset(name: str = "", **changes) -> Preset:
    return replace(PRESETS[parse_preset(name)], **changes)


class EmptyData(ValueError):
    """The input holds no samples or objects."""


def of_stacks(samples: DataFrame, limits: Preset) -> Results:
    """flame, call_nodes, call_edges, functions, totals, and with threads or modules what belongs to them."""
    busy = callgraph.busy(samples, limits.idle)
    frames = stored(callgraph.frames(busy), "frames")
    points, links = callgraph.prune(callgraph.nodes(frames), callgraph.edges(frames), limits.node_percent, limits.edge_percent)
    shown = samples if limits.idle else busy
    found = {
        "flame": flamegraph.prune(flamegraph.roll_up(shown), limits.flame_percent),
        "call_nodes": points,
        "call_edges": links,
        "functions": stats.top_functions(samples, limits.functions, limits.idle),
        "stacks_of_functions": stats.stacks_by_function(samples, limits.stacks_of_function, limits.idle),
        "threads": stats.top_threads(samples),
        "totals": stats.totals(samples),
    }
    if limits.threads:
        found |= {
            "thread_groups": stats.group_summaries(samples),
            "functions_of_threads": stats.functions_by_thread(samples, limits.functions_of_thread),
            "stacks_of_threads": stats.stacks_by_thread(samples, limits.stacks_of_thread),
            "thread_edges": callgraph.thread_graphs(frames, limits.thread_graphs),
        }
    if limits.paths:
        found["hot_paths"] = callgraph.hot_paths(busy, limits.hot_paths)
    if limits.modules:
        found["modules"] = callgraph.modules(frames)
    return found


def java_cpu(samples: DataFrame, limits: Preset) -> Results:
    found = of_stacks(samples, limits)
    return found | {"suggestions": _suggested(samples, limits, "cpu")}


def java_alloc(samples: DataFrame, limits: Preset) -> Results:
    """As java_cpu(), with the rules of allocations."""
    found = of_stacks(samples, limits)
    return found | {"suggestions": _suggested(samples, limits, "alloc")}


def _suggested(samples: DataFrame, limits: Preset, kind: str) -> DataFrame:
    return advisor.advise(stored(stats.top_functions(samples, limits.functions, limits.idle), "functions"), kind)


def java_heap(tables: dict[str, DataFrame], limits: Preset, retainers_of: int = 20, graphs_of: int | None = None, details: bool | None = None) -> Results:
    """histogram, classes, biggest, biggest_details, roots, roots_by_class, retainers, business_retainers, graph_nodes, graph_edges, suggestions, stats of a heap.

    biggest_details has the largest objects' fields and a path from a root, graphs are of the first graphs_of classes:
    both unless the preset is without paths.
    """
    details = limits.paths if details is None else details
    graphs_of = (5 if limits.paths else 0) if graphs_of is None else graphs_of
    objects = stored(tables["objects"].where("obj_id is not null").dropDuplicates(["obj_id"]), "objects")
    refs = kept(tables["refs"], "from_id")  # for all walks from referrers
    roots = stored(heap.root_list(tables["roots"], tables.get("class_objects")), "roots")
    doms = heap.dominators(refs, roots, keep=False)
    sizes = stored(heap.retained_with_collections(heap.retained(objects, doms), refs, deal=False), "sizes")
    histogram = stored(heap.histogram(objects), "histogram")
    by_class = stored(heap.class_retained(sizes), "by_class")
    found = {
        "stats": heap.graph_stats(objects, refs, roots),
        "histogram": heap.top_classes(histogram, 0),
        "classes": by_class,
        "biggest": heap.biggest_objects(sizes, 100, by="idea"),
        "roots": retainers.roots_by_size(roots, sizes),
        "roots_by_class": heap.roots_by_class(roots, sizes),
        "suggestions": advisor.advise_heap(histogram),
        "sizes": sizes,
    }
    if retainers_of:
        lead = heap.top_classes(histogram, min(10, retainers_of)).select("class_name")
        found["retainers"] = retainers.of_top_classes(refs, objects, histogram, by_class.where("retained is not null").select("class_name", "retained"), retainers_of)
        found["business_retainers"] = retainers.business(refs, objects, lead, roots)
    if details:
        found["biggest_details"] = paths.described(found["biggest"], refs, sizes, paths.ways_to(refs, roots, found["biggest"], 1))
    if graphs_of:
        found["graph_nodes"], found["graph_edges"] = retainers.sub_graphs(refs, objects, heap.top_classes(histogram, graphs_of).select("class_name"))
    return found


def pprof_stacks(profiles: DataFrame, limits: Preset, kinds: list[str]) -> Results:
    """of_stacks() of the first of kinds that the profiles have, functions by flat and by cum, totals by type."""
    has = profiles.select(F.explode("sample_types.type").alias("t")).distinct()
    held = {r.t for r in has.limit(1000).collect()}  # names of sample types
    kind = next((k for k in kinds if held & set(pprof.ALIASES.get(k, [k]))), kinds[0])
    found = of_stacks(pprof.to_samples(profiles, kind), limits)
    return found | {"by_flat": pprof.top_functions(profiles, kind, limits.functions), "by_cum": pprof.top_functions(profiles, kind, limits.functions, "cum"), "type_totals": pprof.totals(profiles)}


def pprof_cpu(profiles: DataFrame, limits: Preset) -> Results:
    return pprof_stacks(profiles, limits, ["cpu", "samples"])


HEAP_TYPES = ["inuse_space", "inuse_objects", "alloc_space", "alloc_objects"]


def pprof_heap(profiles: DataFrame, limits: Preset) -> Results:
    """The stacks of space in use; functions and distinct stacks of each of the four types, told by type."""
    found = pprof_stacks(profiles, limits, ["inuse_space", "alloc_space"])
    functions = stacks = None
    for kind in HEAP_TYPES:
        rows = pprof.top_functions(profiles, kind, limits.functions).withColumn("type", F.lit(kind))
        many = pprof.to_samples(profiles, kind).groupBy("profile_id").agg(F.count("*").alias("stacks"), F.sum("value").alias("total")).withColumn("type", F.lit(kind))
        functions, stacks = (rows, many) if functions is None else (functions.unionByName(rows), stacks.unionByName(many))
    return found | {"by_type": functions, "stacks_by_type": stacks}


def pprof_goroutine(profiles: DataFrame, limits: Preset) -> Results:
    found = pprof_stacks(profiles, limits, ["goroutine"])
    return found | {"groups": pprof.goroutine_groups(profiles)}


def pprof_contention(profiles: DataFrame, limits: Preset) -> Results:
    """Delay first, then contentions: the stacks are of the first of them that the profiles have."""
    found = pprof_stacks(profiles, limits, ["delay", "contentions"])
    return found | {"by_contentions": pprof.top_functions(profiles, "contentions", limits.functions)}


def pprof_all(profiles: DataFrame, limits: Preset) -> Results:
    """Each kind's latest profile through its mode, results named kind.result; and the leaks of heaps and goroutines."""
    latest = stored(pprof.latest(profiles), "latest")
    kinds = {r.profile_type for r in latest.select("profile_type").distinct().limit(100).collect()}  # names of kinds
    found: Results = {}
    for kind, mode in {"cpu": pprof_cpu, "heap": pprof_heap, "goroutine": pprof_goroutine, "block": pprof_contention, "mutex": pprof_contention}.items():
        if kind in kinds:
            found |= {f"{kind}.{name}": rows for name, rows in mode(latest.where(F.col("profile_type") == kind), limits).items()}
    found["leaks"] = leak_reports(profiles)
    return found


def leak_reports(profiles: DataFrame) -> DataFrame:
    """kind, baseline_total, current_total, growth, growth_pct, per_minute, severity, advice: the first profile of a kind and its last."""
    out = None
    for kind, value in (("heap", "inuse_space"), ("goroutine", "goroutine")):
        rows = profiles.where(F.col("profile_type") == kind)
        ends = rows.agg(F.min(F.struct("captured_at", "profile_id")).alias("a"), F.max(F.struct("captured_at", "profile_id")).alias("b")).head()
        if ends.a is None or ends.a.profile_id == ends.b.profile_id:
            continue
        samples = pprof.to_samples(rows, value)
        one = lambda at: samples.where(F.col("profile_id") == at.profile_id)  # noqa: E731, B023
        report = leaks.report(one(ends.a), one(ends.b), kind, (ends.b.captured_at - ends.a.captured_at).total_seconds()).select(F.lit(kind).alias("kind"), "*")
        out = report if out is None else out.unionByName(report)
    empty = "kind string, baseline_total long, current_total long, growth long, growth_pct double, per_minute double, severity string, advice string"
    return out if out is not None else profiles.sparkSession.createDataFrame([], empty)


#: Mode by name: what it reads, and what it makes of it. Add more.
ANALYZERS: dict[str, tuple[str, Callable[..., Results]]] = {
    "java-cpu": ("collapsed", java_cpu), "cpu": ("collapsed", java_cpu), "java-alloc": ("collapsed", java_alloc), "java-heap": ("hprof", java_heap), "pprof-cpu": ("pprof", pprof_cpu), "pprof-heap": ("pprof", pprof_heap),
    "pprof-goroutine": ("pprof", pprof_goroutine), "pprof-block": ("pprof", pprof_contention), "pprof-mutex": ("pprof", pprof_contention), "pprof-all": ("pprof", pprof_all),
}


def mode_of(task_type: int, profiler: int) -> str:
    """The mode of a task's type and profiler; a type's first mode where no mode has both."""
    fits = [m for m, (t, p) in MODES.items() if (t, p) == (task_type, profiler)] or [m for m, (t, _) in MODES.items() if t == task_type]
    if not fits:
        raise ValueError(f"no mode for tasks of type {task_type}")
    return fits[0]


def analyze(data: DataFrame | dict[str, DataFrame], mode: str, limits: Preset | str = "") -> Results:
    """A mode's results of samples, profiles or a heap's tables; EmptyData where there are none."""
    _, run = ANALYZERS[parse_mode(mode)]
    if (data["objects"] if isinstance(data, dict) else data).isEmpty():
        raise EmptyData(f"no data for {mode}")
    return run(data, preset(limits) if isinstance(limits, str) else limits)


def run(spark: SparkSession, path: str, mode: str, limits: Preset | str = "", out: str | None = None, codec: str = "gzip", options: collapsed.Options | None = None) -> Results:
    """Read path in the mode's format, analyze it, and write the results under out, a folder each, if it is given.

    options, of collapsed text, go before the limits' own numbers.
    """
    kind, _ = ANALYZERS[parse_mode(mode)]
    limits = preset(limits) if isinstance(limits, str) else limits
    if options and kind == "collapsed":
        limits = replace(limits, functions=options.top, idle=options.include_idle)
        data = graphs.read(spark, path, kind, options=options)
    else:
        data = graphs.read(spark, path, kind)
    results = analyze(stored(data, "samples") if isinstance(data, DataFrame) else data, mode, limits)
    if options and kind == "collapsed":
        results["functions"] = results["functions"].where(F.col("self_pct") >= options.min_sample_percent)
    if out:
        for name, rows in results.items():
            sinks.write_json(rows, f"{out}/{name}", codec)
        if "flame" in results:
            sinks.write_documents(flamegraph.documents(results["flame"]), f"{out}/flame_documents", codec)
            sinks.write_documents(callgraph.documents(results["call_nodes"], results["call_edges"]), f"{out}/call_documents", codec)
    return results


def namespace(results: Results, functions: int = 15) -> DataFrame:
    """profile_id, document: leading functions, threads and stacks of each profile as one JSON text."""
    entry = lambda rows, name, *columns: rows.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    parts = [
        entry(results["functions"].where(F.col("rank") <= functions), "top_functions", "rank", "func", "self", "self_pct"),
        entry(results["threads"], "threads", "rank", "tid", "thread_name", "samples", "pct"),
        entry(results["stacks_of_functions"].where(F.col("rank") <= 5), "stacks", "func", "rank", "stack", "samples"),
    ]
    rows = results["totals"].select("profile_id", "total_samples")
    for p in parts:
        rows = rows.join(p, "profile_id", "left")
    return rows.select("profile_id", F.to_json(F.struct("total_samples", "top_functions", "threads", "stacks")).alias("document"))


#: Result, its name's and value's column, by mode: what a summary lists.
TOP_ITEMS = {
    "java-cpu": ("functions", "func", "self_pct"), "cpu": ("functions", "func", "self_pct"), "java-alloc": ("functions", "func", "self_pct"), "java-heap": ("histogram", "class_name", "pct"), "pprof-cpu": ("by_flat", "func", "flat_pct"),
    "pprof-heap": ("by_flat", "func", "flat_pct"), "pprof-goroutine": ("groups", "top_func", "pct"), "pprof-block": ("by_flat", "func", "flat_pct"), "pprof-mutex": ("by_flat", "func", "flat_pct"),
}


def top_items(results: Results, mode: str, n: int = 10) -> DataFrame:
    """(profile_id,) name, value of the n leading items of a mode's results, of each profile."""
    result, name, value = TOP_ITEMS[parse_mode(mode)]
    rows = results[result].select(*(c for c in ("profile_id",) if c in results[result].columns), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    if "profile_id" not in rows.columns:
        return rows.orderBy(F.desc("value"), "name").limit(n)
    return stats.top(rows, ["profile_id"], [F.desc("value"), F.asc("name")], n, "rank")


def cpu_of_flame(nodes: DataFrame) -> Results:
    """threads, stacks and totals of a flame graph whose first frames are threads, as a CPU analysis has them."""
    first = nodes.where("depth = 1").select("profile_id", F.col("name").alias("thread_name"), F.col("value").alias("samples"))
    stacks = nodes.where("depth > 0 and self > 0").select("profile_id", F.element_at("path", 1).alias("thread_name"), F.concat_ws(";", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).alias("stack"), F.col("self").alias("samples"))
    return {"threads": first, "stacks": stacks, "totals": nodes.where("depth = 0").select("profile_id", F.col("value").alias("total_samples"))}

