"""Registered queries over the sample stand-ins, each with its DuckDB SQL; keys begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, values
from ..functions import frames as fn
from ..operators import callgraph as cg
from ..operators import flamegraph as fg
from ..operators import stats
from ..sources import collapsed
from . import standins as st
from .storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return keep


def on_samples(name: str, operator: Callable[[DataFrame], DataFrame], sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.samples(spark, d)))


def on_frames(name: str, operator: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over frames of the stand-in's stacks, which are stored, as operators look at frames twice or more."""
    on_samples(name, lambda s: operator(cg.frames_of(stored(cg.stacks(cg.busy(s)), "stacks"))), sql)


def text(column: str):
    return F.concat_ws(";", column)


S, E, W = st.SAMPLES, st.EVENT_SAMPLES, st.WHOLE

# Parsing
register("A02_collapsed_parse", f"with {E} select profile_id, sample_id, thread_name, tid, array_to_string(stack, ';') as stack, value from event_samples")(
    lambda spark, d: st.event_samples(spark, d).withColumn("stack", text("stack"))
)
register("A01_collapsed_lenient", f"with {E} select profile_id, sample_id, thread_name, tid, array_to_string(stack, ';') as stack, value from event_samples where sample_id % 10 not in (1, 2, 3)")(
    lambda spark, d: st.event_samples(spark, d, malformed=True).withColumn("stack", text("stack"))
)
register("A03_format_sniff", "select event_id as sample_id, event_id % 10 not in (1, 2, 3) as collapsed from events")(
    lambda spark, d: st.line_text(spark, d, malformed=True).select("sample_id", collapsed.looks_collapsed("line").alias("collapsed"))
)
register(
    "C01_split_func_module",
    "select distinct p_type || '(' || p_brand || ')' as frame, p_type as func, p_brand as module, p_type || '(' || p_brand || ')' as node from part",
)(lambda spark, d: st.table(spark, d, "part").select(F.concat("p_type", F.lit("("), "p_brand", F.lit(")")).alias("frame")).distinct().select("frame", fn.frame_function("frame").alias("func"), fn.frame_module("frame").alias("module"), fn.node_id(fn.frame_function("frame"), fn.frame_module("frame")).alias("node")))
register("C02_thread_info", "select s_suppkey, s_name || '-x/' || s_suppkey as frame, s_name as thread_name, cast(s_suppkey as integer) as tid from supplier")(
    lambda spark, d: st.table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("-x/"), F.col("s_suppkey").cast("string")).alias("frame")).select("s_suppkey", "frame", fn.thread_name("frame").alias("thread_name"), fn.thread_id("frame").alias("tid"))
)
register("C03_idle_threads", f"with {S} select distinct thread_name, thread_name = 'swapper' or thread_name like 'swapper-%' as idle, thread_name = 'swapper/0' as idle_in_graphs from samples")(
    lambda spark, d: st.samples(spark, d).select("thread_name").distinct().select("thread_name", fn.is_idle("thread_name").alias("idle"), fn.is_idle_in_graphs("thread_name").alias("idle_in_graphs"))
)
register("C06_thread_group", "select distinct c_name, regexp_replace(c_name, '[0-9_#-]+$', '') as thread_group from customer")(
    lambda spark, d: st.table(spark, d, "customer").select("c_name").distinct().select("c_name", fn.thread_group("c_name").alias("thread_group"))
)
register("C12_go_module", "select doc_id, 'github.com/' || source || '/pkg.Func' || (doc_id % 7) as func, 'github.com/' || source || '/pkg' as module from documents")(
    lambda spark, d: st.table(spark, d, "documents").select("doc_id", F.concat(F.lit("github.com/"), "source", F.lit("/pkg.Func"), (F.col("doc_id") % 7).cast("string")).alias("func")).select("doc_id", "func", fn.go_module("func").alias("module"))
)
register(
    "C16_class_name",
    "select p_partkey, replace(p_type, ' ', '.') || repeat('[]', cast(p_size % 3 as integer)) as name from part",
)(lambda spark, d: st.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat(F.repeat(F.lit("["), (F.col("p_size") % 3)), F.lit("L"), F.translate("p_type", " ", "/"), F.lit(";"))).otherwise(F.translate("p_type", " ", "/")).alias("n")).select("p_partkey", fn.class_name("n").alias("name")))
register("C17_object_id", "select o_orderkey as id, '0x' || lower(to_hex(o_orderkey)) as text from orders")(
    lambda spark, d: st.table(spark, d, "orders").select(fn.hex_address("o_orderkey").alias("text")).select("text", fn.parse_object_id("text").alias("id"))
)
register("C23_allocation_mark", "select event_id, case when event_id % 3 = 0 then 'instance' when event_id % 3 = 1 then 'size' end as kind, event_type as func from events")(
    lambda spark, d: st.table(spark, d, "events").select("event_id", F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_[i]").when(F.col("event_id") % 3 == 1, "_[k]").otherwise("")).alias("f")).select("event_id", fn.allocation_kind("f").alias("kind"), fn.without_allocation_mark("f").alias("func"))
)
register("C24_method_parts", "select distinct source, 'java' as type, 'com.' || source as package, 'Reader' as class, 'read' as method, 'Reader.read' as term from documents")(
    lambda spark, d: st.table(spark, d, "documents").select("source", F.concat(F.lit("com."), "source", F.lit(".Reader.read")).alias("f")).distinct().select("source", fn.method_parts("f").alias("m"), fn.search_term("f").alias("term")).select("source", "m.type", "m.package", "m.class", "m.method", "term")
)
register("C28_system_function", "select distinct event_type, event_type like '%click%' as is_system from events")(
    lambda spark, d: st.table(spark, d, "events").select("event_type").distinct().select("event_type", fn.is_system_function(F.when(F.col("event_type").contains("click"), F.concat(F.lit("java.util."), "event_type")).otherwise(F.concat(F.lit("com.app."), "event_type")), ["jvm", "gc"]).alias("is_system"))
)
register("D01_align8", "select p_partkey, cast((p_size + 12 + 7) // 8 * 8 as bigint) as size, cast((12 + 60 + 20 + p_size * 4 + 7) // 8 * 8 as bigint) as class_size from part")(
    lambda spark, d: st.table(spark, d, "part").select("p_partkey", values.align8(F.col("p_size") + 12).alias("size"), values.class_object_size("p_size").alias("class_size"))
)
register("D07_task_priority", f"with {st.TASKS} select id, duration between 1 and 120 as high, case when type in (0,3,10) then 'CPU' when type = 1 then 'App' when type = 2 then 'Disk' when type in (4,5,6,7,8,11) then 'Memory' when type = 12 then 'Goroutine' when type in (13,14) then 'Concurrency' else 'Unknown' end as resource from tasks")(
    lambda spark, d: st.tasks(spark, d).select("id", values.is_high_priority("duration").alias("high"), values.resource_type("type").alias("resource"))
)
_NAMES = "case when source in ('src0','src1') then 'java.util.' || source when source = 'src2' then 'byte[]' when source = 'src3' then 'io.netty.util.internal.' || source when source = 'src4' then 'com.acme.' || source || '$$Lambda' else 'com.acme.' || source end"


def _class_names(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    name = F.when(s.isin("src0", "src1"), F.concat(F.lit("java.util."), s)).when(s == "src2", "byte[]").when(s == "src3", F.concat(F.lit("io.netty.util.internal."), s)).when(s == "src4", F.concat(F.lit("com.acme."), s, F.lit("$$Lambda")))
    return st.table(spark, d, "documents").select("doc_id", "n_chars", name.otherwise(F.concat(F.lit("com.acme."), s)).alias("name"))


register(
    "D11_class_category",
    f"select doc_id, {_NAMES} as name, case when source = 'src2' then 'primitive' when source in ('src0','src1') then 'jdk' when source = 'src3' then 'framework' else 'application' end as category, source in ('src2', 'src4') as filtered from documents",
)(lambda spark, d: _class_names(spark, d).select("doc_id", "name", classes.class_category("name").alias("category"), classes.is_top_level_filtered("name").alias("filtered")))
register("F32_packages", f"select regexp_replace(name, '\\.[^.]*$', '') as package, cast(sum(n_chars) as bigint) as size, count(*) as instances, count(distinct name) as classes from (select {_NAMES} as name, n_chars from documents) where contains(name, '.') group by 1 union all select 'default', cast(sum(n_chars) as bigint), count(*), count(distinct source) from documents where source = 'src2' having count(*) > 0")(
    lambda spark, d: _class_names(spark, d).groupBy(fn.package_name("name").alias("package")).agg(F.sum("n_chars").alias("size"), F.count("*").alias("instances"), F.countDistinct("name").alias("classes"))
)

# Statistics
on_samples("F01_self_by_function", stats.self_by_function, f"with {S}, t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all) select f.*, self / total * 100 as self_pct from f join t using (profile_id)")
on_samples("G01_top_functions", stats.top_functions, f"with {S}, t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all), r as (select *, cast(row_number() over (partition by profile_id order by self desc, func) as integer) as rank from f) select r.profile_id, func, self, self / total * 100 as self_pct, rank from r join t using (profile_id) where rank <= 15")
on_samples("F02_stacks_by_function", stats.stacks_by_function, f"with {S}, f as (select profile_id, stack[-1] as func, array_to_string(stack, ';') as stack, cast(sum(value) as bigint) as samples from samples group by all), r as (select *, cast(row_number() over (partition by profile_id, func order by samples desc, stack) as integer) as rank, count(*) over (partition by profile_id, func) as distinct_stacks from f) select * from r where rank <= 5")
_THREADS = f"{S}, threads as (select profile_id, tid, arg_min(thread_name, sample_id) as thread_name, cast(sum(value) as bigint) as samples from samples group by all), t as (select profile_id, cast(sum(value) as bigint) as total, cast(sum(case when thread_name <> 'swapper/0' then value else 0 end) as bigint) as busy from samples group by 1)"
on_samples("F03_threads", stats.threads, f"with {_THREADS} select threads.*, samples / total * 100 as pct from threads join t using (profile_id)")
on_samples("G05_top_threads", lambda s: stats.top_threads(s, 5), f"with {_THREADS}, r as (select *, cast(row_number() over (partition by profile_id order by samples desc, tid) as integer) as rank from threads) select r.*, samples / total * 100 as pct from r join t using (profile_id) where rank <= 5")
on_samples("F12_thread_summary", stats.thread_summary, f"with {S} select profile_id, count(distinct tid) as total_threads, count(distinct case when value > 0 then tid end) as active_threads, (select count(distinct f) from (select unnest(stack) as f, profile_id as q from samples) where q = samples.profile_id) as unique_functions, cast(max(len(stack)) as bigint) as max_depth from samples group by profile_id")
on_samples("F13_thread_groups", stats.thread_groups, f"with {_THREADS}, g as (select profile_id, case when regexp_replace(thread_name, '[0-9_#-]+$', '') = '' then thread_name else regexp_replace(thread_name, '[0-9_#-]+$', '') end as thread_group, count(*) as threads, cast(sum(samples) as bigint) as samples, arg_max(thread_name, [lpad(cast(samples as varchar), 20, '0'), thread_name]) as top_thread from threads where thread_name <> 'swapper/0' group by all) select g.profile_id, thread_group, threads, samples, samples / busy * 100 as pct, top_thread from g join t using (profile_id)")
on_samples("E06_thread_filter", lambda s: stats.filter_threads(stats.threads(s), min_samples=100, group="worker", name="ER-1"), f"with {_THREADS} select threads.*, samples / total * 100 as pct from threads join t using (profile_id) where samples >= 100 and thread_name like 'worker-1%'")
on_samples("G03_functions_by_thread", lambda s: stats.functions_by_thread(s, 3), f"with {S}, f as (select profile_id, tid, stack[-1] as func, cast(sum(value) as bigint) as samples from samples group by all), t as (select profile_id, tid, cast(sum(value) as bigint) as total from samples group by all), r as (select *, cast(row_number() over (partition by profile_id, tid order by samples desc, func) as integer) as rank from f) select profile_id, tid, func, samples, samples / total * 100 as pct, rank from r join t using (profile_id, tid) where rank <= 3")
on_samples("G04_stacks_by_thread", lambda s: stats.stacks_by_thread(s, 20), f"with {S}, f as (select profile_id, tid, array_to_string(stack, ';') as stack, cast(sum(value) as bigint) as samples from samples group by all) select * from (select *, cast(row_number() over (partition by profile_id, tid order by samples desc, stack) as integer) as rank from f) where rank <= 20")
on_samples("F15_function_threads", stats.function_threads, f"with {S} select profile_id, stack[-1] as func, tid, cast(sum(value) as bigint) as samples from samples where thread_name <> 'swapper/0' group by all")
on_samples("F35_top_and_others", lambda s: stats.with_others(stats.self_by_function(s).groupBy("func").agg(F.sum("self").alias("self")), "func", "self", 10), f"with {S}, f as (select stack[-1] as func, cast(sum(value) as bigint) as self from samples group by 1), r as (select *, row_number() over (order by self desc, func) as r from f) select func, self from r where r <= 10 union all select 'Others', cast(sum(self) as bigint) from r where r > 10 having count(*) > 0")
on_samples("G19_search", lambda s: stats.search(stats.self_by_function(s).select("profile_id", "func", "self"), ["func"], "econ", "self", 12), f"with {S}, f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all) select * from f where contains(lower(func), 'econ') order by self desc, func, profile_id limit 12")
on_samples("G21_page", lambda s: stats.page(stats.self_by_function(s).select("profile_id", "func", "self"), [F.desc("self"), F.asc("func"), F.asc("profile_id")], 3, 20), f"with {S}, f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all) select * from f order by self desc, func, profile_id limit 20 offset 40")

# Flame graphs
_NODES = "nodes as (select profile_id, list_slice(stack, 1, i) as p, i as depth, cast(sum(value) as bigint) as value, cast(sum(case when i = 5 then value else 0 end) as bigint) as self from samples, (select unnest(range(6)) as i) group by all)"
_NODE_ROWS = "profile_id, array_to_string(p, ';') as path, cast(depth as integer) as depth, case when depth = 0 then 'root' else p[-1] end as name, value, self"
flat = lambda nodes: nodes.withColumn("path", text("path"))
on_samples("F10_flame_roll_up", lambda s: flat(fg.roll_up(s)), f"with {S}, {_NODES} select {_NODE_ROWS} from nodes")
on_samples("F11_flame_by_thread", lambda s: flat(fg.roll_up(s, by_thread=True)), f"with {S}, nodes as (select profile_id, tid, list_slice(stack, 1, i) as p, i as depth, cast(sum(value) as bigint) as value, cast(sum(case when i = 5 then value else 0 end) as bigint) as self from samples, (select unnest(range(6)) as i) where value > 0 group by all) select tid, {_NODE_ROWS} from nodes")
on_samples("K01_flame_with_thread", lambda s: flat(fg.roll_up(s, thread_frame=True)), f"with {S}, nodes as (select profile_id, list_slice(list_prepend(thread_name, stack), 1, i) as p, i as depth, cast(sum(value) as bigint) as value, cast(sum(case when i = 6 then value else 0 end) as bigint) as self from samples, (select unnest(range(7)) as i) group by all) select {_NODE_ROWS} from nodes")
on_samples("E04_flame_prune", lambda s: flat(fg.prune(fg.roll_up(s), 0.5)), f"with {S}, {_NODES}, r as (select profile_id, cast(floor(value * 0.5 / 100) as bigint) as least from nodes where depth = 0) select {_NODE_ROWS} from nodes join r using (profile_id) where depth = 0 or value >= least")
on_samples("F34_flame_stats", lambda s: fg.tree_stats(fg.roll_up(s)), f"with {S}, {_NODES} select profile_id, max(case when depth = 0 then value end) as total, count(case when depth > 0 then 1 end) as nodes, count(distinct case when depth > 0 then p[-1] end) as distinct_names, cast(max(depth) as integer) as max_depth from nodes group by 1")
on_samples("E10_flame_search", lambda s: flat(fg.search(fg.roll_up(s), "brand#2")).select("profile_id", "path", "value"), f"with {S}, {_NODES} select profile_id, array_to_string(p, ';') as path, value from nodes where depth > 0 and contains(lower(p[-1]), 'brand#2')")
on_samples("B03_folded_lines", lambda s: fg.folded(fg.roll_up(s)), f"with {S}, {_NODES} select profile_id, array_to_string(p, ';') || ' ' || value as line from nodes where depth = 5")
on_samples("G06_global_top", lambda s: fg.global_top(s, 50), f"with {S}, f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as samples, count(distinct tid) as threads from samples where thread_name <> 'swapper/0' group by all), t as (select profile_id, cast(sum(value) as bigint) as total from samples where thread_name <> 'swapper/0' group by 1), r as (select *, cast(row_number() over (partition by profile_id order by samples desc, func) as integer) as rank from f) select profile_id, func, samples, samples / total * 100 as pct, threads, rank from r join t using (profile_id) where rank <= 50")
on_samples("K07_collapse_filtered", lambda s: flat(fg.roll_up(fg.without_functions(s.withColumn("stack", F.transform("stack", lambda x: F.when(x == "BUILDING", "java.util.Building").otherwise(x))), ["jvm"]))), f"with {S}, k as (select profile_id, list_filter(stack, lambda x: x <> 'BUILDING') as stack, value from samples), nodes as (select profile_id, list_slice(stack, 1, i) as p, i as depth, cast(sum(value) as bigint) as value, cast(sum(case when i = len(stack) then value else 0 end) as bigint) as self from k, (select unnest(range(6)) as i) where i <= len(stack) group by all) select {_NODE_ROWS} from nodes")
on_samples("K11_one_thread", lambda s: flat(fg.roll_up(s.where("tid = 3"))), f"with {S.replace('samples as (', 'everything as (', 1)}, samples as (select * from everything where tid = 3), {_NODES} select {_NODE_ROWS} from nodes")

# Call graphs
_POINTS = "points as (select profile_id, node_id, min(name) as name, min(module) as module, cast(sum(case when is_leaf then value else 0 end) as bigint) as self_time, cast(sum(value) as bigint) as total_time, cast(sum(times) as bigint) as call_count, cast(max(pos) as integer) as max_depth, false as is_recursive from frames group by profile_id, node_id), nodes as (select points.*, self_time / total * 100 as self_pct, total_time / total * 100 as total_pct from points join alls using (profile_id))"
_EDGES = "links as (select profile_id, caller as source, node_id as target, cast(sum(value) as bigint) as count from frames where caller is not null group by all), edges as (select links.*, count / total * 100 as weight from links join alls using (profile_id))"
on_frames("F16_call_nodes", cg.nodes, f"with {W}, {_POINTS} select * from nodes")
on_frames("F17_call_self", lambda f: cg.nodes(f).where("self_time > 0").select("profile_id", "node_id", "self_time", "self_pct"), f"with {W}, {_POINTS} select profile_id, node_id, self_time, self_pct from nodes where self_time > 0")
on_frames("F18_call_edges", cg.edges, f"with {W}, {_EDGES} select * from edges")
on_frames("F19_call_degrees", lambda f: cg.degrees(cg.edges(f)), f"with {W}, {_EDGES}, b as (select profile_id, source as node_id, 0 as i, 1 as o from links union all select profile_id, target, 1, 0 from links) select profile_id, node_id, cast(sum(i) as bigint) as caller_count, cast(sum(o) as bigint) as callee_count from b group by all")
on_samples("F20_recursion", lambda s: cg.recursive_functions(cg.frames(cg.busy(s.withColumn("stack", F.concat("stack", F.array(F.get("stack", F.lit(2)))))))), f"with {S} select distinct profile_id, stack[3] as node_id from samples where thread_name <> 'swapper/0'")
on_samples("F21_hot_paths", lambda s: cg.hot_paths(cg.busy(s), 20), f"with {W}, f as (select profile_id, array_to_string(stack, ';') as path, cast(5 as integer) as depth, cast(sum(value) as bigint) as samples from whole group by all), r as (select *, cast(row_number() over (partition by profile_id order by samples desc, path) as integer) as rank from f) select profile_id, path, depth, samples, samples / total * 100 as pct, rank from r join alls using (profile_id) where rank <= 20")
on_frames("F22_modules", cg.modules, f"with {W} select profile_id, case when module = '' then '[unknown]' else module end as module, cast(sum(value) as bigint) as total_time, cast(sum(case when is_leaf then value else 0 end) as bigint) as self_time, count(distinct name) as functions from frames group by 1, 2")
on_frames("F22_module_functions", cg.module_functions, f"with {W}, m as (select profile_id, case when module = '' then '[unknown]' else module end as module, name, cast(sum(value) as bigint) as total_time from frames group by 1, 2, 3) select * from (select *, cast(row_number() over (partition by profile_id, module order by total_time desc, name) as integer) as rank from m) where rank <= 5")
on_frames("F23_thread_edges", lambda f: cg.edges(f, by_thread=True), f"with {W}, l as (select profile_id, tid, caller as source, node_id as target, cast(sum(value) as bigint) as count from frames where caller is not null group by all), t as (select profile_id, tid, cast(sum(value) as bigint) as total from whole group by all) select l.*, count / total * 100 as weight from l join t using (profile_id, tid)")
on_frames("F24_graph_stats", lambda f: cg.graph_stats(cg.nodes(f), cg.edges(f)), f"with {W}, {_POINTS}, {_EDGES}, a as (select profile_id, count(*) as nodes, max(self_pct) as max_self_pct, max(total_pct) as max_total_pct, cast(0 as bigint) as recursive from nodes group by 1) select a.*, e.edges from a join (select profile_id, count(*) as edges from edges group by 1) e using (profile_id)")
on_frames("E05_call_prune_nodes", lambda f: cg.prune(cg.nodes(f), cg.edges(f), 2.0, 0.5)[0].select("profile_id", "node_id", "total_time"), f"with {W}, {_POINTS} select profile_id, node_id, total_time from nodes where total_pct >= 2.0")
on_frames("E05_call_prune_edges", lambda f: cg.prune(cg.nodes(f), cg.edges(f), 2.0, 0.5)[1].select("profile_id", "source", "target", "count"), f"with {W}, {_POINTS}, {_EDGES} select e.profile_id, source, target, e.count from edges e join nodes a on e.profile_id = a.profile_id and a.node_id = source and a.total_pct >= 2.0 join nodes b on e.profile_id = b.profile_id and b.node_id = target and b.total_pct >= 2.0 where weight >= 0.5")
on_frames("G07_top_by_self", lambda f: cg.top_nodes(cg.nodes(f), "self_time", 20).select("profile_id", "node_id", "self_time", "rank"), f"with {W}, {_POINTS} select * from (select profile_id, node_id, self_time, cast(row_number() over (partition by profile_id order by self_time desc, node_id) as integer) as rank from nodes) where rank <= 20")
on_frames("G07_top_by_total", lambda f: cg.top_nodes(cg.nodes(f), "total_time", 20).select("profile_id", "node_id", "total_time", "rank"), f"with {W}, {_POINTS} select * from (select profile_id, node_id, total_time, cast(row_number() over (partition by profile_id order by total_time desc, node_id) as integer) as rank from nodes) where rank <= 20")
on_frames("G07_callers", lambda f: cg.neighbours(cg.top_nodes(cg.nodes(f), "self_time", 20), cg.edges(f), "target", 3), f"with {W}, {_POINTS}, {_EDGES}, best as (select profile_id, node_id from (select *, row_number() over (partition by profile_id order by self_time desc, node_id) as r from nodes) where r <= 20), c as (select e.profile_id, e.target as node_id, e.source as neighbour, e.count from links e join best b on e.profile_id = b.profile_id and e.target = b.node_id), t as (select profile_id, node_id, cast(sum(count) as bigint) as total from c group by all), r as (select *, cast(row_number() over (partition by profile_id, node_id order by count desc, neighbour) as integer) as rank from c) select r.profile_id, r.node_id, neighbour, count, count / total * 100 as pct, rank from r join t on r.profile_id = t.profile_id and r.node_id = t.node_id where rank <= 3")
on_frames("G09_thread_graphs", lambda f: cg.thread_graphs(f, 4).select("profile_id", "tid", "source", "target", "count"), f"with {W}, t as (select profile_id, tid, cast(sum(value) as bigint) as total, row_number() over (partition by profile_id order by sum(value) desc, tid) as r from whole group by profile_id, tid) select f.profile_id, f.tid, caller as source, node_id as target, cast(sum(value) as bigint) as count from frames f join t on f.profile_id = t.profile_id and f.tid = t.tid where caller is not null and r <= 4 group by all")
on_frames("K09_caller_chains", lambda f: cg.caller_chains(cg.edges(f), cg.nodes(f).where("node_id like 'ECONOMY(Brand#1%'").select("node_id")), f"with recursive {W}, e as (select distinct caller as source, node_id as target from frames where caller is not null), seen as (select distinct node_id, 0 as depth from frames where node_id like 'ECONOMY(Brand#1%' union select e.source, depth + 1 from seen join e on e.target = seen.node_id) select node_id, cast(min(depth) as integer) as depth from seen group by 1")
on_frames("K10_bridges", lambda f: cg.bridges(cg.edges(f), f.where("pos = 2").select("node_id").distinct()), f"with {W}, e as (select distinct caller as source, node_id as target, pos from frames where caller is not null) select distinct a.source, b.target from e a join e b on a.target = b.source where a.pos = 2 and b.pos = 3")
on_frames("B05_xdot_edges", lambda f: cg.xdot(cg.nodes(f).where("total_pct >= 3"), cg.edges(f))[1].select("profile_id", "source_ordinal", "target_ordinal", "count"), f"with {W}, {_POINTS}, {_EDGES}, o as (select profile_id, node_id, cast(row_number() over (partition by profile_id order by node_id) - 1 as integer) as ordinal from nodes where total_pct >= 3) select e.profile_id, a.ordinal as source_ordinal, b.ordinal as target_ordinal, e.count from links e join o a on e.profile_id = a.profile_id and e.source = a.node_id join o b on e.profile_id = b.profile_id and e.target = b.node_id")
on_frames("B06_dot_lines", lambda f: cg.dot_lines(*(x.where("profile_id = 'p0'") for x in cg.prune(cg.nodes(f), cg.edges(f), 3.0, 0.5))).groupBy("ord").agg(F.count("*").alias("lines")), f"with {W}, {_POINTS}, {_EDGES}, n as (select * from nodes where total_pct >= 3.0 and profile_id = 'p0') select 0 as ord, cast(1 as bigint) as lines union all select 1, count(*) from n union all select 2, count(*) from edges where profile_id = 'p0' and weight >= 0.5 and source in (select node_id from n) and target in (select node_id from n) union all select 3, 1")
on_frames("B05_xdot_nodes", lambda f: cg.xdot(cg.nodes(f).where("total_pct >= 3"), cg.edges(f))[0].select("profile_id", "node_id", "ordinal", "label"), f"with {W}, {_POINTS} select profile_id, node_id, cast(row_number() over (partition by profile_id order by node_id) - 1 as integer) as ordinal, printf('%s\n%.2f%%\n(%.2f%%)', name, self_pct, total_pct) as label from nodes where total_pct >= 3")
on_frames("B06_dot_text", lambda f: cg.dot_lines(*(x.where("profile_id = 'p0'") for x in cg.prune(cg.nodes(f), cg.edges(f), 3.0, 0.5))), f"with {W}, {_POINTS}, {_EDGES}, n as (select * from nodes where total_pct >= 3.0 and profile_id = 'p0') select 0 as ord, 'digraph callgraph {{' as line union all select 1, printf('  \"%s\" [label=\"%s\\n%.2f%%\\n(%.2f%%)\"];', node_id, name, self_pct, total_pct) from n union all select 2, printf('  \"%s\" -> \"%s\" [label=\"%.2f%%\"];', source, target, weight) from edges where profile_id = 'p0' and weight >= 0.5 and source in (select node_id from n) and target in (select node_id from n) union all select 3, '}}'")
