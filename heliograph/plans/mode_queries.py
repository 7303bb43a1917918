"""Queries of modes, views, retainers, functions and the task store, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, values
from ..functions import frames as fn
from ..operators import advisor, callgraph, flamegraph, heap, leaks, paths, retainers, stats
from ..streaming import intake
from ..streaming import tasks as queue
from . import heap_queries as hq
from . import modes, sinks, views
from . import standins as st
from .decoder_queries import _GROUPS, of_kinds
from .profile_queries import register
from .storage import kept, shared_dir

S, W, H = st.SAMPLES, st.WHOLE, st.HEAP
on_heap = hq.on_heap


def on_samples(name: str, operator, sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.samples(spark, d)))


def on_table(name: str, table: str, operator, sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.table(spark, d, table)))


# Functions over columns
on_table("C07_stacks_and_texts", "events", lambda t: t.select("event_id", fn.stack_to_string(F.array(F.lit("a"), "event_type")).alias("text")).select("event_id", "text", F.size(fn.string_to_stack("text")).alias("frames"), fn.leaf(fn.string_to_stack("text")).alias("leaf")), "select event_id, 'a;' || event_type as text, cast(2 as integer) as frames, event_type as leaf from events")
on_table("C19_bytes", "part", lambda t: t.select("p_partkey", values.format_bytes(F.col("p_partkey") * 512).alias("bytes")), "select p_partkey, case when p_partkey * 512 < 1024 then (p_partkey * 512) || ' B' when p_partkey * 512 < 1048576 then printf('%.2f KB', p_partkey * 512 / 1024) when p_partkey * 512 < 1073741824 then printf('%.2f MB', p_partkey * 512 / 1048576) else printf('%.2f GB', p_partkey * 512 / 1073741824) end as bytes from part")
on_table("C18_percent_text", "nation", lambda t: t.select("n_nationkey", values.format_percent(F.col("n_nationkey") / 4).alias("pct")), "select n_nationkey, regexp_replace(regexp_replace(printf('%.2f', n_nationkey / 4), '0+$', ''), '\\.$', '') as pct from nation")
on_table("C20_truncated", "part", lambda t: t.select("p_partkey", fn.truncated("p_type", 12).alias("text")), "select p_partkey, case when strlen(p_type) > 12 then left(p_type, 9) || '...' else p_type end as text from part")
on_table("C22_modes_and_presets", "nation", lambda t: t.where("n_nationkey < 10").select("n_nationkey", F.get(F.array(*(F.lit(values.parse_mode(m.upper())) for m in values.MODES)), F.col("n_nationkey").cast("int")).alias("mode"), F.get(F.array(*(F.lit(values.parse_preset(p)) for p in values.PRESETS)), F.col("n_nationkey").cast("int")).alias("preset")), "select n_nationkey, ['java-cpu', 'java-alloc', 'java-heap', 'cpu', 'pprof-cpu', 'pprof-heap', 'pprof-goroutine', 'pprof-block', 'pprof-mutex', 'pprof-all'][n_nationkey + 1] as mode, ['quick', 'quick', 'standard', 'standard', 'standard', 'standard', 'detailed', 'detailed', 'detailed'][n_nationkey + 1] as preset from nation where n_nationkey < 10")
on_table("C27_thread_group_by_pattern", "customer", lambda t: t.select("c_custkey", fn.thread_group_by_pattern(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("io-"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("w["), F.col("c_custkey").cast("string"), F.lit("]"))).otherwise("main")).alias("g")), "select c_custkey, case c_custkey % 3 when 0 then 'io' when 1 then 'w' else 'main' end as g from customer")
on_table("C29_numbers_and_times", "orders", lambda t: t.select("o_orderkey", values.format_number(F.col("o_orderkey") * 4000).alias("number"), values.format_time("o_orderdate").alias("time"), values.format_duration_ns(F.col("o_orderkey") * 4_000_000).alias("duration")), "select o_orderkey, case when o_orderkey * 4000 >= 1000000000 then printf('%.1fG', o_orderkey * 4 / 1000000) when o_orderkey * 4000 >= 1000000 then printf('%.1fM', o_orderkey * 4 / 1000) when o_orderkey >= 1 then printf('%.1fK', o_orderkey * 4 / 1) else (o_orderkey * 4000) || '' end as number, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as time, case when o_orderkey >= 250 then printf('%.2fs', o_orderkey * 4 / 1000) when o_orderkey >= 1 then printf('%.2fms', o_orderkey * 4 / 1) else '0ns' end as duration from orders")
on_table("D02_D04_layout", "nation", lambda t: t.select("n_nationkey", values.type_width(F.col("n_nationkey").cast("int")).alias("width"), F.lit(values.LAYOUT[True][0]).alias("header"), F.lit(values.LAYOUT[False][2]).alias("array_header")), "select n_nationkey, case n_nationkey when 2 then 8 when 4 then 1 when 5 then 2 when 6 then 4 when 7 then 8 when 8 then 1 when 9 then 2 when 10 then 4 when 11 then 8 end::integer as width, 12::integer as header, 20::integer as array_header from nation")
on_table("D09_state_names", "nation", lambda t: t.select("n_nationkey", values.status_name("n_nationkey").alias("status"), values.analysis_status_name("n_nationkey").alias("analysis"), values.task_type_name(F.col("n_nationkey").cast("int")).alias("type"), values.profiler_name("n_nationkey").alias("profiler")), "select n_nationkey, coalesce(['pending', 'running', 'completed', 'failed'][n_nationkey + 1], 'unknown') as status, case n_nationkey when 0 then 'pending' when 1 then 'running' when 2 then 'completed' when 3 then 'failed' when 5 then 'cancelled' else 'unknown' end as analysis, coalesce(['generic', 'java', 'tracing', 'timing', 'memleak', 'pprof_mem', 'java_heap', 'phys_mem', 'jeprof', 'bolt', 'pprof_cpu', 'pprof_heap', 'pprof_goroutine', 'pprof_block', 'pprof_mutex'][n_nationkey + 1], 'unknown') as type, coalesce(['perf', 'async_alloc', 'pprof'][n_nationkey + 1], 'unknown') as profiler from nation")
on_table("D10_U04_mode_of_task", "region", lambda t: t.select("r_regionkey", F.get(F.array(*(F.lit(modes.mode_of(*x)) for x in ((1, 0), (1, 1), (6, 0), (11, 2), (14, 2)))), F.col("r_regionkey").cast("int")).alias("mode")), "select r_regionkey, ['java-cpu', 'java-alloc', 'java-heap', 'pprof-heap', 'pprof-mutex'][r_regionkey + 1] as mode from region")
_KINDS = ["java.util.HashMap", "java.lang.Thread", "com.acme.Order", "java.lang.Object[]", "io.netty.buffer.PoolArena", "", "com.acme.HashMapCache"]
_PICK = f"{_KINDS}[doc_id % 7 + 1]"
on_table("D13_D16_U09_class_tests", "documents", lambda t: t.select("doc_id", F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 7).cast("int")).alias("n")).select(
    "doc_id", classes.class_category("n", business=["com.acme.O"]).alias("category"), classes.is_business_in_views("n", frameworks=True).alias("business"), classes.is_root_class("n").alias("root"), classes.is_collection("n").alias("collection"), classes.may_leak("n").alias("leak")
), f"select doc_id, case {_PICK} when '' then 'unknown' when 'com.acme.Order' then 'business' when 'com.acme.HashMapCache' then 'application' when 'io.netty.buffer.PoolArena' then 'framework' else 'jdk' end as category, {_PICK} like 'com.acme.%' as business, {_PICK} = 'java.lang.Thread' as root, {_PICK} = 'java.util.HashMap' as collection, contains({_PICK}, 'HashMap') as leak from documents")

# Statistics, flame and call graphs
on_samples("F14_group_summaries", stats.group_summaries, f"with {S}, threads as (select profile_id, tid, arg_min(thread_name, sample_id) as thread_name, cast(sum(value) as bigint) as samples from samples group by all), t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), g as (select profile_id, regexp_replace(thread_name, '[0-9_#-]+$', '') as thread_group, count(*) as threads, cast(sum(samples) as bigint) as samples, arg_max(thread_name, [lpad(cast(samples as varchar), 20, '0'), thread_name]) as top_thread from threads where thread_name <> 'swapper/0' group by all) select g.profile_id, thread_group, threads, samples, samples / total * 100 as pct, top_thread, cast(row_number() over (partition by g.profile_id order by samples desc, thread_group) as integer) as rank from g join t using (profile_id)")
_PAIR = lambda c, a, b: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string")))).alias(c)
on_samples("J08_functions_in_detail", lambda s: stats.functions_in_detail(s, 12, 3).select("profile_id", "func", "rank", _PAIR("threads", "tid", "samples"), _PAIR("stacks", "stack", "samples")), f"with {S}, busy as (select * from samples where thread_name <> 'swapper/0'), f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all), r as (select *, cast(row_number() over (partition by profile_id order by self desc, func) as integer) as rank from f), p as (select profile_id, stack[-1] as func, tid, cast(sum(value) as bigint) as n from busy group by all), q as (select profile_id, stack[-1] as func, array_to_string(stack, ';') as s, cast(sum(value) as bigint) as n from samples group by all), q3 as (select *, row_number() over (partition by profile_id, func order by n desc, s) as i from q) select r.profile_id, r.func, r.rank, (select string_agg(tid || ':' || n, ',' order by n desc, tid) from p where p.profile_id = r.profile_id and p.func = r.func) as threads, (select string_agg(s || ':' || n, ',' order by i) from q3 where q3.profile_id = r.profile_id and q3.func = r.func and i <= 3) as stacks from r where rank <= 12")
on_samples("H03_merged_flames", lambda s: flamegraph.merged(flamegraph.roll_up(s)).where("depth <= 2").withColumn("path", F.concat_ws(";", "path")), f"with {S}, n as (select profile_id || ';' || stack[1] as path, 2 as depth, stack[1] as name, cast(sum(value) as bigint) as value from samples group by all union all select profile_id, 1, profile_id, cast(sum(value) as bigint) from samples group by all union all select '', 0, 'all', cast(sum(value) as bigint) from samples) select 'all' as profile_id, path, cast(depth as integer) as depth, name, value, cast(0 as bigint) as self from n")
on_samples("E09_G19_found", lambda s: views.found_in_analysis(stats.self_by_function(s), stats.threads(s), "ECON", 25), f"with {S}, f as (select 'function' as kind, profile_id, stack[-1] as name, cast(sum(value) as bigint) as samples from samples group by all), t as (select 'thread' as kind, profile_id, arg_min(thread_name, sample_id) as name, cast(sum(value) as bigint) as samples from samples group by profile_id, tid) select * from (select * from f union all select * from t) where contains(lower(name), 'econ') order by samples desc, name, kind, profile_id limit 25")
on_samples("E14_columns", lambda s: views.columns_of(stats.threads(s), ["samples", "no_such", "tid", "profile_id"]), f"with {S} select profile_id, tid, cast(sum(value) as bigint) as samples from samples group by all")
register("J04_any_stack", f"with {st.SNAPSHOTS} select distinct func, 'main;' || func as sample_stack from snapshots union all select 'main', min('main;' || func) from snapshots")(lambda spark, d: leaks.any_stack((s := st.snapshots(spark, d)).select(F.explode("stack").alias("func")).distinct(), s))

# Heaps
V = {"com.shop.orders": "java.util.ArrayList", "com.shop.lineitem": "java.lang.Object[]"}
_VARIANT = "case class_name when 'com.shop.orders' then 'java.util.ArrayList' when 'com.shop.lineitem' then 'java.lang.Object[]' else class_name end"


def with_collections(h: st.Tables) -> st.Tables:
    """The stand-in heap with orders as lists and their lines as their arrays; parts and suppliers are what the arrays hold."""
    name = F.col("class_name")
    for old, new in V.items():
        name = F.when(F.col("class_name") == old, new).otherwise(name)
    return st.Tables({**h, "objects": h["objects"].withColumn("class_name", name), "refs": h["refs"].withColumn("field", F.when(F.col("field") == "suppliers", "elements").otherwise(F.col("field")))}, (*h.at[:2], "collections"))


sized = hq.sized


def _calculated(v: st.Tables) -> DataFrame:
    """Sizes with collections; dominators and what arrays share walk over the same references, dealt by referrer once."""
    refs = kept(v["refs"].select("from_id", "to_id"), "from_id", deal=False)
    return retainers.CALCULATORS["collections"](v["objects"], refs, heap.dominators(refs, v["roots"], keep=False))


# What arrays of collections share: parts and suppliers by how many lines hold them.
_THROUGH = f"{hq._RETAINED}, through as (select to_id, count(*) as n, min(from_id) as one from (select distinct from_id, to_id from refs where field in ('part', 'supplier')) group by 1), loose as (select r.from_id, r.to_id, s.retained from refs r join sizes s on s.obj_id = r.to_id join through t on t.to_id = r.to_id where s.idom is distinct from r.from_id and (t.n > 1 or t.one <> r.from_id))"
on_heap("M08_retained_with_collections", lambda h: _calculated(with_collections(h)).select("obj_id", "retained", "idea"), f"{_THROUGH} select obj_id, s.retained, s.retained + coalesce(m.more, 0) as idea from sizes s left join (select from_id, cast(sum(retained) as bigint) as more from loose group by 1) m on m.from_id = s.obj_id")
on_heap("M09_U02_calculators", lambda h: _calculated(with_collections(h)).agg(F.sum("size").alias("size"), F.count("*").alias("n")), f"{_THROUGH} select cast((select sum(retained) from sizes) + (select coalesce(sum(retained), 0) from loose) as bigint) as size, (select count(*) from sizes) as n")
on_heap("M21_owned_sizes", lambda h: retainers.owned_sizes((v := with_collections(h))["refs"], v["objects"], sized(v), "com.shop.nation").drop("loaded_classes"), f"{_THROUGH}, best as (select * from sizes where class_name = 'com.shop.nation' order by retained desc, obj_id limit 10) select b.obj_id, b.shallow, b.retained, b.retained - b.shallow as dominated, coalesce(m.more, 0) as through_arrays, b.retained + coalesce(m.more, 0) as owned from best b left join (select from_id, cast(sum(retained) as bigint) as more from loose group by 1) m on m.from_id = b.obj_id")
on_heap("M20_U03_diagnosis", lambda h: retainers.DIAGNOSES["scenarios"]((v := with_collections(h))["refs"], v["objects"], sized(v), "com.shop.nation"), f"{_THROUGH}, best as (select * from sizes where class_name = 'com.shop.nation' order by retained desc, obj_id limit 10), held as (select r.from_id as obj_id, s.retained, s.idom = r.from_id as own, exists (select 1 from loose x where x.from_id = r.from_id and x.to_id = r.to_id) as through from refs r join best b on b.obj_id = r.from_id join sizes s on s.obj_id = r.to_id), g as (select obj_id, count(*) as fields, count(case when own then 1 end) as dominated_fields, cast(sum(case when own then retained else 0 end) as bigint) as dominated, count(case when not own then 1 end) as shared_fields, cast(sum(case when not own then retained else 0 end) as bigint) as shared, cast(sum(case when through then retained else 0 end) as bigint) as through_arrays from held group by 1) select g.*, b.retained as standard, b.retained + through_arrays as with_arrays, b.retained + shared as with_shared from g join best b using (obj_id)")
_MET = f"with recursive {H}, w as (select obj_id as target, obj_id as node, class_name as target_class, 0 as depth, '' as class_name, '' as field from objects union select target, from_id, target_class, depth + 1, f.class_name, refs.field from w join refs on to_id = node join objects f on f.obj_id = from_id where depth < 5), m as (select target, target_class, node, class_name, field, cast(min(depth) as integer) as depth from w where depth > 0 group by all), b as (select * from m qualify row_number() over (partition by target, node order by depth, class_name, field) = 1), whole as (select class_name as target_class, count(*) as instances, cast(sum(shallow) as bigint) as total from objects group by 1)"
_ALL = 1 << 40
on_heap("M11_top_retainers", lambda h: retainers.of_top_classes(h["refs"], h["objects"], heap.histogram(h["objects"]), heap.histogram(h["objects"]).select("class_name", F.col("total_size").alias("retained")), 7, 8, samples=_ALL), f"{_MET}, u as (select distinct target, target_class, class_name, field, depth from b), r as (select u.target_class, u.class_name as retainer_class, field, depth, count(*) as count, cast(sum(shallow) as bigint) as size from u join objects on obj_id = target group by all) select target_class, retainer_class, field, depth, count, size, least(size * 100.0::double / total, 100.0) as pct, rank, total as class_retained from (select *, cast(row_number() over (partition by target_class order by depth, size desc, retainer_class, field) as integer) as rank from r) join whole using (target_class) where rank <= 8")
on_heap("M12_business_retainers", lambda h: retainers.business(h["refs"], h["objects"], h["objects"].select("class_name").distinct(), h["roots"], samples=_ALL, max_depth=5), f"{_MET}, n as (select target, target_class, class_name, cast(min(depth) as integer) as depth from b group by all), r as (select n.target_class, n.class_name, min(depth) as depth, count(*) as count, cast(sum(shallow) as bigint) as size from n join objects on obj_id = target group by all) select r.target_class, class_name, depth, count, size, least(size * 100.0::double / total, 100.0) as pct, class_name = 'com.shop.region' as is_root, cast(row_number() over (partition by r.target_class order by size desc, class_name) as integer) as rank from r join whole using (target_class)")
on_heap("M13_sub_graph", lambda h: retainers.sub_graph(h["refs"], h["objects"], "com.shop.nation")[1], f"with {H} select from_id, to_id, field from refs where field = 'nations' and to_id in (select obj_id from objects where class_name = 'com.shop.nation' order by obj_id limit 10)")
on_heap("M13_sub_graph_nodes", lambda h: retainers.sub_graph(h["refs"], h["objects"], "com.shop.nation")[0], f"with {H}, n as materialized (select {st.STRIDE} + n_nationkey as obj_id, n_regionkey as above, 0 as depth from nation order by 1 limit 10), m as materialized (select obj_id, depth from n union all select distinct cast(above as bigint), 1 from n) select obj_id, class_name, shallow, cast(depth as integer) as depth from m join (select * from objects where class_name in ('com.shop.nation', 'com.shop.region')) o using (obj_id)")
on_heap("F30_holders_of_arrays", lambda h: retainers.of_arrays((v := with_collections(h))["refs"], v["objects"]), f"with {H} select 'java.util.ArrayList' as class_name, count(*) as references from refs where field = 'lines'")
on_heap("F31_array_holders", lambda h: heap.array_holders((v := with_collections(h))["refs"], v["objects"], v["objects"].withColumn("retained", F.col("shallow"))), f"with {H}, c as (select from_id, count(distinct to_id) as n from refs where field in ('part', 'supplier') group by 1) select 'java.util.ArrayList' as holder_class, count(*) as arrays, cast(sum(coalesce(n, 0)) as bigint) as children, cast(sum(shallow) as bigint) as retained from refs r join objects o on o.obj_id = r.to_id left join c on c.from_id = r.to_id where field = 'lines'")
on_heap("J09_retained_over_total", lambda h: retainers.with_retainers_size(heap.histogram(h["objects"]), h["objects"].where("class_name = 'com.shop.part'").select(F.col("class_name").alias("target_class"), F.lit(7).cast("long").alias("class_retained")).distinct()).select("class_name", "total_size", "size"), f"with {H}, c as (select class_name, cast(sum(shallow) as bigint) as total_size from objects group by 1) select class_name, total_size, case when class_name = 'com.shop.part' then 7 else total_size end as size from c")
_PATHS = f"select {3 * st.STRIDE} + o_orderkey as target, n_regionkey || '>' || ({st.STRIDE} + n_nationkey) || '>' || ({2 * st.STRIDE} + c_custkey) || '>' || ({3 * st.STRIDE} + o_orderkey) as path, cast(4 as integer) as length from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
_orders = lambda h: heap.paths_to_roots(h["refs"], h["roots"], h["objects"].where("class_name = 'com.shop.orders'"))
on_heap("M14_paths_to_roots", lambda h: _orders(h).select("target", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), "length"), _PATHS)
_WAYS = f"""with recursive {H}, l as (select obj_id, 0 as level from roots union select to_id, level + 1 from l join refs on from_id = obj_id), levels as materialized (
    select obj_id, min(level) as level from l group by 1
), f as materialized (select from_id, to_id, min(field) as field from refs group by all), w as (
    select distinct obj_id, 0 as level, [obj_id] as back, [cast(null as varchar)] as fields from roots
    union all
    select to_id, w.level + 1, list_prepend(to_id, back), list_prepend(f.field, fields) from w join f on from_id = w.obj_id join levels v on v.obj_id = to_id and v.level = w.level + 1
), ways as (select obj_id as target, row_number() over (partition by obj_id order by back) as rank, len(back) as length, list_reverse(list_transform(list_zip(back, fields), lambda z : coalesce(z[2], '') || ':' || z[1])) as steps from w)"""
_steps = lambda path: F.concat_ws(">", F.transform(path, lambda s: F.concat(F.coalesce(s["field"], F.lit("")), F.lit(":"), s["obj_id"].cast("string"))))
on_heap("M14_paths_with_fields", lambda h: paths.root_paths(paths.shortest_ways(h["refs"], h["roots"]), h["objects"], h["objects"]).select("target", "rank", "length", _steps("path").alias("path")), f"{_WAYS} select target, cast(rank as integer) as rank, cast(length as integer) as length, array_to_string(steps, '>') as path from ways where rank <= 3")
on_heap(
    "M17_biggest_described",
    lambda h: paths.described(big := heap.biggest_objects(s := sized(h), 30), h["refs"], s, paths.ways_to(h["refs"], h["roots"], big, 1), 5).select(
        "obj_id", "retained", F.concat_ws(",", F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["to_id"].cast("string"), F.lit(":"), f["class_name"], F.lit(":"), f["retained"].cast("string")))).alias("fields"), _steps("path").alias("path")
    ),
    f"{hq._RETAINED}, big as (select * from sizes where reachable order by retained desc, obj_id limit 30), h as (select from_id, field, to_id from (select distinct from_id, field, to_id from refs where from_id in (select obj_id from big)) qualify row_number() over (partition by from_id order by field, to_id) <= 5), t as (select from_id, string_agg(field || ':' || to_id || ':' || s.class_name || ':' || s.retained, ',' order by s.retained desc, field, to_id) as fields from h join sizes s on s.obj_id = to_id group by 1), {_WAYS[len('with recursive ' + H) + 2:]}, p as (select target, array_to_string(steps, '>') as path from ways where rank = 1) select big.obj_id, retained, coalesce(fields, '') as fields, path from big left join t on from_id = big.obj_id left join p on target = big.obj_id",
)
on_heap("F33_roots_by_head", lambda h: retainers.roots_by_head(_orders(h), h["roots"], h["objects"]), f"with p as ({_PATHS}) select 'JNI_GLOBAL' as root_type, 'com.shop.region' as class_name, count(distinct target) as targets, count(*) as paths from p")
on_heap("G15_ordered_retainers", lambda h: retainers.ordered(heap.retainers_by_depth(h["refs"], h["objects"], h["objects"].where("class_name = 'com.shop.orders'")), 2), f"with {H} select 'com.shop.customer' as retainer_class, 'orders' as field, cast(1 as integer) as depth, count(*) as count, cast(sum(shallow) as bigint) as size from objects where class_name = 'com.shop.orders' union all select 'com.shop.nation', 'customers', 2, count(*), cast(sum(shallow) as bigint) from objects where class_name = 'com.shop.orders'")
on_heap("G17_roots_by_size", lambda h: retainers.roots_by_size(h["roots"], sized(h), 3), f"{hq._RETAINED} select obj_id, 'JNI_GLOBAL' as root_type, class_name, shallow, retained from sizes where class_name = 'com.shop.region' order by retained desc, obj_id limit 3")
_TYPES = "select obj_id, case when obj_id % 3 = 0 then 'THREAD' else 'JNI_GLOBAL' end as root_type from objects where class_name in ('com.shop.region', 'com.shop.nation')"
_mixed = lambda h: h["objects"].where("class_name in ('com.shop.region', 'com.shop.nation')").select("obj_id", F.when(F.col("obj_id") % 3 == 0, "THREAD").otherwise("JNI_GLOBAL").alias("root_type"))
on_heap("F28_roots_of_several_types", lambda h: heap.roots_by_class(_mixed(h), h["objects"].withColumn("retained", F.col("shallow") * 2)), f"with {H}, r as ({_TYPES}), g as (select class_name, root_type, count(*) as n, sum(shallow) as s from r join objects using (obj_id) group by all) select class_name, cast(sum(n) as bigint) as roots, cast(sum(s) as bigint) as shallow, cast(sum(s) * 2 as bigint) as retained, max(case when i = 1 then root_type end) as root_type from (select *, row_number() over (partition by class_name order by n desc, root_type) as i from g) group by 1")
_STRATA = "select class_name, n, case when n <= 50 then n else least(greatest(50, n // 1000), n) end as size from (select class_name, count(*) as n from objects group by 1)"
_KEPT = lambda many, wanted: f"least({wanted}, ceil(({many}) / greatest(1, ({many}) // greatest(1, {wanted}))))"
on_heap("G18_stratified_sample", lambda h: heap.stratified_sample(h["objects"], 50, 0.001).groupBy("class_name").agg(F.count("*").alias("n")), f"with {H}, s as ({_STRATA}), p as (select *, n // 10 as head, n * 4 // 10 as mid, size * 40 // 100 as a, size * 35 // 100 as b from s) select class_name, cast(case when n <= 50 then n else {_KEPT('head', 'a')} + {_KEPT('mid', 'b')} + {_KEPT('n - head - mid', '(size - a - b)')} end as bigint) as n from p")
on_heap("E08_E12_top_level", lambda h: heap.biggest_objects((v := with_collections(h))["objects"].withColumns({"retained": F.col("shallow"), "reachable": F.lit(True)}), 40).select("obj_id", "class_name", "retained"), f"with {H} select obj_id, {_VARIANT} as class_name, shallow as retained from objects where class_name not in ('com.shop.orders', 'com.shop.lineitem') order by shallow desc, obj_id limit 40")

# Rules
register("R04_frequent_allocation", f"with {hq._FUNCTIONS} select 'R04' as rule, 'new' || func as func, self_pct as value from s where self_pct > 5")(lambda spark, d: advisor.frequent_allocation(hq._functions(spark, d).withColumn("func", F.concat(F.lit("new"), "func"))))
_BIG = {"com.shop.lineitem": ("java.util.HashMap", 1_000_000), "com.shop.orders": ("java.lang.String", 1_000_000), "com.shop.customer": ("byte[]", 1 << 20), "com.shop.part": ("com.shop.part", 1), "com.shop.supplier": ("com.shop.supplier", 1), "com.shop.nation": ("com.shop.nation", 1), "com.shop.region": ("com.shop.region", 1)}


def _large(h: dict[str, DataFrame]) -> DataFrame:
    """The stand-in's histogram with classes, counts and sizes that the rules look for."""
    rows = heap.histogram(h["objects"])
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in _BIG.items() for x in (k, v[i]))), F.col("class_name"))
    rows = rows.select(pick(0).alias("class_name"), (F.col("instances") * pick(1)).alias("instances"), (F.col("total_size") * pick(1)).alias("total_size"))
    whole = rows.agg(F.sum("total_size").alias("t"))
    return rows.join(F.broadcast(whole)).select("class_name", "instances", "total_size", values.percent_scaled("total_size", "t").alias("pct"))


_NEW, _TIMES = ("case class_name " + " ".join(f"when '{k}' then {repr(v[i])}" for k, v in _BIG.items()) + " end" for i in (0, 1))
on_heap("R07_all_heap_rules", lambda h: advisor.advise_heap(_large(h)), f"with {H}, c as (select {_NEW} as class_name, cast(count(*) * {_TIMES} as bigint) as instances, cast(sum(shallow) * {_TIMES} as bigint) as size from objects group by class_name), t as (select cast(sum(size) as bigint) as total from c) select 'R07_share' as rule, class_name, size * 100.0::double / total as value from c, t where size * 100.0::double / total > 10 union all select 'R07_collections', class_name, instances::double from c where class_name = 'java.util.HashMap' and instances > 10000 union all select 'R07_strings', class_name, instances::double from c where class_name = 'java.lang.String' and instances > 100000 union all select 'R07_buffers', class_name, size::double from c where class_name = 'byte[]' and size > 104857600 union all select 'R07_heap', '', total::double from t where total > 1073741824")
_RULES = [("X1", "G1.", 1.0, None), ("X2", "Lock.", 0.5, None), ("X3", "App.", 0.0, "2024-01-01")]
register("R09_rule_table", f"with {hq._FUNCTIONS} select 'X1' as rule, func, self_pct as value from s where contains(func, 'G1.') and self_pct > 1.0 union all select 'X2', func, self_pct from s where contains(func, 'Lock.') and self_pct > 0.5")(lambda spark, d: advisor.by_rule_table(hq._functions(spark, d), spark.createDataFrame(_RULES, "rule string, part string, above double, deleted string")))

# Modes
_STANDARD, _QUICK = modes.preset(), modes.preset("quick")
on_samples("Q_CPU_suggestions", lambda s: modes.analyze(s.withColumn("stack", F.array(F.concat(F.lit("Method.invoke."), F.element_at("stack", 3)))), "java-cpu", _QUICK)["suggestions"], f"with {S}, t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), f as (select profile_id, 'Method.invoke.' || stack[3] as func, cast(sum(value) as bigint) as self from samples group by all), g as (select profile_id, func, self / total * 100 as value from f join t using (profile_id)) select profile_id, 'R01' as rule, func, value from g where value > 15 union all select profile_id, 'R05', func, value from g where value > 2")
on_samples("Q_ALLOC_suggestions", lambda s: modes.analyze(s.withColumn("stack", F.array(F.concat(F.lit("alloc."), F.element_at("stack", 3)))), "java-alloc", _QUICK)["suggestions"], f"with {S}, t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), f as (select profile_id, 'alloc.' || stack[3] as func, cast(sum(value) as bigint) as self from samples group by all), g as (select profile_id, func, self / total * 100 as value from f join t using (profile_id)) select profile_id, 'R01' as rule, func, value from g where value > 15 union all select profile_id, 'R04', func, value from g where value > 5 union all select profile_id, 'R06', func, value from g where value > 10")
on_samples("Q_CPU_flame", lambda s: modes.analyze(s, "java-cpu", _STANDARD)["flame"].where("depth <= 3").select("profile_id", F.concat_ws(";", "path").alias("path"), "value"), f"with {S}, b as (select * from samples where thread_name <> 'swapper/0'), t as (select profile_id, cast(sum(value) as bigint) as total from b group by 1), n as (select profile_id, list_slice(stack, 1, i) as p, i, cast(sum(value) as bigint) as value from b, (select unnest(range(4)) as i) group by all) select n.profile_id, array_to_string(p, ';') as path, value from n join t using (profile_id) where i = 0 or value >= floor(total * 0.1 / 100)")
on_samples("Q_CPU_thread_edges", lambda s: modes.analyze(s, "cpu", _QUICK)["call_edges"].select("profile_id", "source", "target", "count"), f"with {W}, n as (select profile_id, node_id from frames join alls using (profile_id) group by profile_id, node_id, total having sum(value) / total * 100 >= 1.0) select f.profile_id, caller as source, f.node_id as target, cast(sum(value) as bigint) as count from frames f join alls using (profile_id) where caller is not null and exists (select 1 from n a where a.profile_id = f.profile_id and a.node_id = caller) and exists (select 1 from n b where b.profile_id = f.profile_id and b.node_id = f.node_id) group by f.profile_id, caller, f.node_id, total having sum(value) / total * 100 >= 0.5")
on_samples("Q_NS_namespace", lambda s: modes.namespace(modes.of_stacks(s, _QUICK)).select("profile_id", F.get_json_object("document", "$.total_samples").cast("bigint").alias("total"), F.get_json_object("document", "$.top_functions[0].func").alias("top"), F.json_array_length(F.get_json_object("document", "$.threads")).alias("threads")), f"with {S} select profile_id, cast(sum(value) as bigint) as total, (select f from (select profile_id as q, stack[-1] as f, sum(value) as v from samples group by all) where q = profile_id order by v desc, f limit 1) as top, cast(count(distinct tid) as integer) as threads from samples group by profile_id")
on_samples("Q_SUM_top_items", lambda s: modes.top_items({"functions": stats.top_functions(s, 20)}, "java-cpu", 4), f"with {S}, t as (select profile_id, cast(sum(value) as bigint) as total from samples group by 1), f as (select profile_id, stack[-1] as name, cast(sum(value) as bigint) as self from samples group by all), r as (select profile_id, name, self / total * 100 as value, self from f join t using (profile_id)) select profile_id, name, value, rank from (select *, cast(row_number() over (partition by profile_id order by value desc, name) as integer) as rank from r) where rank <= 4")
on_samples("Q_CONV_flame_to_cpu", lambda s: modes.cpu_of_flame(flamegraph.roll_up(s, thread_frame=True))["stacks"], f"with {S} select profile_id, thread_name, array_to_string(stack, ';') as stack, cast(sum(value) as bigint) as samples from samples group by all")


def on_profiles(name: str, operator, sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.profiles(spark, d)))


_kind = lambda p, k: p.where(F.col("profile_type") == k)
on_profiles("Q_PCPU_by_cum", lambda p: modes.analyze(_kind(p, "cpu"), "pprof-cpu", "quick")["by_cum"].select("profile_id", "func", "cum", "rank"), f"with {st.PROFILES}, f as (select 'cpu_20240101_000' || half || '00' as profile_id, func, cast(sum(v) * 1000 as bigint) as cum from (select half, unnest(stack) as func, v from stacks) group by all) select * from (select *, cast(row_number() over (partition by profile_id order by cum desc, func) as integer) as rank from f) where rank <= 20")
on_profiles("Q_PHEAP_stacks_by_type", lambda p: modes.analyze(_kind(p, "heap"), "pprof-heap", "quick")["stacks_by_type"], f"with {st.PROFILES} " + " union all ".join(f"select 'heap_20240101_000' || half || '00' as profile_id, count(*) as stacks, cast(sum({v}) as bigint) as total, '{t}' as type from stacks where {v} <> 0 group by half" for t, _, v in st.PROFILE_KINDS["heap"]))
on_profiles("Q_PGOR_groups", lambda p: modes.analyze(_kind(p, "goroutine"), "pprof-goroutine", "quick")["groups"], f"{_GROUPS} select * from r where rank <= 100")
on_profiles("Q_PBLK_by_contentions", lambda p: modes.analyze(_kind(p, "block"), "pprof-block", "quick")["by_contentions"].select("profile_id", "func", "cum"), f"with {st.PROFILES}, f as (select 'block_20240101_000' || half || '00' as profile_id, func, cast(sum(n) as bigint) as cum, cast(sum(case when pos = 3 then n else 0 end) as bigint) as flat from (select half, unnest(stack) as func, unnest([1, 2, 3]) as pos, n from stacks) group by all) select profile_id, func, cum from (select *, row_number() over (partition by profile_id order by flat desc, func) as r from f) where r <= 20")
_LEAKS = f"with {st.PROFILES}, k as (select unnest(['heap', 'goroutine']) as kind), g as (select kind, cast(sum(case when half = 0 then case kind when 'heap' then v else n end else 0 end) as bigint) as baseline_total, cast(sum(case when half = 1 then case kind when 'heap' then v else n end else 0 end) as bigint) as current_total from stacks, k group by 1), d as (select *, current_total - baseline_total as growth, (current_total - baseline_total) / baseline_total * 100 as growth_pct, (current_total - baseline_total) / 60.0::double * 60 as per_minute from g) select *, case when growth_pct <= 5 and per_minute < case kind when 'heap' then 1048576 else 10 end then 'none' when growth_pct <= 20 and per_minute < case kind when 'heap' then 10485760 else 50 end then 'low' when growth_pct <= 50 and per_minute < case kind when 'heap' then 52428800 else 100 end then 'medium' when growth_pct <= 100 and per_minute < case kind when 'heap' then 104857600 else 500 end then 'high' else 'critical' end as severity from d"
on_profiles("Q_PALL_leaks", lambda p: modes.leak_reports(p).drop("advice"), _LEAKS)
on_profiles("Q_API4_E08_leak_report", lambda p: views.leak_report(modes.leak_reports(p).drop("advice"), "Heap"), f"{_LEAKS.replace('select *, case when growth_pct', 'select * from (select *, case when growth_pct', 1)}) where kind = 'heap'")
on_profiles("Q_PALL_functions", lambda p: modes.analyze(p, "pprof-all", "quick")["mutex.functions"].select("profile_id", "func", "self"), f"with {st.PROFILES} select 'mutex_20240101_000100' as profile_id, stack[3] as func, cast(sum(v) as bigint) as self from stacks where half = 1 and v <> 0 group by 2")


def _heap_mode(h: dict[str, DataFrame], name: str) -> DataFrame:
    return modes.java_heap(h, _STANDARD, retainers_of=0, graphs_of=0, details=False)[name]


on_heap("Q_HEAP_classes", lambda h: _heap_mode(h, "classes"), f"{hq._RETAINED}, a as (select s.class_name, cast(sum(s.retained) as bigint) as retained from sizes s left join sizes d on d.obj_id = s.idom where s.reachable and s.class_name is distinct from d.class_name group by 1), b as (select d.class_name, cast(sum(s.shallow) as bigint) as attributed from sizes s join sizes d on d.obj_id = s.idom group by 1) select coalesce(a.class_name, b.class_name) as class_name, retained, attributed from a full join b on a.class_name = b.class_name")
on_heap("Q_HEAP_graph_edges", lambda h: retainers.sub_graphs(h["refs"], h["objects"], h["objects"].where("class_name in ('com.shop.nation', 'com.shop.region')").select("class_name"))[1], f"with {H} select 'com.shop.nation' as of_class, from_id, to_id, field from refs where field = 'nations' and to_id in (select {st.STRIDE} + n_nationkey from nation order by 1 limit 10)")
on_heap("Q_HEAP_biggest", lambda h: _heap_mode(h, "biggest").select("obj_id", "class_name", "retained", "idea"), f"{hq._RETAINED} select obj_id, class_name, retained, retained as idea from sizes where reachable order by retained desc, obj_id limit 100")


def _views(spark: SparkSession, d: str, ask) -> DataFrame:
    h = st.heap(spark, d)
    return ask(views.heap_views(h, h["objects"].withColumns({"retained": F.col("shallow") * 3, "reachable": F.lit(True)})))


register("Q_API3_info", f"with {H} select obj_id, '0x' || lower(to_hex(obj_id)) as hex, class_name, shallow, shallow * 3 as retained, (shallow * 3) || ' B' as retained_text, cast(null as varchar) as root_type from objects where obj_id = {st.STRIDE} + 3")(lambda spark, d: _views(spark, d, lambda v: v["info"](hex(st.STRIDE + 3))))
register("Q_API3_biggest_by_class", f"with {H} select obj_id, class_name, shallow, shallow * 3 as retained from objects where class_name = 'com.shop.part' order by retained desc, obj_id limit 50")(lambda spark, d: _views(spark, d, lambda v: v["biggest-by-class"]("com.shop.part").select("obj_id", "class_name", "shallow", "retained")))
register("M16_Q_API3_root_retained", f"{hq._RETAINED}, f as (select * from refs where from_id = {st.STRIDE} + 3 order by field, to_id limit 10) select field, to_id, class_name, shallow, retained from f join sizes on obj_id = to_id")(lambda spark, d: heap.held_by((h := st.heap(spark, d))["refs"], sized(h), st.STRIDE + 3, 10))


def _written(spark: SparkSession, d: str) -> str:
    out = f"{shared_dir(spark)}/task-{uuid.uuid4().hex}"
    rows = modes.of_stacks(st.samples(spark, d), _QUICK)
    sinks.write_json(rows["functions"], f"{out}/functions")
    sinks.write_documents(flamegraph.documents(rows["flame"]), f"{out}/flame_documents")
    return out


register("Q_API1_A27_U07_artifacts", f"with {S}, b as (select profile_id, cast(sum(value) as bigint) as total from samples where thread_name <> 'swapper/0' group by 1) select b.profile_id, total, (select least(count(*), 20) from (select distinct profile_id as q, stack[-1] as f from samples) where q = b.profile_id) as functions from b")(
    lambda spark, d: views.flame_document(spark, out := _written(spark, d)).select("profile_id", F.get_json_object("document", "$.value").cast("bigint").alias("total")).join(views.artifact(spark, out, "functions").groupBy("profile_id").agg(F.count("*").alias("functions")), "profile_id")
)


def _retainer_files(spark: SparkSession, d: str) -> DataFrame:
    out, h = f"{shared_dir(spark)}/task-{uuid.uuid4().hex}", st.heap(spark, d)
    rows = retainers.by_depth(h["refs"], h["objects"], h["objects"].select("class_name").distinct(), samples=_ALL)
    sinks.write_heap({"retainers": rows}, out)
    return views.retainers_of(spark, out, "com.shop.orders").select("retainer_class", "field", "count", "size")


register("Q_API2_retainers", f"with {H}, o as (select count(*) as n, cast(sum(shallow) as bigint) as s from objects where class_name = 'com.shop.orders') select unnest(['com.shop.customer', 'com.shop.nation', 'com.shop.region']) as retainer_class, unnest(['orders', 'customers', 'nations']) as field, n as count, s as size from o")(_retainer_files)

def _batch_set(spark: SparkSession, d: str) -> DataFrame:
    """Leak reports and the profiles that they compare, written as a set and read back."""
    out, p = f"{shared_dir(spark)}/task-{uuid.uuid4().hex}", st.profiles(spark, d)
    sinks.write_leaks(modes.leak_reports(p), p, out)
    reports = spark.read.json(f"{out}/reports").select("kind", F.col("growth").alias("n"))
    return reports.unionByName(spark.read.json(f"{out}/profiles").groupBy(F.concat(F.lit("profiles of "), "profile_type").alias("kind")).agg(F.count("*").alias("n")))


register("B08_batch_set", f"{_LEAKS.replace('select *, case when growth_pct', 'select kind, growth, case when growth_pct', 1).replace('with ', 'with z as (with ', 1)}) select kind, cast(growth as bigint) as n from z union all select 'profiles of ' || unnest(['cpu', 'heap', 'goroutine', 'block', 'mutex']), cast(2 as bigint)")(_batch_set)

# Tasks
T = st.TASKS
_POSTS = "case event_id % 5 when 0 then '{\"tid\":\"t' || event_id || '\",\"id\":' || event_id || '}' when 1 then '{\"id\":1}' when 2 then 'no json' when 3 then null else '{\"tid\":\"\"}' end"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    method = F.when(F.col("user_id") % 3 == 0, "GET").otherwise("POST")
    return st.table(spark, d, "events").select("event_id", method.alias("method"), F.expr(_POSTS).alias("body"))


register("A22_S01_posted_tasks", "select event_id, cast(case when user_id % 3 = 0 then 405 when event_id % 5 = 0 then 202 else 400 end as integer) as code from events")(lambda spark, d: _posts(spark, d).select("event_id", intake.answer("method", "body").alias("code")))
register("A22_accepted_tasks", "select event_id as id, 't' || event_id as tid from events where user_id % 3 <> 0 and event_id % 5 = 0")(lambda spark, d: intake.accepted(_posts(spark, d)).select("id", "tid"))
register("A23_messages", "select event_id as id, 't' || event_id as tid from events where event_id % 5 = 0")(lambda spark, d: intake.of_messages(_posts(spark, d).select(F.col("body").cast("binary").alias("value"))).where("tid <> ''").select("id", "tid"))
_dated = lambda spark, d: st.tasks(spark, d).join(st.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("modified")), "id")
_DATED = f"{T}, dated as (select t.*, o_orderdate as modified from tasks t join orders on o_orderkey = id)"
register("G20_task_list", f"with {_DATED} select tid, ['generic', 'java', 'tracing', 'timing', 'memleak', 'pprof_mem', 'java_heap', 'phys_mem', 'jeprof', 'bolt', 'pprof_cpu', 'pprof_heap', 'pprof_goroutine', 'pprof_block', 'pprof_mutex'][type + 1] as type, case when type in (0, 3, 10) then 'CPU' when type = 1 then 'App' when type = 2 then 'Disk' when type in (4, 5, 6, 7, 8, 11) then 'Memory' when type = 12 then 'Goroutine' when type in (13, 14) then 'Concurrency' else 'Unknown' end as resource, ['pending', 'running', 'completed', 'failed'][analysis_status + 1] as status, duration between 1 and 120 as priority, strftime(modified, '%Y-%m-%d %H:%M:%S') as changed from dated order by modified desc, id desc limit 30")(lambda spark, d: views.task_list(_dated(spark, d), 30))
register("G20_latest_task", f"with {_DATED} select master_tid, arg_max(tid, [epoch(modified)::bigint, id]) as tid from dated group by 1")(lambda spark, d: views.latest_task(_dated(spark, d)))
register("A25_point_lookup", f"with {T} select id, tid, type from tasks where tid = 't7'")(lambda spark, d: views.look_up(st.tasks(spark, d), "task", "t7").select("id", "tid", "type"))
register("A25_live_rules", "select 'X1' as rule union all select 'X2'")(lambda spark, d: views.look_up(spark.createDataFrame([(*r, "m") for r in _RULES], "rule string, part string, above double, deleted string, master_tid string"), "master", "m").select("rule"))
register("J11_master_subtasks", f"with {T} select m.c_custkey as custkey, t.tid from customer m join tasks t on t.master_tid = 'm' || m.c_custkey")(lambda spark, d: views.sub_tasks(st.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("master_tid")), st.tasks(spark, d)).select("custkey", "tid"))
register("S10_status_updates", f"with {T} select tid, case when id % 3 = 0 then 5 else analysis_status end::integer as analysis_status from tasks")(lambda spark, d: queue.with_status(t := st.tasks(spark, d), t.where("id % 3 = 0").select("tid", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select("tid", "seq", F.when(F.col("seq") == 2, 5).otherwise(1).alias("analysis_status"))).select("tid", "analysis_status"))
register("B11_results_upsert", f"with {T} select tid, cast(case when id % 2 = 0 then 2 else 1 end as integer) as version, case when id % 2 = 0 then 'new' else 'old' end as text from tasks where id % 3 <> 0 or id % 2 = 0")(
    lambda spark, d: sinks.results_upsert((t := st.tasks(spark, d)).where("id % 3 <> 0").select("tid", F.lit(1).alias("version"), F.lit("old").alias("text")), t.where("id % 2 = 0").select("tid", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).select("tid", "version", F.when(F.col("version") == 2, "new").otherwise("lost").alias("text")))
)


def _masters(spark: SparkSession, d: str) -> DataFrame:
    tasks = st.tasks(spark, d)
    masters = tasks.select("master_tid").distinct().withColumn("groups", F.expr("array(named_struct('tid', 'old', 'items', array(named_struct('func', 'f', 'suggestion', 'keep'))))"))
    rows = queue.with_suggestions(masters, tasks, tasks.select("tid", F.lit("f").alias("func"), F.when(F.col("id") % 2 == 0, "look").otherwise(" ").alias("suggestion")))
    return rows.select("master_tid", F.concat_ws(",", F.col("groups.tid")).alias("groups"), "complete")


register("S11_master_suggestions", f"with {T} select master_tid, concat_ws(',', 'old', string_agg(case when analysis_status = 2 and id % 2 = 0 then tid end, ',' order by tid)) as groups, count(case when analysis_status <= 1 and status <> 3 then 1 end) = 0 as complete from tasks group by 1")(_masters)
register("K08_callees_of", f"with {W}, l as (select profile_id, caller as source, node_id as target, cast(sum(value) as bigint) as count from frames where caller = 'ASIA' group by all), t as (select profile_id, cast(sum(count) as bigint) as total from l group by 1) select profile_id, source as node_id, target as neighbour, count, count / total * 100 as pct, cast(row_number() over (partition by profile_id order by count desc, target) as integer) as rank from l join t using (profile_id)")(
    lambda spark, d: callgraph.neighbours((f := callgraph.frames(callgraph.busy(st.samples(spark, d)))).where("node_id = 'ASIA'").select("profile_id", "node_id").distinct(), callgraph.edges(f), "source", 100)
)
register("A05_of_each_kind", of_kinds("select '{kind}' as kind, count(*) as stacks from stacks where half = 0"))(lambda spark, d: st.profiles(spark, d).where("profile_id like '%000000'").groupBy(F.col("profile_type").alias("kind")).agg(F.count("*").alias("stacks")))
