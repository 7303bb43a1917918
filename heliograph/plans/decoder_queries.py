"""Queries over files that the stand-ins are written to: sampled profiles, a heap dump, kept graphs and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph as cg
from ..operators import flamegraph as fg
from ..operators import heap, stats
from ..sources import graphs, hprof, pprof
from . import sinks, views
from . import standins as st
from .profile_queries import register
from .storage import shared_dir

_NAME = "_20240101_000' || half || '00'"


def of_kinds(select: str, kinds: list[str] = tuple(st.PROFILE_KINDS)) -> str:
    """SQL over the stacks of each kind; {kind}, {values} and {name} are filled in."""
    values = {k: " || ',' || ".join(f"({v})" for _, _, v in types) for k, types in st.PROFILE_KINDS.items()}
    return f"with {st.PROFILES} " + " union all ".join(select.format(kind=k, values=values[k], name=f"'{k}{_NAME}") for k in kinds)


def on_profiles(name: str, operator, sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.profiles(spark, d)))


_functions = lambda: F.transform(F.flatten(F.transform("locations", lambda x: x["lines"])), lambda x: x["func"])
on_profiles("A05_profile_samples", lambda p: p.select("profile_id", "profile_type", F.concat_ws(";", F.reverse(_functions())).alias("stack"), F.concat_ws(",", F.col("values").cast("array<string>")).alias("vals")), of_kinds("select {name} as profile_id, '{kind}' as profile_type, array_to_string(stack, ';') as stack, {values} as vals from stacks"))
on_profiles("A06_A07_profile_files", lambda p: p.groupBy("profile_id", "profile_type").agg(F.date_format(F.min("captured_at"), "yyyy-MM-dd HH:mm:ss").alias("captured_at"), F.count("*").alias("samples")), of_kinds("select {name} as profile_id, '{kind}' as profile_type, '2024-01-01 00:0' || half || ':00' as captured_at, count(*) as samples from stacks group by half"))
on_profiles("A06_latest", lambda p: pprof.latest(p).groupBy("profile_type", "profile_id").agg(F.count("*").alias("samples")), of_kinds("select {name} as profile_id, '{kind}' as profile_type, count(*) as samples from stacks where half = 1 group by half"))
on_profiles("C14_detected_kind", lambda p: p.select("profile_type", pprof.detect_kind(F.col("sample_types.type")).alias("detected")).distinct(), "select unnest(['cpu', 'heap', 'goroutine', 'block', 'mutex']) as profile_type, unnest(['cpu', 'heap', 'goroutine', 'block', 'block']) as detected")
on_profiles("F05_type_totals", pprof.totals, f"with {st.PROFILES} " + " union all ".join(f"select '{k}{_NAME} as profile_id, '{t}' as type, '{u}' as unit, cast(sum({v}) as bigint) as total from stacks group by half" for k, types in st.PROFILE_KINDS.items() for t, u, v in types))
_CPU = "cpu" + _NAME
_FLAT = f"with {st.PROFILES}, s as (select '{_CPU} as profile_id, stack, v * 1000 as v from stacks where v <> 0), f as (select profile_id, func, cast(sum(case when pos = 3 then v else 0 end) as bigint) as flat, cast(sum(v) as bigint) as cum from (select profile_id, unnest(stack) as func, unnest([1, 2, 3]) as pos, v from s) group by all), t as (select profile_id, cast(sum(v) as bigint) as total from s group by 1), r as (select f.*, flat * 100.0::double / total as flat_pct, cum * 100.0::double / total as cum_pct from f join t using (profile_id))"
_COLUMNS = ["profile_id", "func", "flat", "cum", "flat_pct", "cum_pct"]
on_profiles("F04_functions", lambda p: pprof.top_functions(p.where("profile_type = 'cpu'"), "cpu").select(*_COLUMNS), f"{_FLAT} select * from r")
for _by in ("flat", "cum"):
    on_profiles(f"G10_top_by_{_by}", lambda p, by=_by: pprof.top_functions(p.where("profile_type = 'cpu'"), "cpu", 4, by).select(*_COLUMNS, "rank"), f"{_FLAT} select * from (select *, cast(row_number() over (partition by profile_id order by {_by} desc, func) as integer) as rank from r) where rank <= 4")
on_profiles("F06_to_stacks", lambda p: pprof.to_samples(p.where("profile_type = 'cpu'"), "samples").select("profile_id", F.concat_ws(";", "stack").alias("stack"), "value"), f"with {st.PROFILES} select '{_CPU} as profile_id, array_to_string(stack, ';') as stack, n as value from stacks")
on_profiles("C15_aliased_type", lambda p: p.where("profile_type = 'block'").groupBy("profile_id").agg(F.sum(pprof.value_of("delay")).alias("delay"), F.sum(pprof.value_of("goroutine")).alias("counted"), F.count(pprof.value_of("goroutine", aliases=False)).alias("none")), f"with {st.PROFILES} select 'block{_NAME} as profile_id, cast(sum(v) as bigint) as delay, cast(null as bigint) as counted, cast(0 as bigint) as none from stacks group by half")
_GROUPS = f"with {st.PROFILES}, g as (select 'goroutine{_NAME} as profile_id, array_to_string(stack, ';') as stack, stack[3] as top_func, n as count from stacks), t as (select profile_id, cast(sum(count) as bigint) as total from g group by 1), r as (select g.*, count * 100.0::double / total as pct, cast(row_number() over (partition by profile_id order by count desc, stack) as integer) as rank from g join t using (profile_id))"
on_profiles("F09_goroutine_groups", lambda p: pprof.goroutine_groups(p.where("profile_type = 'goroutine'"), 0), f"{_GROUPS} select * from r")
on_profiles("G12_top_goroutine_groups", lambda p: pprof.goroutine_groups(p.where("profile_type = 'goroutine'"), 5), f"{_GROUPS} select * from r where rank <= 5")


def on_dump(name: str, operator, sql: str) -> None:
    register(name, sql)(lambda spark, d: operator(st.dump(spark, d)))


_STRINGS = [*st.DUMP_CLASSES, "nations", "region", "suppliers", "key", "nation", "name", "balance"]
_CLASS_NAMES = {k: 100 + v for k, v in zip(("java.lang.Class", "java.lang.Object[]", "com.shop.Region", "com.shop.Nation", "com.shop.Supplier", "com.shop.Named", "com.shop.Entity"), st.DUMP_CLASSES.values(), strict=True)}
on_dump("A08_A09_dump_header", lambda t: t["header"], "select cast(8 as integer) as id_size, cast(1700000000000 as bigint) as taken_ms")
on_dump("A10_dump_strings", lambda t: t["strings"], f"select unnest(range(1, {len(_STRINGS) + 1})) as name_id, unnest({_STRINGS}) as text")
on_dump("A11_J02_dump_classes", lambda t: t["classes"].select("class_id", "name", "instance_size"), f"select unnest({list(_CLASS_NAMES.values())}::bigint[]) as class_id, unnest({list(_CLASS_NAMES)}) as name, unnest([0, 0, 8, 20, 24, 16, 8]::bigint[]) as instance_size")
on_dump("A12_dump_roots", lambda t: t["roots"], f"select distinct {st.DUMP_IDS['region']} + n_regionkey as obj_id, 'JNI_GLOBAL' as root_type from nation")
on_dump("A13_dump_class_fields", lambda t: t["class_fields"].select("class_id", "name", "type"), "select unnest([103, 104, 104, 104, 105, 106, 107]::bigint[]) as class_id, unnest(['nations', 'region', 'suppliers', 'key', 'balance', 'name', 'nation']) as name, unnest([2, 2, 2, 10, 11, 2, 2]::integer[]) as type")
on_dump("A14_A17_A19_J01_dump_objects", lambda t: t["objects"].select("obj_id", "class_name", "shallow"), f"with {st.DUMP} select * from objects")
on_dump("A15_A16_dump_references", lambda t: t["refs"], f"with {st.DUMP} select * from refs")
on_dump("A18_dump_summary", lambda t: t["summary"], "select cast(123 as bigint) as live_bytes, cast(45 as bigint) as live_instances")
on_dump("A12_nothing_undecoded", lambda t: t["undecoded"].agg(F.count("*").alias("n")), "select cast(0 as bigint) as n")
on_dump("J10_class_chain", lambda t: heap.class_chain(t["classes"]), f"select unnest({list(_CLASS_NAMES.values())}::bigint[]) as class_id, unnest({list(_CLASS_NAMES.values())}::bigint[]) as ancestor_id, cast(0 as integer) as depth union all select unnest([105, 105, 106]), unnest([106, 107, 107]), unnest([1, 2, 1])")
_SUPPLIER = st.DUMP_IDS["supplier"] + 1
on_dump("M18_G16_object_fields", lambda t: heap.object_fields(t["objects"], t["refs"], t["classes"], t["class_fields"], t["objects"].withColumn("retained", F.col("shallow")), _SUPPLIER).select("name", "type", "to_id", "class_name"), f"select unnest(['nation', 'name', 'balance']) as name, unnest([2, 2, 11]::integer[]) as type, unnest([{st.DUMP_IDS['nation']} + s_nationkey, {st.DUMP_IDS['name']} + 1, null]::bigint[]) as to_id, unnest(['com.shop.Nation', 'byte[]', null]) as class_name from supplier where s_suppkey = 1")


def _kept(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    graphs.save(st.heap(spark, d), path)
    return graphs.read(spark, path, "graph")


register("A20_B09_kept_graph", f"with {st.HEAP} select class_name, count(*) as instances, cast(sum(shallow) as bigint) as total_size from objects group by 1")(lambda spark, d: heap.histogram(_kept(spark, d)["objects"]).select("class_name", "instances", "total_size"))
register("A20_kept_references", f"with {st.HEAP} select field, count(*) as n from refs group by 1")(lambda spark, d: _kept(spark, d)["refs"].groupBy("field").agg(F.count("*").alias("n")))


def _lookups(spark: SparkSession, d: str) -> dict:
    path, h = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", st.heap(spark, d)
    graphs.save_lookups({"objects": h["objects"], "refs": h["refs"], "roots": h["roots"], "sizes": h["objects"].withColumn("retained", F.col("shallow") * 3)}, path, 16)
    return views.kept_views(graphs.Lookups(spark, path))


register("Q_API3_A20_kept_holders", f"with {st.HEAP} select from_id, class_name, field, shallow from refs join objects on obj_id = from_id where to_id = {5 * st.STRIDE + 7} order by from_id, field limit 20")(lambda spark, d: _lookups(spark, d)["retainers"](5 * st.STRIDE + 7))
register("Q_API3_A20_kept_held", f"with {st.HEAP}, f as (select field, to_id from refs where from_id = {st.STRIDE} + 3 order by field, to_id limit 10) select field, to_id, class_name, shallow, shallow * 3 as retained from f join objects on obj_id = to_id")(lambda spark, d: _lookups(spark, d)["gc-root-retained"](st.STRIDE + 3, 10))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _json(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "functions")
    sinks.write_json(stats.self_by_function(st.samples(spark, d)).select("profile_id", "func", "self"), path, by=["profile_id"])
    return spark.read.json(path).select("profile_id", "func", "self")


register("B01_json_files", f"with {st.SAMPLES} select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all")(_json)


def _flame(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "flame")
    sinks.write_flame(fg.roll_up(st.samples(spark, d)), path, 0.5)
    at = lambda p: F.get_json_object("document", p)
    return sinks.read_documents(spark, path).select("profile_id", at("$.value").cast("bigint").alias("value"), F.json_array_length(at("$.children")).alias("regions"), at("$.children[0].name").alias("largest"), at("$.children[0].children[0].value").cast("bigint").alias("below"))


register(
    "B02_K03_flame_documents",
    f"""with {st.SAMPLES}, t as (select profile_id, cast(sum(value) as bigint) as value from samples group by 1),
    a as (select profile_id, stack[1] as name, cast(sum(value) as bigint) as v from samples group by all), b as (select profile_id, stack[1] as r, stack[2] as name, cast(sum(value) as bigint) as v from samples group by all),
    kept as (select a.*, row_number() over (partition by profile_id order by v desc, name) as i from a join t using (profile_id) where v >= floor(t.value * 0.5 / 100)),
    first as (select * from kept where i = 1)
    select profile_id, value, cast((select count(*) from kept where kept.profile_id = t.profile_id) as integer) as regions, first.name as largest,
           (select max(b.v) from b join first f on b.profile_id = f.profile_id and b.r = f.name where b.profile_id = t.profile_id) as below
    from t join first using (profile_id)""",
)(_flame)


def _call(spark: SparkSession, d: str) -> DataFrame:
    path, frames = _path(spark, "call"), cg.frames(cg.busy(st.samples(spark, d)))
    sinks.write_call_graph(cg.nodes(frames), cg.edges(frames), path, 2.0, 0.5)
    count = lambda p: F.json_array_length(F.get_json_object("document", p)).alias(p[2:])
    return sinks.read_documents(spark, path).select("profile_id", count("$.nodes"), count("$.edges"), F.get_json_object("document", "$.nodes[0].id").alias("first"))


register(
    "B04_call_documents",
    f"""with {st.WHOLE}, n as (select profile_id, node_id, sum(value) / total * 100 as pct from frames join alls using (profile_id) group by profile_id, node_id, total having sum(value) / total * 100 >= 2.0),
    e as (select profile_id, caller as source, node_id as target, sum(value) / total * 100 as weight from frames join alls using (profile_id) where caller is not null group by profile_id, caller, node_id, total)
    select profile_id, cast(count(*) as integer) as nodes, (select cast(count(*) as integer) from e where e.profile_id = n.profile_id and weight >= 0.5 and exists (select 1 from n a where a.profile_id = e.profile_id and a.node_id = source) and exists (select 1 from n b where b.profile_id = e.profile_id and b.node_id = target)) as edges, min(node_id) as first
    from n group by profile_id""",
)(_call)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "folded")
    sinks.write_folded(fg.roll_up(st.samples(spark, d)), path)
    return spark.read.text(path).select("profile_id", F.col("value").alias("line"))


register("B03_folded_files", f"with {st.SAMPLES} select profile_id, array_to_string(stack, ';') || ' ' || cast(sum(value) as bigint) as line from samples group by profile_id, stack")(_folded)
register("B10_summaries", f"with {st.SAMPLES}, f as (select profile_id, stack[-1] as func, cast(sum(value) as bigint) as self from samples group by all), r as (select *, row_number() over (partition by profile_id order by self desc, func) as rank from f) select profile_id, '{{\"rank\":' || rank || ',\"func\":\"' || func || '\",\"self\":' || self || '}}' as summary from r where rank <= 15")(
    lambda spark, d: sinks.summary(stats.top_functions(st.samples(spark, d)).drop("self_pct"), "functions")
)


def _codecs(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for codec in ("gzip", "none"):
        path = _path(spark, "codec")
        sinks.write_json(st.table(spark, d, "region"), path, codec)
        rows = sinks.Store(spark, path).get("").where("path like '%.json%'").select(F.lit(codec).alias("written"), sinks.codec_of("content").alias("found")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


register("B13_codecs", "select unnest(['gzip', 'none']) as written, unnest(['gzip', 'none']) as found")(_codecs)


def _heap_files(spark: SparkSession, d: str) -> DataFrame:
    path, h = _path(spark, "heap"), st.heap(spark, d)
    sinks.write_heap({"histogram": heap.histogram(h["objects"]).select("class_name", "instances", "total_size"), "roots": h["roots"]}, path)
    return spark.read.json(f"{path}/histogram").join(spark.read.json(f"{path}/roots").agg(F.count("*").alias("roots"))).select("class_name", "instances", "total_size", "roots")


register("B07_heap_files", f"with {st.HEAP} select class_name, count(*) as instances, cast(sum(shallow) as bigint) as total_size, (select count(*) from roots) as roots from objects group by 1")(_heap_files)
register("A09_record_index", f"select 'class' as kind, cast({len(st.DUMP_CLASSES)} as bigint) as n union all select 'segment', count(*) + 1 from nation union all select 'string', cast({len(_STRINGS)} as bigint) union all select 'summary', cast(1 as bigint)")(
    lambda spark, d: hprof.index(spark, st.dump_file(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))
)
