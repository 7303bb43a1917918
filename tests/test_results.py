"""Modes, files of results, views, the task store and streams, on small fixtures."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from heliograph.functions import frames as fn
from heliograph.functions import values
from heliograph.operators import callgraph, flamegraph, leaks, retainers
from heliograph.plans import modes, sinks, views
from heliograph.sources import graphs, hprof, pprof
from heliograph.streaming import intake, tasks

SAMPLES = [("p", 1, "main-1", 1, ["a", "b"], 50), ("p", 2, "main-1", 1, ["a", "b"], 30), ("p", 3, "w-2", 2, ["a", "c", "a"], 20), ("p", 4, "swapper/0", 0, ["idle"], 7)]
SCHEMA = "profile_id string, sample_id long, thread_name string, tid int, stack array<string>, value long"


def samples(spark, rows=SAMPLES):
    return spark.createDataFrame(rows, SCHEMA)


def test_flame_documents_are_the_tree(spark):
    nodes = flamegraph.roll_up(samples(spark))
    tree = flamegraph.nested(nodes, "p")
    assert (tree["name"], tree["value"], [c["name"] for c in tree["children"]]) == ("root", 107, ["a", "idle"])
    a = tree["children"][0]
    assert [(c["name"], c["value"], c["self"]) for c in a["children"]] == [("b", 80, 80), ("c", 20, 0)] and a["children"][1]["children"][0]["value"] == 20
    assert flamegraph.documents(nodes.where("false")).count() == 0 and flamegraph.nested(nodes, "no such") == {}
    both = flamegraph.merged(nodes.unionByName(nodes.withColumn("profile_id", F.lit("q"))))
    assert both.where("depth = 0").head().value == 214 and {r.name for r in both.where("depth = 1").collect()} == {"p", "q"}


def test_mode_writes_its_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.folded").write_text("main-1/1;a;b 80\nw-2/2;a;c;a 20\n\nbroken\n")
    out = f"file://{tmp_path}/out"
    results = modes.run(spark, f"file://{tmp_path}/in", "CPU", "quick", out)
    assert {r.func: r.self for r in results["functions"].collect()} == {"b": 80, "a": 20}
    assert {r.rule for r in results["suggestions"].collect()} == {"R01"}
    assert json.loads(views.flame_document(spark, out).head().document)["value"] == 100
    assert views.artifact(spark, out, "functions").count() == 2
    found = next((tmp_path / "out" / "flame_documents").rglob("*.gz"))
    assert gzip.decompress(found.read_bytes()).startswith(b'{"name":"root"')
    with pytest.raises(FileNotFoundError):
        views.flame_document(spark, f"file://{tmp_path}/in", "heap")
    with pytest.raises(modes.EmptyData):
        modes.analyze(samples(spark, []), "java-cpu")
    with pytest.raises(ValueError, match="no such mode"):
        modes.analyze(samples(spark), "java-disk")
    with pytest.raises(ValueError, match="no reader"):
        graphs.read(spark, out, "xml")


def test_profiles_written_are_read(spark, tmp_path):
    kinds = [("samples", "count"), ("cpu", "nanoseconds")]
    raw = pprof.encode(kinds, [(["main", "f"], [3, -30]), (["main"], [1, 1 << 40])], 5)
    got = list(pprof.decode(raw))
    assert [(v, [x["lines"][0]["func"] for x in at]) for _, v, at, _ in got] == [([3, -30], ["f", "main"]), ([1, 1 << 40], ["main"])]
    assert got[0][3] == 5 and [(t["type"], t["unit"]) for t in got[0][0]] == kinds


def test_segments_are_split_between_records(spark, tmp_path, monkeypatch):
    from test_heap import dump

    path = tmp_path / "a.hprof"
    path.write_bytes(dump())
    whole = {k: sorted(map(repr, t.collect())) for k, t in hprof.read(spark, f"file://{path}").items()}
    monkeypatch.setattr(hprof, "PART_BYTES", 60)
    assert hprof.index(spark, f"file://{path}").where("kind = 'segment'").count() > 2
    assert {k: sorted(map(repr, t.collect())) for k, t in hprof.read(spark, f"file://{path}").items()} == whole
    with open(path, "rb") as file:
        raw = file.read()
        at = raw.index(b"\x1c", raw.index(b"\x0c")) if b"\x1c" in raw else 0
        length = int.from_bytes(raw[at + 5 : at + 9], "big")
        parts = list(hprof.parts_of(file, at + 9, length, 8))
        assert len(parts) > 2 and parts[0][0] == at + 9 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) == length
        rows = [r for a, n in parts for r in hprof.sub_records(hprof._Bytes(file, a, n, 8))]
        assert rows == list(hprof.sub_records(hprof._Bytes(file, at + 9, length, 8)))
    assert whole["undecoded"] == []
    broken = raw.replace(b"\x23" + (1003).to_bytes(8, "big"), b"\x77" + (1003).to_bytes(8, "big"))
    path.write_bytes(broken)
    assert [(r.kind, r.tag) for r in hprof.read(spark, f"file://{path}")["undecoded"].collect()] == [("unknown", 0x77)]


def test_kept_graph(spark, tmp_path):
    objects = spark.createDataFrame([(1, "A", 8)], "obj_id long, class_name string, shallow long")
    refs, roots = spark.createDataFrame([], "from_id long, to_id long, field string"), spark.createDataFrame([(1, "JNI")], "obj_id long, root_type string")
    path = f"file://{tmp_path}/kept"
    assert graphs.save({"objects": objects, "refs": refs, "roots": roots}, path) == ["objects", "refs", "roots"]
    assert graphs.load(spark, path)["roots"].collect() == roots.collect()
    with pytest.raises(ValueError, match="needs refs"):
        graphs.save({"objects": objects, "roots": roots}, path)


def test_store(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    store = sinks.Store(spark, f"file://{tmp_path}/store")
    assert store.put(f"file://{tmp_path}/x.txt", "a/b.txt").endswith("store/a/b.txt") and store.exists("a/b.txt")
    assert bytes(store.get("a/b.txt").head().content) == b"hello"
    assert store.delete("a/b.txt") and not store.exists("a/b.txt") and not store.delete("a/b.txt")
    with pytest.raises(ValueError, match="leave"):
        store.url("../x")


def test_results_are_updated(spark):
    old, new = spark.createDataFrame([("a", 1, "x")], "tid string, version int, text string"), spark.createDataFrame([("b", 1, "y")], "tid string, version int, text string")
    assert sorted(r.tid for r in sinks.results_upsert(old, new).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="doesn't exist"):
        sinks.results_updated(old, new)
    assert sinks.suggestions_kept(spark.createDataFrame([("a",), (" ",), (None,)], "suggestion string")).count() == 1


def test_owned_children(spark):
    # 0 list -> 1 Object[] -> 2 and 3; 4 holder -> 2 by an owning field, -> 3 by another.
    objects = spark.createDataFrame([(0, "java.util.ArrayList", 16), (1, "java.lang.Object[]", 16), (2, "x.Item", 8), (3, "x.Item", 8), (4, "x.Holder", 8)], "obj_id long, class_name string, shallow long")
    refs = spark.createDataFrame([(0, 1, "data"), (1, 2, "[0]"), (1, 3, "[1]"), (4, 2, "value"), (4, 3, "other")], "from_id long, to_id long, field string")
    roots = spark.createDataFrame([(0, "JNI"), (4, "JNI")], "obj_id long, root_type string")
    from heliograph.operators import heap

    sizes = heap.retained(objects, heap.dominators(refs, roots))
    row = retainers.owned_sizes(refs, objects, sizes, "x.Holder").head()
    assert (row.retained, row.through_arrays, row.loaded_classes, row.owned) == (8, 8, 0, 16)
    row = retainers.diagnosis(refs, objects, sizes, "x.Holder").head()
    assert (row.fields, row.dominated_fields, row.shared, row.through_arrays, row.with_arrays) == (2, 0, 16, 16, 24)
    few = retainers.business(refs, objects, objects.where("class_name = 'x.Item'"), roots).collect()
    assert [(r.class_name, r.depth, r["count"], r.is_root) for r in few] == [("x.Holder", 1, 2, True)]


def test_stacks_of_functions(spark):
    rows = leaks.any_stack(spark.createDataFrame([("b",), ("a",), ("no",)], "func string"), samples(spark))
    assert {r.func: r.sample_stack for r in rows.collect()} == {"b": "a;b", "a": "a;c;a", "no": None}


def test_chains_are_whole_unless_a_view_is_asked_for(spark):
    """More callers than a view shows, and a way longer than one: all are found, at their depths."""
    rows = [(f"n{i:04d}", "x") for i in range(2100)] + [(f"w{i}", f"w{i - 1}" if i else "n0000") for i in range(52)]
    found = callgraph.caller_chains(spark.createDataFrame(rows, "source string, target string"), spark.createDataFrame([("x",)], "node_id string"))
    got = {r.node_id: r.depth for r in found.collect()}
    assert got == {"x": 0} | {f"n{i:04d}": 1 for i in range(2100)} | {f"w{i}": i + 2 for i in range(52)}


def test_chains_stop_at_the_view(spark):
    links = spark.createDataFrame([(f"n{i:03d}", "x") for i in range(50)], "source string, target string")
    got = callgraph.caller_chains(links, spark.createDataFrame([("x",)], "node_id string"), max_nodes=10).collect()
    assert len(got) == 10 and {r.node_id for r in got} == {"x", *(f"n{i:03d}" for i in range(9))}
    way = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(40)], "source string, target string")
    hidden = spark.createDataFrame([(f"h{i}",) for i in range(1, 40)], "node_id string")
    assert [tuple(r) for r in callgraph.bridges(way, hidden).collect()] == [("h0", "h40")]


def test_thread_groups_by_pattern(spark):
    names = ["io-1", "a_2", "w[3]", "q#4", "pool-5-web", "main", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(fn.thread_group_by_pattern("n").alias("g")).collect()
    assert [r.g for r in rows] == ["io", "a", "w", "q", "web", "main", "unknown", "unknown"]
    assert values.parse_preset("deep") == "detailed"


TASK = "id long, tid string, type int, status int, analysis_status int, duration int, master_tid string"


def test_stream_of_tasks(spark, tmp_path):
    """Pending tasks are all handled, a few a batch; failed and analysed ones don't come round again."""
    landing, waiting, handled = tmp_path / "in", tmp_path / "waiting", []
    landing.mkdir()
    waiting.mkdir()
    rows = [{"id": i, "tid": f"t{i}", "type": 1, "status": 2 if i % 4 else 3, "analysis_status": 0 if i % 3 else 2, "duration": 600 if i % 2 else 5, "master_tid": "m"} for i in range(12)]
    (landing / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = intake.intake(spark, [f"file://{landing}", intake.Source("landing", "again", {"path": f"file://{waiting}/*"})])
    for _ in range(4):
        writer = tasks.process(stream, lambda batch, n: handled.extend(r.tid for r in batch.collect()), f"file://{tmp_path}/checkpoint", workers=3, reserved=1, waiting=f"file://{waiting}")
        writer.trigger(availableNow=True).start().awaitTermination(120)
    want = {r["tid"] for r in rows if r["status"] == 2 and r["analysis_status"] == 0}
    assert set(handled) == want and len(handled) == len(want)


def test_polled_table(spark, tmp_path):
    table, handled = spark.createDataFrame([(i, f"t{i}", 1, 2, 0, 5, "m") for i in range(30)], TASK), []
    query = intake.polled(spark, lambda: table, lambda batch, n: handled.append([r.id for r in batch.collect()]), f"file://{tmp_path}/checkpoint", seconds=1, n=3).start()
    try:
        for _ in range(60):
            if handled:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert handled[0] == [29, 28, 27]


def test_sources(spark):
    s = intake.Source("kafka", "q", {"n": "x", "on": "TRUE", "k": "5"})
    assert (s.number("n", 7), s.number("k", 0), s.flag("on"), s.flag("off", True), s.text("none", "d")) == (7, 5, True, True, "d")
    with pytest.raises(ValueError, match="no source of kind"):
        intake.intake(spark, [intake.Source("mail", "x")])
    posts = spark.createDataFrame([("GET", "{}"), ("POST", "{"), ("POST", '{"tid":"a","id":1}'), ("POST", '{"id":1}'), ("POST", " " * (intake.MOST_BYTES + 1)), ("POST", None)], "method string, body string")
    assert [r.c for r in posts.select(intake.answer("method", "body").alias("c")).collect()] == [405, 400, 202, 400, 413, 400]
    assert posts.limit(3).select(intake.answer("method", "body", False).alias("c")).collect()[2].c == 503


def test_children_of_few_objects_are_those_of_all(spark):
    # Two lists share 12 through their arrays; 20 and 21 hold it and 13 themselves.
    objects = spark.createDataFrame([(0, "java.util.ArrayList", 16), (1, "java.util.ArrayList", 16), (2, "java.lang.Object[]", 16), (3, "java.lang.Object[]", 16), (12, "x.Item", 8), (13, "x.Item", 8), (20, "x.Holder", 8), (21, "x.Holder", 8)], "obj_id long, class_name string, shallow long")
    refs = spark.createDataFrame([(0, 2, "data"), (1, 3, "data"), (2, 12, "[0]"), (3, 12, "[0]"), (3, 13, "[1]"), (20, 12, "value"), (21, 12, "value"), (21, 13, "value")], "from_id long, to_id long, field string")
    from heliograph.operators import heap

    sizes = heap.retained(objects, heap.dominators(refs, objects.where("obj_id in (0, 1, 20, 21)").select("obj_id")))
    whole = heap.shared_through_arrays(refs, objects, sizes)
    some = heap.shared_through_arrays(refs, objects, sizes, spark.createDataFrame([(21,), (0,)], "from_id long"))
    assert sorted(some.collect()) == sorted(whole.where("from_id in (0, 21)").collect()) and some.count() == 2


def test_lookups_of_references_read_them_once(spark, tmp_path, monkeypatch):
    """Both directions are sorted from one stored table, not from what the references are made of."""
    from heliograph.sources import graphs

    written = []
    monkeypatch.setattr(graphs, "stored", lambda df, name, keep=graphs.stored: (written.append(name), keep(df, name))[1])
    refs = spark.createDataFrame([(1, 2, "a"), (3, 2, "b"), (2, 4, "c")], "from_id long, to_id long, field string")
    graphs.save_lookups({"refs": refs}, f"file://{tmp_path}", 4)
    found = graphs.Lookups(spark, f"file://{tmp_path}")
    assert {r.from_id for r in found.of("refs_to", 2).collect()} == {1, 3} and [r.to_id for r in found.of("refs_from", 2).collect()] == [4]
    assert written == ["refs"]
