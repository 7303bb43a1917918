import gzip
import struct

import pytest
from pyspark.sql import functions as F

from heliograph.functions import classes, values
from heliograph.functions import frames as fn
from heliograph.operators import advisor, callgraph, flamegraph, leaks, stats
from heliograph.sources import collapsed, pprof


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in rows.select("i", make("x").alias("y")).orderBy("i").collect()]


def test_frames(spark):
    frames = ["foo(bar)", "foo", "foo(bar(baz))", "foo()", "foo(bar"]
    assert column(spark, frames, fn.frame_function) == ["foo", "foo", "foo(bar", "foo", "foo(bar"]
    assert column(spark, frames, fn.frame_module) == ["bar", "", "baz)", "", ""]
    groups = ["worker-1", "thread_1", "pool#1", "grpc-nio-worker-123", "main", "123", "", "C2 CompilerThre-26", "XWorker#0 tid=12"]
    assert column(spark, groups, fn.thread_group) == ["worker", "thread", "pool", "grpc-nio-worker", "main", "123", "", "C2 CompilerThre", "XWorker#0 tid="]
    idle = ["swapper", "swapper/0", "[swapper]", "[swapper/0]", "worker-1", "myswapper", ""]
    assert column(spark, idle, fn.is_idle_in_graphs) == [True] * 4 + [False] * 3
    assert column(spark, ["github.com/pkg/errors.Wrap", "runtime.main", "main.main", ".foo"], fn.go_module) == ["github.com/pkg/errors", "runtime", "main", ".foo"]
    names = ["java/lang/String", "[Ljava/lang/Object;", "[[I", "[B", "[D"]
    assert column(spark, names, fn.class_name) == ["java.lang.String", "java.lang.Object[]", "int[][]", "byte[]", "double[]"]
    assert column(spark, ["[main tid=12]", "main-x/7", "-x", "a/"], fn.thread_id) == [12, 7, -1, -1]


def test_method_parts(spark):
    names = ["/lib/libc.so.6::malloc", "[kernel] do_fork", "ns::Cls::run", "runtime/debug.Stack", "com.a.B.run_[i]", "/usr/bin/x", "main"]
    got = column(spark, names, fn.method_parts)
    assert [tuple(g) for g in got] == [
        ("native_lib", "/lib", "libc.so.6", "malloc"), ("kernel", "", "[kernel]", "do_fork"), ("cpp", "ns", "Cls", "run"), ("go", "runtime/debug", "debug", "Stack"),
        ("java", "com.a", "B", "run"), ("path", "/usr/bin", "", "x"), ("simple", "", "", "main"),
    ]
    assert column(spark, ["(*Graph).Walk", "github.com/a/foo.Bar", "com.x.Y.z", "a::b"], fn.search_term) == ["Walk", "Bar", "Y.z", "b"]


def test_classes_and_values(spark):
    names = ["byte[]", "java.util.HashMap", "io.netty.util.internal.X", "com.acme.Order", "com.acme.Order[]"]
    assert column(spark, names, classes.class_category) == ["primitive", "jdk", "framework", "application", "jdk"]
    assert column(spark, ["com.a.X$$Lambda$1", "jdk.proxy2.P", "a.PoolAllocator", "com.a.B"], classes.is_top_level_filtered) == [True, True, True, False]
    assert column(spark, ["1.50", "2", "0.126"], lambda x: values.format_percent(F.col(x).cast("double"))) == ["1.5", "2", "0.13"]
    assert column(spark, ["12", "2048"], lambda x: values.format_bytes(F.col(x).cast("long"))) == ["12 B", "2.00 KB"]
    # Ties to even, of the double's exact value: 8.125, 0.125 and 2.5 are ties, 1.005, 1.015 and 0.045 are not.
    ties = ["8.125", "0.125", "0.375", "1.005", "1.015", "0.045", "-0.125", "-0.0", "1e300", "99.995", "0.005"]
    assert column(spark, ties, lambda x: values.fixed(F.col(x).cast("double"), 2)) == ["8.12", "0.12", "0.38", f"{1.005:.2f}", f"{1.015:.2f}", f"{0.045:.2f}", "-0.12", "-0.00", "1" + "0" * 300 + ".00", f"{99.995:.2f}", f"{0.005:.2f}"]
    assert column(spark, [str(4352 * 512), "12"], lambda x: values.format_bytes(F.col(x).cast("long"))) == ["2.12 MB", "12 B"]
    # 1.15 is a double below it, 1.25 a tie.
    assert column(spark, ["1150000000", "1250000000", "1050000"], lambda x: values.format_number(F.col(x).cast("long"))) == ["1.1G", "1.2G", "1.1M"]
    assert column(spark, ["1250", "1350", "1000000250"], lambda x: values.format_number(F.col(x).cast("long"))) == ["1.2K", "1.4K", "1.0G"]
    assert column(spark, ["1125000", "1135000"], lambda x: values.format_duration_ns(F.col(x).cast("long"))) == ["1.12ms", "1.14ms"]
    assert values.parse_preset(" Fast ") == "quick" and values.parse_mode("JAVA-CPU") == "java-cpu"


LINES = ["main-thread-1/1234;com.a.App.process(App.java) 100", "  ", "abc", "a;b x", "5_2175_x;main-1/2;f 1", "t-1/3;a;;[];b 3", "t-1/3;a 99999999999999999999"]


def test_collapsed_lines(spark):
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(LINES)], "profile_id string, sample_id long, line string")
    got = [(r.sample_id, r.thread_name, r.tid, r.stack, r.value) for r in collapsed.parse_lines(rows).orderBy("sample_id").collect()]
    assert got == [(0, "main-thread", 1234, ["com.a.App.process"], 100), (4, "main", 2, ["f"], 1), (5, "t", 3, ["a", "b"], 3)]
    with pytest.raises(Exception, match="not a sample"):
        collapsed.parse_lines(rows, strict=True).collect()


SAMPLES = [("p", 1, "main-1", 1, ["a", "b"], 50), ("p", 2, "main-1", 1, ["a", "b"], 30), ("p", 3, "w-2", 2, ["a", "c", "a"], 20), ("p", 4, "swapper/0", 0, ["idle"], 7), ("p", 5, "w-2", 2, [], 3)]
SCHEMA = "profile_id string, sample_id long, thread_name string, tid int, stack array<string>, value long"


def test_graphs_conserve_samples(spark):
    samples = spark.createDataFrame(SAMPLES, SCHEMA)
    nodes = flamegraph.roll_up(samples)
    assert nodes.where("depth = 0").head().value == 110 and nodes.agg(F.sum("self")).head()[0] == 110
    assert {(tuple(r.path), r.value, r.self) for r in nodes.where("depth > 0").collect()} == {(("a",), 100, 0), (("a", "b"), 80, 80), (("a", "c"), 20, 0), (("a", "c", "a"), 20, 20), (("idle",), 7, 7)}
    frames = callgraph.frames(callgraph.busy(samples))
    got = {r.node_id: (r.self_time, r.total_time, r.call_count, r.is_recursive) for r in callgraph.nodes(frames).collect()}
    assert got == {"a": (20, 120, 4, True), "b": (80, 80, 2, False), "c": (0, 20, 1, False)}
    assert {(r.source, r.target, r["count"]) for r in callgraph.edges(frames).collect()} == {("a", "b", 80), ("a", "c", 20), ("c", "a", 20)}
    assert flamegraph.nested(nodes, "p")["children"][0]["name"] == "a"
    assert {r.line for r in flamegraph.folded(nodes).collect()} == {"a;b 80", "a;c;a 20", "idle 7"}
    top = [(r.func, r.self) for r in stats.top_functions(samples, 2).orderBy("rank").collect()]
    assert top == [("b", 80), ("a", 20)]


def test_severity(spark):
    mib = 1 << 20
    cases = [("heap", 5.0, 100.0, "none"), ("heap", 15.0, 5.0 * mib, "low"), ("heap", 30.0, 30.0 * mib, "medium"), ("heap", 80.0, 80.0 * mib, "high"), ("heap", 200.0, 200.0 * mib, "critical"), ("goroutine", 2.0, 5.0, "none"), ("goroutine", 200.0, 600.0, "critical")]
    for kind, pct, rate, want in cases:
        row = spark.range(1).select(leaks.severity(kind, F.lit(pct), F.lit(rate)).alias("s")).head()
        assert row.s == want


def test_advice(spark):
    rows = spark.createDataFrame([("hot", 20.0), ("G1 GC", 4.0), ("gc", 2.0), ("monitorEnter", 3.0), ("pthread_mutex_lock", 2.0), ("Method.invoke", 3.0), ("x", 1.0)], "func string, self_pct double")
    got = {(r.rule, r.func) for r in advisor.advise(rows).collect()}
    assert got == {("R01", "hot"), ("R02", ""), ("R03", "monitorEnter, pthread_mutex_lock"), ("R05", "Method.invoke")}


def number(x):
    out = b""
    while True:
        out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
        x >>= 7
        if not x:
            return out


def message(*fields):
    out = b""
    for n, v in fields:
        out += number(n << 3 | (0 if isinstance(v, int) else 2)) + (number(v) if isinstance(v, int) else number(len(v)) + v)
    return out


def test_pprof(spark, tmp_path):
    strings = ["", "samples", "count", "main", "leaf", "m.go", "cpu", "nanoseconds"]
    profile = message(
        (1, message((1, 1), (2, 2))), (1, message((1, 6), (2, 7))),
        (2, message((1, number(1) + number(2)), (2, number(3) + number(30)))), (2, message((1, 2), (2, 1), (2, 10))),
        (4, message((1, 1), (3, 0x40), (4, message((1, 1), (2, 9))))), (4, message((1, 2), (3, 0x50), (4, message((1, 2), (2, 5))))),
        (5, message((1, 1), (2, 4), (4, 5))), (5, message((1, 2), (2, 3), (4, 5))), *((6, s.encode()) for s in strings), (10, 1000),
    )
    (tmp_path / "cpu").mkdir()
    (tmp_path / "cpu" / "cpu_20240102_030405.pprof").write_bytes(gzip.compress(profile))
    rows = pprof.read(spark, f"file://{tmp_path}")
    first = rows.head()
    assert (first.profile_id, first.profile_type, str(first.captured_at)) == ("cpu_20240102_030405", "cpu", "2024-01-02 03:04:05")
    got = {r.func: (r.flat, r.cum) for r in pprof.top_functions(rows, "cpu").collect()}
    assert got == {"leaf": (30, 30), "main": (10, 40)}
    assert {(tuple(r.stack), r.value) for r in pprof.to_samples(rows, "samples").collect()} == {(("main", "leaf"), 3), (("main",), 1)}
    assert struct.calcsize("<Q") == 8


def test_edges_are_made_once_for_all_levels(spark, monkeypatch):
    """Searches over call graphs look at stored edges, and their queries at stored stacks, however many levels there are."""
    from heliograph.plans import profile_queries, storage

    written = []
    stored = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    monkeypatch.setattr(profile_queries, "stored", storage.stored)
    links = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2"), ("b", "c", "1"), ("c", "d", "1")], "source string, target string, profile_id string")
    chain = callgraph.caller_chains(links, spark.createDataFrame([("d",)], "node_id string"))
    assert {(r.node_id, r.depth) for r in chain.collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 3)}
    assert written[0] == "links" and written.count("links") == 1
    written.clear()
    hidden = spark.createDataFrame([("b",), ("c",)], "node_id string")
    assert [tuple(r) for r in callgraph.bridges(links, hidden).collect()] == [("a", "d")]
    assert written[:2] == ["links", "hidden"]
    written.clear()
    profile_queries.QUERIES["F18_call_edges"](spark, "/root/testdata/sf0.001")
    assert written == ["stacks"]
