import itertools
import random

from pyspark.sql import functions as F

from heliograph.operators import advisor, heap


def tables(spark, edges, roots, n):
    objects = spark.createDataFrame([(i, f"c{i % 3}", 10 + i) for i in range(n)], "obj_id long, class_name string, shallow long")
    refs = spark.createDataFrame([(a, b, f"f{b}") for a, b in edges], "from_id long, to_id long, field string")
    return objects, refs, spark.createDataFrame([(r, "JNI") for r in roots], "obj_id long, root_type string")


def reach(edges, roots, without=None):
    seen, todo = set(), [r for r in roots if r != without]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x and b != without]
    return seen


def test_dominators_by_removal_of_nodes(spark):
    random.seed(3)
    for edges, roots, n in [([(1, 3), (2, 4), (4, 3)], [1, 2], 5), ([(0, 1), (1, 2), (2, 1), (0, 2), (2, 3)], [0], 5), (random.sample(list(itertools.permutations(range(9), 2)), 16), [0, 1], 9), *((random.sample(list(itertools.permutations(range(14), 2)), 24), [0], 14) for _ in range(2))]:
        objects, refs, tops = tables(spark, edges, roots, n)
        doms = heap.dominators(refs, tops)
        above = {r.obj_id: r.idom for r in doms.collect()}
        live = reach(edges, roots)
        assert set(above) == live
        for v in live:
            chain, at = [], v
            while at != heap.SUPER_ROOT:
                chain.append(at)
                at = above[at]
            assert set(chain) == {d for d in live if d == v or v not in reach(edges, roots, d)} and len(set(chain)) == len(chain)
        sizes = {r.obj_id: (r.retained, r.reachable) for r in heap.retained(objects, doms).collect()}
        for v in range(n):
            gone = live - reach(edges, roots, v) if v in live else {v}
            assert sizes[v] == (sum(10 + x for x in gone), v in live)


def test_dominators_of_a_long_list(spark, monkeypatch):
    """A list of 100,000 nodes, each with an item, some items shared: rounds follow the logarithm of its length."""
    from heliograph.operators import trees

    n, written = 100_000, []
    monkeypatch.setattr(trees, "stored", lambda df, name, keep=trees.stored: (written.append(name), keep(df, name))[1])
    node = spark.range(n)
    following = node.where(f"id < {n - 1}").select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    item = node.select(F.col("id").alias("from_id"), (F.col("id") - F.col("id") % 7 % 2 * 3 + 2 * n).alias("to_id"))
    refs = following.unionByName(item)
    doms = heap.dominators(refs, node.where("id = 0").select(F.col("id").alias("obj_id")))
    items = {}
    for i in range(n):
        items.setdefault(i - i % 7 % 2 * 3 + 2 * n, []).append(i)
    got = {r.obj_id: r.idom for r in doms.collect()}
    want = {i: i - 1 for i in range(n)} | {k: min(v) for k, v in items.items()}
    assert got == want and len(written) <= 120
    assert {w: written.count(w) for w in ("chains", "sums")}["chains"] <= 20
    objects = doms.select("obj_id", F.lit("c").alias("class_name"), F.lit(8).cast("long").alias("shallow"))
    sizes = heap.retained(objects, doms)
    below = dict.fromkeys(want, 1)
    for k in items:
        below[want[k]] += 1
    for i in range(n - 1, 0, -1):
        below[i - 1] += below[i]
    assert {r.obj_id: r.retained for r in sizes.where("reachable").collect()} == {i: 8 * b for i, b in below.items()}
    assert written.count("sums") <= 20


def test_shallow_graphs_go_level_by_level(spark, monkeypatch):
    """Few rounds, links shuffled once; repeated links and nodes met again from another level or below another top."""
    from heliograph.operators import trees

    written = []
    monkeypatch.setattr(trees, "stored", lambda df, name, keep=trees.stored: (written.append(name), keep(df, name))[1])
    edges = [(0, 2), (0, 2), (1, 3), (2, 4), (3, 4), (2, 5), (5, 6), (2, 6), (1, 7), (6, 7), (4, 8), (8, 4), (8, 8)]
    _, refs, tops = tables(spark, edges, [0, 1], 9)
    got = {r.obj_id: r.idom for r in heap.dominators(refs, tops).collect()}
    assert got == {0: -1, 1: -1, 2: 0, 3: 1, 4: -1, 5: 2, 6: 2, 7: -1, 8: 4}
    apart = [e for e in edges if e != (2, 6)]  # without it all is clear from single referrers and tops
    written.clear()
    objects, refs, tops = tables(spark, [e for e in apart if e != (8, 4)], [0, 1], 9)
    doms = heap.dominators(refs, tops)
    assert {r.obj_id: r.idom for r in doms.collect()} == got | {6: 5}
    assert set(written) == {"tops", "layer"} and len(written) <= 8
    written.clear()
    assert {r.obj_id: r.retained for r in heap.retained(objects, doms).collect()} == {0: 10 + 12 + 15 + 16, 1: 11 + 13, 2: 12 + 15 + 16, 3: 13, 4: 14 + 18, 5: 15 + 16, 6: 16, 7: 17, 8: 18}
    assert set(written) == {"below"} and len(written) <= 6


def test_levels_over_links_dealt_once(spark, monkeypatch):
    """No level shuffles the references again: they are kept by referrer, not stored; repeated ones do no harm."""
    written = []
    monkeypatch.setattr(heap, "stored", lambda df, name, keep=heap.stored: (written.append(name), keep(df, name))[1])
    _, refs, tops = tables(spark, [(0, 1), (0, 1), (1, 2), (2, 0), (0, 3), (3, 2), (4, 0)], [0], 5)
    assert {r.obj_id: r.level for r in heap.levels(refs, tops).collect()} == {0: 0, 1: 1, 3: 1, 2: 2}
    assert set(written) == {"level"}


def test_collections_own_what_their_arrays_hold(spark):
    # 0 list -> 1 Object[] -> 2 item; 3 holder -> 2, so the item is nobody's alone.
    objects = spark.createDataFrame([(0, "java.util.ArrayList", 16), (1, "java.lang.Object[]", 16), (2, "x.Item", 8), (3, "x.Holder", 8)], "obj_id long, class_name string, shallow long")
    refs = spark.createDataFrame([(0, 1, "data"), (1, 2, "[0]"), (3, 2, "item")], "from_id long, to_id long, field string")
    roots = spark.createDataFrame([(0, "JNI"), (3, "JNI")], "obj_id long, root_type string")
    sizes = heap.retained(objects, heap.dominators(refs, roots))
    got = {r.obj_id: (r.retained, r.idea) for r in heap.retained_with_collections(sizes, refs).collect()}
    assert got == {0: (32, 32), 1: (16, 16), 2: (8, 8), 3: (8, 16)}


def test_stratified_sample(spark):
    objects = spark.range(400).select(F.col("id").alias("obj_id"), F.lit("c").alias("class_name"), F.col("id").alias("shallow"))
    got = sorted(r.obj_id for r in heap.stratified_sample(objects, 40, 0.01).collect())
    ordered = list(range(399, -1, -1))
    want, at = [], 0
    for many, wanted in ((40, 16), (160, 14), (200, 10)):
        step = max(1, many // wanted)
        want += [ordered[at + i] for i in range(0, many, step)][:wanted]
        at += many
    assert got == sorted(want)


def test_empty_graph(spark):
    objects, refs, roots = tables(spark, [], [0], 2)
    none = roots.where("false")
    assert heap.dominators(refs, none).count() == 0
    assert {(r.obj_id, r.reachable, r.retained) for r in heap.retained(objects, heap.dominators(refs, none)).collect()} == {(0, False, 10), (1, False, 11)}
    assert [r.obj_id for r in heap.levels(refs, roots).collect()] == [0]


def dump() -> bytes:
    """A dump of class A (fields: next, count) and its subclass B (field: other), two instances, arrays and a root."""
    import struct

    u4, ident = (lambda x: struct.pack(">I", x)), (lambda x: struct.pack(">Q", x))
    record = lambda tag, body: struct.pack(">BII", tag, 0, len(body)) + body
    texts = {1: "java/lang/Class", 2: "x/A", 3: "x/B", 4: "next", 5: "count", 6: "other", 7: "[Lx/A;", 8: "shared"}
    out = b"JAVA PROFILE 1.0.2\0" + u4(8) + struct.pack(">Q", 1700000000000)
    for i, t in texts.items():
        out += record(0x01, ident(i) + t.encode())
    for cls, name in ((100, 1), (101, 2), (102, 3), (103, 7)):
        out += record(0x02, u4(1) + ident(cls) + u4(0) + ident(name))

    def cls(at, above, size, fields, statics=()):
        body = b"\x20" + ident(at) + u4(0) + ident(above) + ident(0) * 3 + ident(0) * 2 + u4(size) + struct.pack(">H", 0) + struct.pack(">H", len(statics))
        body += b"".join(ident(n) + b"\x02" + ident(v) for n, v in statics)
        return body + struct.pack(">H", len(fields)) + b"".join(ident(n) + bytes([t]) for n, t in fields)

    first = b"\x21" + ident(1000) + u4(0) + ident(102) + u4(20) + ident(1001) + ident(1002) + u4(7)  # before its class
    first += b"\x01" + ident(1000) + ident(9)
    second = cls(100, 0, 0, []) + cls(101, 0, 12, [(4, 2), (5, 10)], [(8, 1001)]) + cls(102, 101, 20, [(6, 2)])
    second += b"\x21" + ident(1001) + u4(0) + ident(101) + u4(12) + ident(0) + u4(3)
    second += b"\x22" + ident(1002) + u4(0) + u4(2) + ident(103) + ident(1001) + ident(0)
    second += b"\x23" + ident(1003) + u4(0) + u4(5) + b"\x08" + b"hello"
    return out + record(0x0C, first) + record(0x1C, second) + record(0x2C, b"")


def test_heap_dump(spark, tmp_path):
    from heliograph.sources import hprof

    (tmp_path / "a.hprof").write_bytes(dump())
    t = hprof.read(spark, f"file://{tmp_path}/a.hprof")
    objects = {r.obj_id: (r.class_name, r.shallow) for r in t["objects"].collect()}
    assert {k: objects[k] for k in (1000, 1001, 1002, 1003)} == {1000: ("x.B", 32), 1001: ("x.A", 24), 1002: ("x.A[]", 32), 1003: ("byte[]", 24)}
    assert objects[101] == ("java.lang.Class", 96)
    refs = {(r.from_id, r.to_id, r.field) for r in t["refs"].collect()}
    assert refs == {(1000, 1001, "other"), (1000, 1002, "next"), (1002, 1001, "[0]"), (101, 1001, "shared"), (102, 101, "<superclass>")}
    assert [tuple(r) for r in t["roots"].collect()] == [(1000, "JNI_GLOBAL")]
    names = {(r.name, r.type) for r in t["class_fields"].collect()}
    assert names == {("next", 2), ("count", 10), ("other", 2)}


def test_shares_of_a_heap_of_gigabytes(spark):
    """The rule of shares says nothing of the heap's size, the rules together do."""
    rows = heap.histogram(spark.createDataFrame([(1, "x.A", 3 << 30), (2, "x.B", 1 << 20)], "obj_id long, class_name string, shallow long"))
    assert [(r.rule, r.class_name) for r in advisor.heap_shares(rows).collect()] == [("R07_share", "x.A")]
    assert sorted(r.rule for r in advisor.advise_heap(rows).collect()) == ["R07_heap", "R07_share"]


def test_class_sums_walk_over_chains_of_a_class_alone(spark, monkeypatch):
    """Objects below another class are summed in one grouped job; only those below their own class are followed, by doubling."""
    from heliograph.operators import trees

    written = []
    for module in (heap, trees):
        monkeypatch.setattr(module, "stored", lambda df, name, keep=module.stored: (written.append(name), keep(df, name))[1])
    kind = ["A", "B", "B", "B", "B", "C", "B", None, None, "A", "A"]
    up = [-1, 0, 1, 2, 3, 4, 5, 0, 7, -1, 9]
    rows = [(i, k, 10 + i, u, True, 100 + i) for i, (k, u) in enumerate(zip(kind, up))] + [(11, "A", 7, None, False, 7)]
    sizes = spark.createDataFrame(rows, "obj_id long, class_name string, shallow long, idom long, reachable boolean, retained long")
    want_outer, want_in = {}, {}
    for i, (k, u) in enumerate(zip(kind, up)):
        if k != (kind[u] if u >= 0 else None):
            want_outer[k] = want_outer.get(k, 0) + 100 + i
        while u >= 0 and kind[u] == k:
            u = up[u]
        if u >= 0:
            want_in[kind[u]] = want_in.get(kind[u], 0) + 10 + i
    found = heap.class_retained(sizes).collect()
    assert {r.class_name: r.retained for r in found if r.retained is not None} == want_outer
    assert {r.class_name: r.attributed for r in found if r.attributed is not None} == want_in
    assert set(written) == {"by_class", "chains", "heads"} and written.count("heads") <= 4
    written.clear()
    heap.class_retained(sizes.where("obj_id in (0, 1, 5)")).collect()
    assert written == ["by_class"]


def test_a_heap_deals_its_references_once(spark, monkeypatch):
    """Sizes and what arrays share walk over references kept by referrer; neither these nor the sizes without collections are written."""
    from heliograph.plans import modes

    written = []
    monkeypatch.setattr(modes, "stored", lambda df, name, keep=modes.stored: (written.append(name), keep(df, name))[1])
    objects = spark.createDataFrame([(0, "java.util.ArrayList", 16), (1, "java.lang.Object[]", 16), (2, "x.Item", 8), (3, "x.Holder", 8)], "obj_id long, class_name string, shallow long")
    refs = spark.createDataFrame([(0, 1, "data"), (1, 2, "[0]"), (3, 2, "item"), (3, 2, "again")], "from_id long, to_id long, field string")
    roots = spark.createDataFrame([(0, "JNI"), (3, "JNI")], "obj_id long, root_type string")
    found = modes.java_heap({"objects": objects, "refs": refs, "roots": roots}, modes.preset(), 0, 0, False)
    assert {r.obj_id: (r.retained, r.idea) for r in found["sizes"].collect()} == {0: (32, 32), 1: (16, 16), 2: (8, 8), 3: (8, 16)}
    assert written.count("sizes") == 1 and "refs" not in written
