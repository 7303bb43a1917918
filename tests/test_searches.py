"""Searches over heap graphs against brute force: many targets as bits, ranks of hot groups, ways with fields."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heliograph.functions import frames as fn
from heliograph.operators import bits, heap, paths, ranks, retainers, walks
from heliograph.plans import modes

OBJECTS, REFS = "obj_id long, class_name string, shallow long", "from_id long, to_id long, field string"


def graph(n, seed, classes=6, most=3):
    draw = random.Random(seed)
    objects = [(i, f"x.C{draw.randrange(classes)}" if draw.random() < 0.9 else None, draw.randint(1, 50) * 8) for i in range(n)]
    refs = [(draw.randrange(n), draw.randrange(n), draw.choice(["a", "b", "[0]", "c"])) for _ in range(most * n)]
    return objects, refs


def backward(objects, refs, targets, depth, stop=lambda c: False):
    """(target, class, field, depth) of nodes met breadth-first against references, each once a target."""
    kind, into = {o[0]: o[1] for o in objects}, defaultdict(dict)
    for a, b, f in refs:
        into[b][a] = min(f, into[b].get(a, f))
    found = set()
    for t in targets:
        seen, front = {t}, {t}
        for d in range(1, depth + 1):
            step = {}
            for node in front:
                for a, f in into[node].items():
                    if a not in seen:
                        step[a] = min(f, step.get(a, f))
            found |= {(t, kind[a], f, d) for a, f in step.items()}
            seen |= set(step)
            front = {a for a in step if not stop(kind[a])}
    return found


@pytest.mark.parametrize("stop", [False, True])
def test_retainers_of_more_targets_than_a_block_has(spark, stop):
    objects, refs = graph(1500, 5)
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    assert 1500 > bits.BITS
    halt = F.coalesce(F.col("class_name") == "x.C1", F.lit(False)) if stop else None
    got = {(x.retainer_class, x.field, x.depth): (x["count"], x["size"]) for x in heap.retainers_by_depth(r, o, o, 3, halt).collect()}
    size, want = {x[0]: x[2] for x in objects}, defaultdict(lambda: [0, 0])
    for t, c, f, d in backward(objects, refs, range(1500), 3, (lambda c: c == "x.C1") if stop else lambda c: False):
        want[c, f, d][0] += 1
        want[c, f, d][1] += size[t]
    assert got == {k: tuple(v) for k, v in want.items()}
    assert heap.retainers_by_depth(r.where("false"), o, o, 3).count() == 0


def test_rows_of_a_level_are_nodes(spark):
    """A hub that 900 targets reach is one row, not 900."""
    o = spark.createDataFrame([(i, "x.T", 8) for i in range(900)] + [(1000, "x.Hub", 8), (1001, "x.App", 8)], OBJECTS)
    r = spark.createDataFrame([(1000, i, f"[{i}]") for i in range(900)] + [(1001, 1000, "hub")], REFS)
    links = r.join(o.select(F.col("obj_id").alias("from_id"), "class_name"), "from_id")
    numbers = bits.numbered(o.where("class_name = 'x.T'").select("obj_id"))
    rows = bits.search(links, numbers, 5)
    assert rows.where("depth = 2").count() == 1 and bits.targets_of(rows.where("depth = 2"), "class_name").count() == 900
    few = retainers.business(r, o, o.where("class_name = 'x.T'"), o.where("obj_id = 1001").select("obj_id")).collect()
    assert {(x.class_name, x.depth, x["count"], x.is_root) for x in few} == {("x.Hub", 1, 900, False), ("x.App", 2, 900, True)}


def test_blocks_of_one_word_where_few_targets_meet(spark, monkeypatch):
    """Targets with referrers of their own have rows of one word, and the same results as with any number of words."""
    n = bits.BITS * 2
    objects = [(i, "x.T", 8) for i in range(n)] + [(n + i, f"x.R{i % 3}", 8) for i in range(2 * n)]
    refs = [(n + i, i % n, "b" if i % 5 else "a") for i in range(2 * n)] + [(n + i, n + (i * 7) % (2 * n), "c") for i in range(2 * n)]
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    links = r.join(o.select(F.col("obj_id").alias("from_id"), "class_name"), "from_id")
    numbers = bits.numbered(o.where("class_name = 'x.T'").select("obj_id"))
    rows = bits.search(links, numbers, 2)
    assert bits.words_for(links, numbers) == 1 and [c for c in rows.columns if c in bits.NAMES] == ["w0"]
    targets = o.where(f"obj_id < {n}")
    found = lambda: sorted(map(tuple, heap.retainers_by_depth(r, o, targets, 2).collect()))
    few = found()
    monkeypatch.setattr(bits, "words_for", lambda *_: bits.WORDS)
    assert few == found() and len(few) > 3


def test_business_search_ends_when_enough_are_found(spark):
    chain = [(i, f"x.C{i}", 8) for i in range(12)]
    o, r = spark.createDataFrame(chain, OBJECTS), spark.createDataFrame([(i + 1, i, "f") for i in range(11)], REFS)
    found = retainers.business(r, o, o.where("obj_id = 0"), o.where("false").select("obj_id"), enough=4, n=None)
    assert sorted(x.class_name for x in found.collect()) == ["x.C1", "x.C2", "x.C3", "x.C4"]


def test_ranks_of_a_hot_group(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["hot"] * 8 + ["b", None]), draw.randint(0, 5), i) for i in range(4000)]
    found = ranks.ranked(spark.createDataFrame(rows, "g string, size int, id int").repartition(5), ["g"], [F.desc("size"), F.asc("id")])
    got = {r.id: (r.pos, r.n) for r in found.collect()}
    for g in ("hot", "b", None):
        own = sorted((-s, i) for x, s, i in rows if x == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    plan = heap.stratified_sample(spark.createDataFrame([(1, "x", 8)], OBJECTS), 5)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def ways(refs, roots, k):
    """Shortest ways to each node, [(id, field), ...] root first, ordered by referrers from the node back."""
    onward, level = defaultdict(dict), {r: 0 for r in roots}
    for a, b, f in refs:
        onward[a][b] = min(f, onward[a].get(b, f))
    found = {r: [[(r, None)]] for r in roots}
    front = set(roots)
    while front:
        step = defaultdict(list)
        for a in front:
            for b, f in onward[a].items():
                if b not in level:
                    step[b] += [[*w, (b, f)] for w in found[a]]
        for b, w in step.items():
            found[b] = sorted(w, key=lambda x: [i for i, _ in x][::-1])[:k]
        level |= {b: 1 for b in step}
        front = set(step)
    return found


def test_ways_with_fields(spark):
    objects, refs = graph(300, 3, most=2)
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    roots = [0, 7, 9]
    want = ways(refs, roots, 3)
    made = paths.shortest_ways(r, spark.createDataFrame([(x, "JNI") for x in [*roots, 0]], "obj_id long, root_type string"))
    got = defaultdict(dict)
    kind = {x[0]: x[1] for x in objects}
    for x in paths.root_paths(made, o, o).collect():
        assert x.length == len(x.path) and all(s.class_name == kind[s.obj_id] for s in x.path)
        got[x.target][x["rank"]] = [(s.obj_id, s.field) for s in x.path]
    assert {t: [w[k] for k in sorted(w)] for t, w in got.items()} == want
    assert paths.root_paths(made, o, o.where("false")).count() == 0


def test_paths_of_all_objects_are_built_once(spark, monkeypatch):
    """From the roots down a way is joined once, however long; the paths are those from targets up. Targets without a row in objects, too."""
    objects, refs = graph(120, 4, most=2)
    refs += [(i, i + 1, "next") for i in range(200, 220)] + [(0, 200, "first")]
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    made = paths.shortest_ways(r, spark.createDataFrame([(0, "JNI"), (9, "JNI")], "obj_id long, root_type string"))
    targets = o.select("obj_id").unionByName(spark.createDataFrame([(220,)], "obj_id long"))
    wanted = lambda: sorted(map(str, paths.root_paths(made, o, targets).collect()))
    monkeypatch.setattr(paths, "MANY", 0)
    up = wanted()
    monkeypatch.setattr(paths, "MANY", 4)
    written = []
    monkeypatch.setattr(paths, "stored", lambda df, name, keep=paths.stored: (written.append(name), keep(df, name))[1])
    assert wanted() == up and len(up) > 100 and written.count("steps") == 1


def test_ways_of_few_targets_leave_others_alone(spark):
    objects, refs = graph(300, 5, most=2)
    r = spark.createDataFrame([*refs, *((10_000 + i, 20_000 + i, "far") for i in range(50))], REFS)
    roots, targets = spark.createDataFrame([(x, "JNI") for x in (0, 7, 9, 10_003)], "obj_id long, root_type string"), spark.createDataFrame([(40,), (41,), (299,)], "obj_id long")
    assert paths.leading_to(r, targets).where("field = 'far'").count() == 0
    few = lambda ways: sorted(map(str, paths.root_paths(ways, spark.createDataFrame(objects, OBJECTS), targets).collect()))
    made = few(paths.ways_to(r, roots, targets))
    assert made and made == few(paths.shortest_ways(r, roots))


def test_described_objects(spark):
    o = spark.createDataFrame([(0, "x.Root", 8), (1, "x.Big", 800), (2, "x.A", 16), (3, "x.B", 24)], OBJECTS)
    r = spark.createDataFrame([(0, 1, "big"), (1, 2, "a"), (1, 3, "b"), (1, 3, "b"), (3, 1, "back")], REFS)
    roots = spark.createDataFrame([(0, "JNI")], "obj_id long, root_type string")
    found = modes.java_heap({"objects": o, "refs": r, "roots": roots}, modes.preset(), retainers_of=0, graphs_of=2)
    row = found["biggest_details"].where("obj_id = 1").head()
    assert [(f.name, f.to_id, f.class_name, f.retained) for f in row.fields] == [("b", 3, "x.B", 24), ("a", 2, "x.A", 16)]
    assert [(s.obj_id, s.class_name, s.field) for s in row.path] == [(0, "x.Root", None), (1, "x.Big", "big")]
    assert found["biggest_details"].where("obj_id = 2").head().fields == []
    assert {x.of_class for x in found["graph_nodes"].collect()} == {"x.Big", "x.B"} and found["graph_edges"].where("of_class = 'x.Big'").count() == 3


def test_truncated_bytes(spark):
    texts = ["short", "exactly12byt", "thirteenbytes", "ééééééé", "漢字漢字漢字", "a😀😀😀😀", "aé漢😀é漢😀", "", None]

    def cut(t, n):
        raw = (t or "").encode()
        return t if t is None or len(raw) <= n else raw[: max(0, n - 3)].decode("utf-8", "ignore") + "..."

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (12, 8, 5, 3, 2):
        assert [r.x for r in rows.select(fn.truncated("t", n).alias("x")).collect()] == [cut(t, n) for t in texts]


def linked(links, hidden):
    """Visible pairs joined only through hidden nodes, without those that a link joins."""
    onward = defaultdict(set)
    for a, b in links:
        onward[a].add(b)
    found = set()
    for s in {a for a, _ in links} - hidden:
        seen, front = set(), [b for b in onward[s] if b in hidden]
        while front:
            h = front.pop()
            if h in seen:
                continue
            seen.add(h)
            for b in onward[h]:
                if b in hidden:
                    front.append(b)
                elif b != s:
                    found.add((s, b))
    return found - set(links)


def test_bridges(spark, monkeypatch):
    from heliograph.operators import callgraph
    from heliograph.plans import storage

    rounds, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    chain = [(f"h{i:04d}", f"h{i + 1:04d}") for i in range(1000)]
    circle = [("v", "c0"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c3", "c3"), ("v", "c3")]
    draw = random.Random(11)
    mesh = [(f"m{draw.randrange(30)}", f"m{draw.randrange(30)}") for _ in range(60)]
    links = [*chain, *circle, *mesh]
    hidden = {f"h{i:04d}" for i in range(1, 1000)} | {"c0", "c1", "c2", "c3"} | {f"m{i}" for i in range(20)}
    frames = spark.createDataFrame(links, "source string, target string"), spark.createDataFrame([(h,) for h in hidden], "node_id string")
    got = {tuple(r) for r in callgraph.bridges(*frames).collect()}
    assert got == linked(links, hidden) and ("h0000", "h1000") in got
    assert rounds.count("ways") + rounds.count("steps") <= 20
    assert callgraph.bridges(frames[0], frames[1].where("false")).count() == 0


def test_lookups_read_few_buckets(spark, tmp_path):
    from heliograph.plans import views
    from heliograph.sources import graphs

    o = spark.createDataFrame([(i, f"x.C{i % 3}", 8 + i) for i in range(500)], OBJECTS)
    refs = [(i, 7, "hub") for i in range(400)] + [(7, i, "item") for i in range(60)]
    r = spark.createDataFrame(refs, REFS)
    graphs.save_lookups({"objects": o, "refs": r, "roots": spark.createDataFrame([(7, "JNI")], "obj_id long, root_type string"), "sizes": o.withColumn("retained", F.col("shallow") * 2)}, f"file://{tmp_path}", 8)
    kept = graphs.Lookups(spark, f"file://{tmp_path}")
    assert kept.buckets == 8 and kept.of("refs_to", 7).count() == 401 and kept.of("refs_from", 9999).count() == 0
    plan = kept.of("refs_to", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(to_id), EqualTo(to_id,7)]" in plan
    ask = views.kept_views(kept)
    assert [(x.from_id, x.class_name, x.shallow) for x in ask["retainers"](7, 3).orderBy("from_id").collect()] == [(0, "x.C0", 8), (1, "x.C1", 9), (2, "x.C2", 10)]
    assert [(x.to_id, x.retained) for x in ask["gc-root-retained"](7, 5).collect()] == [(i, 2 * (8 + i)) for i in (7, 3, 2, 1, 0)]
    row = ask["info"](7).head()
    assert (row.obj_id, row.class_name, row.shallow, row.retained, row.root_type) == (7, "x.C1", 15, 30, "JNI")
    assert "dynamicpruning" in ask["retainers"](7, 3)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="0 sets"):
        graphs.Lookups(spark, f"file://{tmp_path}/lookups-8")


def test_a_search_deals_its_references_once(spark, monkeypatch):
    """References are kept by what they lead to for all levels, and let go when what was found is stored."""
    kept, written = [], []
    monkeypatch.setattr(heap, "kept", lambda df, key, keep=heap.kept: (kept.append((key, keep(df, key))), kept[-1][1])[1])
    monkeypatch.setattr(heap, "stored", lambda df, name, keep=heap.stored: (written.append(name), keep(df, name))[1])
    objects, refs = graph(60, 3)
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    assert heap.retainers_by_depth(r, o, o, 3).count() > 0
    assert [k for k, _ in kept] == ["to_id"] and not kept[0][1].is_cached and not written


def test_direct_retainers_are_summed_before_their_classes_meet(spark):
    """Parts of the joins have the number that Spark shuffles to, not fewer and larger ones; counts and sizes are of all references."""
    objects, refs = graph(300, 9)
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs + [(7, 10**6, "a"), (10**6, 7, "a")], REFS)
    kind, size, want = {x[0]: x[1] for x in objects}, {x[0]: x[2] for x in objects}, defaultdict(lambda: [0, 0])
    for a, b, f in refs:
        if kind[b] is not None:
            want[kind[b], kind[a], f][0] += 1
            want[kind[b], kind[a], f][1] += size[b]
    rows = heap.retainers(r, o)
    got = {(x.target_class, x.retainer_class, x.field): [x["count"], x["size"]] for x in rows.collect()}
    assert got == want
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()


def layers(draw, wide):
    """A graph by layers, but that C1 refers to C4 directly too, and twice to C2; some of C5 refer to each other at random."""
    sizes = [3, 8, wide, 2 * wide, 30]
    ids, first = [], 0
    for n in sizes:
        ids.append(list(range(first, first + n)))
        first += n
    objects = [(i, f"x.C{k}", draw.randint(1, 9) * 8) for k, some in enumerate(ids) for i in some]
    refs = [(draw.choice(ids[k]), i, "down") for k in range(4) for i in ids[k + 1] for _ in range(2)]
    refs += [(draw.choice(ids[1]), i, draw.choice(["over", "a"])) for i in ids[4]] + [(draw.choice(ids[1]), i, "b") for i in ids[2]]
    return objects, refs


@pytest.mark.parametrize("circles", [False, True])
def test_labels_of_all_objects_are_those_of_a_search(spark, monkeypatch, circles):
    """Nearly all objects as targets: labels pass over references once, doubtful objects have bits; no search from targets."""
    objects, refs = layers(random.Random(7), 150)
    if circles:
        refs += [(a, b, f) for a, b, f in graph(8, 4)[1] if 3 <= a < 11] + [(3, 4, "next"), (4, 3, "next"), (5, 5, "next")]
        monkeypatch.setattr(walks, "DOUBTS", 0)
    o, r = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(refs, REFS)
    size, kind = {x[0]: x[2] for x in objects}, {x[0]: x[1] for x in objects}
    by_class, business = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t, c, f, d in backward(objects, refs, kind, 4):
        by_class[kind[t], c, f, d][0] += 1
        by_class[kind[t], c, f, d][1] += size[t]
        business[kind[t], c].add(t)
    whole = defaultdict(lambda: [0, 0])
    for (_, *k), (n, s) in by_class.items():
        whole[tuple(k)][0] += n
        whole[tuple(k)][1] += s
    roots, wanted = o.where("obj_id < 2").select("obj_id"), o.select("class_name").distinct()
    asked = lambda: (sorted(map(tuple, retainers.business(r, o, wanted, roots, n=None, max_depth=4, samples=10**6, enough=3).collect())))
    monkeypatch.setattr(walks, "SHARE", 0)
    searched = asked()
    monkeypatch.setattr(walks, "SHARE", 4)
    monkeypatch.setattr(bits, "search", None)
    assert {(x.retainer_class, x.field, x.depth): [x["count"], x["size"]] for x in heap.retainers_by_depth(r, o, o, 4).collect()} == whole
    found = retainers.by_depth(r, o, wanted, None, 4, 10**6).collect()
    assert {(x.target_class, x.retainer_class, x.field, x.depth): [x["count"], x["size"]] for x in found} == by_class
    assert asked() == searched and len(searched) > 8
