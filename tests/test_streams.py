"""Streams with state and offsets, saved batches, rules read anew: each across a restart or a failure."""

import json
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from heliograph.operators import advisor
from heliograph.plans import saved
from heliograph.streaming import masters, polled, tasks

ROW = "tid string, text string"


def test_saved_batches(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    assert saved.load(spark, root, "results", ROW).count() == 0
    assert saved.save({"results": rows(("a", "1"), ("b", "1")), "status": rows(("a", "done"))}, root, 0)
    assert not saved.save({"results": rows(("a", "other"))}, root, 0)  # a repeated batch changes nothing
    commit = saved.commit

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(saved, "commit", fails)
    with pytest.raises(OSError, match="lost"):
        saved.save({"results": rows(("a", "half")), "status": rows(("a", "half"))}, root, 1)
    assert {tuple(r) for r in saved.load(spark, root, "results", ROW).collect()} == {("a", "1", 0), ("b", "1", 0)}
    monkeypatch.setattr(saved, "commit", commit)
    assert saved.save({"results": rows(("a", "2"), ("a", "3"))}, root, 1)  # what the failed one left of results is replaced
    assert {tuple(r) for r in saved.load(spark, root, "results", ROW, ("tid",)).collect()} == {("a", "2", 1), ("a", "3", 1), ("b", "1", 0)}
    assert saved.load(spark, root, "status", ROW).where("text = 'half'").count() == 1  # its batch is committed now
    assert saved.commits(spark, root).count() == 2


class Handle:
    """State of one master that counts how often it is asked or told something."""

    def __init__(self):
        self.calls, self.value, self.rows = 0, None, {}

    def getMapState(self, *_):  # noqa: N802
        def told(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return staticmethod(call)

        return type("Rows", (), {"containsKey": told(lambda k: k in self.rows), "getValue": told(self.rows.get), "updateValue": told(self.rows.__setitem__), "iterator": told(lambda: iter(list(self.rows.items())))})

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_state_of_few_sub_tasks_is_one_value():
    """A batch of a small master is two calls, and a master that grows keeps its sub-tasks."""
    handle, master = Handle(), masters.Masters()
    master.init(handle)
    batch = lambda a, b, seq: pd.DataFrame([{"tid": f"t{i}", "seq": seq, "status": 2, "analysis_status": 2, "suggestions": [{"func": "f", "suggestion": f"{i}.{seq}"}]} for i in range(a, b)])
    (row,) = master.handleInputRows(("m",), iter([batch(0, 100, 1)]), None)
    assert handle.calls == 2 and row.sub_tasks[0] == 100 and len(row.groups[0]) == 100
    (row,) = master.handleInputRows(("m",), iter([batch(50, 400, 2)]), None)
    assert row.sub_tasks[0] == 400 and bool(row.complete[0]) and len(handle.rows) == 400
    said = {g["tid"]: g["items"][0]["suggestion"] for g in row.groups[0]}
    assert said == {f"t{i}": f"{i}.{1 if i < 50 else 2}" for i in range(400)}
    (row,) = master.handleInputRows(("m",), iter([batch(0, 1, 3)]), None)
    assert row.sub_tasks[0] == 400 and len(row.groups[0]) == 400


def test_masters_over_rows_are_those_over_frames():
    """Rows make no pandas frame a master, and give what frames give, from the same state."""
    assert issubclass(masters.RowMasters, masters.Masters)
    say = lambda *x: [{"func": f, "suggestion": s} for f, s in x]
    batches = [[("a", 2, 2, 0, None), ("a", 1, 2, 2, say(("g", "look"), ("f", "see"))), ("b", 1, 3, 0, None)], [("b", 2, 2, 2, say(("f", " "))), ("a", 3, 2, 2, [])], [("a", 2, 2, 2, say(("x", "late")))]]
    keys, found = ("tid", "seq", "status", "analysis_status", "suggestions"), []
    for kind, shape in ((masters.Masters, lambda rows: pd.DataFrame(rows, columns=keys)), (masters.RowMasters, lambda rows: None)):
        master = kind()
        master.init(Handle())
        out = []
        for rows in batches:
            given = iter([shape(rows)]) if kind is masters.Masters else iter([Row(**dict(zip(keys, r, strict=True))) for r in rows])
            for x in master.handleInputRows(("m",), given, None):
                out.append(x.to_dict("records")[0] if kind is masters.Masters else x.asDict(True))
        found.append(out)
    assert found[0] == found[1] and [x["sub_tasks"] for x in found[1]] == [2, 2, 2] and found[1][2]["groups"][0]["items"] == say(("x", "late"))


def test_masters_with_state(spark, tmp_path):
    """Groups and completeness as the batch roll-up has them, over two runs of one checkpoint; repeats change nothing."""
    landing, out = tmp_path / "in", {}
    landing.mkdir()
    say = lambda *x: [{"func": f, "suggestion": s} for f, s in x]
    first = [("m1", "a", 1, 2, 0, None), ("m1", "b", 1, 2, 2, say(("g", "look"), ("f", "see"), ("h", " "))), ("m2", "c", 1, 3, 0, None), (None, "x", 1, 2, 0, None)]
    second = [("m1", "a", 2, 2, 2, say(("f", "new"))), ("m1", "b", 1, 2, 2, say(("g", "repeated"))), ("m3", "d", 5, 2, 1, None), ("m3", "d", 4, 2, 2, say(("f", "late")))]
    third = [("m1", "b", 3, 2, 2, say(("z", "again"))), ("m1", "b", 2, 3, 2, say(("z", "too late"))), ("m3", "d", 3, 2, 2, say(("f", "too late"))), ("m3", "d", 6, 2, 2, [])]

    def run(name, rows):
        keys = ("master_tid", "tid", "seq", "status", "analysis_status", "suggestions")
        (landing / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))
        stream = masters.rolled_up(spark.readStream.schema(masters.UPDATE).json(f"file://{landing}"))
        keep = lambda batch, _: out.update({r.master_tid: (r.sub_tasks, r.complete, [(g.tid, [tuple(i) for i in g["items"]]) for g in r.groups]) for r in batch.collect()})
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)

    run("1", first)
    assert out == {"m1": (2, False, [("b", [("f", "see"), ("g", "look")])]), "m2": (1, True, [])}
    out.clear()
    run("2", second)
    assert out == {"m1": (2, True, [("a", [("f", "new")]), ("b", [("f", "see"), ("g", "look")])]), "m3": (1, False, [("d", [("f", "late")])])}
    run("3", third)
    assert out["m1"] == (2, True, [("a", [("f", "new")]), ("b", [("z", "again")])]) and out["m3"] == (1, True, [("d", [("f", "late")])])


def test_polled_rows_come_once(spark, tmp_path):
    path, got = str(tmp_path / "tasks.db"), []
    db = sqlite3.connect(path)
    db.execute("create table tasks (id integer, tid text, type int, status int, analysis_status int, duration int, master_tid text, modified text)")
    put = lambda ids, when: db.executemany("insert into tasks values (?, ?, 1, 2, 0, 5, 'm', ?)", [(i, f"t{i}", when) for i in ids])
    put(range(50), "2024-01-01 00:00:00")
    db.commit()
    spark.dataSource.register(polled.PolledTasks)

    def run():
        stream = spark.readStream.format("polled").option("module", "sqlite3").option("database", path).option("per_trigger", 20).load()
        query = stream.writeStream.foreachBatch(lambda batch, _: got.extend((r.tid, r.modified) for r in batch.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert sorted(got) == sorted((f"t{i}", "2024-01-01 00:00:00") for i in range(50))
    got.clear()
    put(range(50, 90), "2024-01-02 00:00:00")
    db.execute("update tasks set modified = '2024-01-03 00:00:00' where id = 7")
    db.commit()
    run()
    assert sorted(got) == sorted([*((f"t{i}", "2024-01-02 00:00:00") for i in range(50, 90)), ("t7", "2024-01-03 00:00:00")])
    got.clear()
    run()
    assert got == []
    with pytest.raises(ValueError, match="table's name"):
        polled.Reader({"module": "sqlite3", "database": path, "table": "tasks; drop"}, [])


def test_ranges_of_polled_rows(tmp_path):
    path = str(tmp_path / "t.db")
    db = sqlite3.connect(path)
    db.execute("create table tasks (id integer, modified text)")
    db.executemany("insert into tasks values (?, ?)", [(i, f"d{i // 7}") for i in range(23)])
    db.commit()
    reader = polled.Reader({"module": "sqlite3", "database": path, "per_trigger": "10", "tasks": "3"}, ["id"])
    start, found = reader.initialOffset(), []
    reader.partitions(start, start)
    for _ in range(4):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        assert len(parts) <= 3
        found.append([x for p in parts for (x,) in reader.read(p)])
        start = end
    assert [len(x) for x in found] == [10, 10, 3, 0] and sorted(sum(found, [])) == list(range(23))


TASK = "id long, tid string, status int, analysis_status int, master_tid string"


def test_rules_are_read_anew_for_each_batch(spark, tmp_path):
    """A rule deleted between batches stops firing; a failed task has status 3; a repeated batch changes nothing."""
    landing, rules = tmp_path / "in", {"X1": None, "X2": None}
    landing.mkdir()

    def table():
        return spark.createDataFrame([(r, "lock", 10.0, d) for r, d in rules.items()], "rule string, part string, above double, deleted string")

    def analyse(ready):
        return ready.where("tid <> 'broken'").select("tid", F.explode(F.array(F.lit("a.lock"), F.lit("b"))).alias("func"), F.lit(50.0).alias("self_pct"))

    def run(name, *tids):
        (landing / f"{name}.json").write_text("\n".join(json.dumps({"id": 1, "tid": t, "status": 2, "analysis_status": 0, "master_tid": "m"}) for t in tids))
        stream = spark.readStream.schema(TASK).json(f"file://{landing}")
        tasks.analysed(stream, analyse, table, f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)

    run("1", "t1", "broken")
    rules["X2"] = "2024-01-01"
    run("2", "t2", "t2")
    store = lambda name: tasks.of_store(spark, f"file://{tmp_path}/store", name)
    assert {(r.tid, r.master_tid, r.rule, r.func) for r in store("suggestions").collect()} == {("t1", "m", "X1", "a.lock"), ("t1", "m", "X2", "a.lock"), ("t2", "m", "X1", "a.lock")}
    assert {(r.tid, r.analysis_status) for r in store("status").collect()} == {("t1", 2), ("broken", 3), ("t2", 2)}
    assert store("results").count() == 4


def test_many_rules_are_dealt(spark, monkeypatch):
    functions = spark.createDataFrame([("p", f"f{i}.x", float(i)) for i in range(40)], "profile_id string, func string, self_pct double")
    rules = spark.createDataFrame([(f"r{i}", f"f{i}", float(i % 7), None) for i in range(30)], "rule string, part string, above double, deleted string")
    few = sorted(map(tuple, advisor.by_rule_table(functions, rules).collect()))
    monkeypatch.setattr(advisor, "MOST_RULES", 4)
    assert few and sorted(map(tuple, advisor.by_rule_table(functions, rules).collect())) == few
