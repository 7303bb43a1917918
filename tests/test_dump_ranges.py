"""The index of one dump by many tasks is that of one pass over it, whatever its objects' bytes look like."""

import random

import pytest

from heliograph.plans import standins
from heliograph.sources import hprof


def record(tag, body):
    return bytes([tag]) + bytes(4) + len(body).to_bytes(4, "big") + body


def dump(seed, misleading=True):
    """Strings, classes, segments of many sizes; bytes of some segments look like runs of records."""
    draw = random.Random(seed)
    out = b"JAVA PROFILE 1.0.2\0" + (8).to_bytes(4, "big") + (1_700_000_000_000).to_bytes(8, "big")
    fake = b"".join(record(0x01, (7).to_bytes(8, "big") + b"false") for _ in range(40))
    for i in range(200):
        kind = draw.randrange(10)
        if kind < 5:
            out += record(0x01, i.to_bytes(8, "big") + f"name{i}".encode())
        elif kind == 5:
            out += record(0x02, (1).to_bytes(4, "big") + i.to_bytes(8, "big") + bytes(4) + (1).to_bytes(8, "big"))
        elif kind == 6:
            out += record(0x05, draw.randbytes(20))
        else:
            raw = (fake if misleading and kind == 7 else b"") + draw.randbytes(draw.choice([0, 10, 3000]))
            out += record(0x1C, b"\x23" + i.to_bytes(8, "big") + bytes(4) + len(raw).to_bytes(4, "big") + b"\x08" + raw)
    return out + record(0x07, (123).to_bytes(4, "big") + (45).to_bytes(4, "big") + bytes(16)) + record(0x2C, b"")


def rows(frame):
    return sorted(repr(tuple(r)) for r in frame.select(*[x.split()[0] for x in hprof.INDEX.split(", ")]).collect())


@pytest.mark.parametrize("step", [11, 500, 4096])
def test_ranges_of_misleading_dumps(spark, tmp_path, step):
    for seed in (1, 2):
        (tmp_path / f"{seed}.hprof").write_bytes(dump(seed) if step > 11 else dump(seed)[:4000])
    path = f"file://{tmp_path}"
    whole = rows(hprof.index(spark, path, 1 << 30))
    assert len({r.split(",")[0] for r in whole}) == 2 and any("'segment'" in r for r in whole)
    assert rows(hprof.index(spark, path, step)) == whole


def test_a_dump_that_ends_within_a_record(spark, tmp_path):
    raw = dump(3, misleading=False)
    (tmp_path / "a.hprof").write_bytes(raw + b"\x01\0\0")
    found = hprof.index(spark, f"file://{tmp_path}/a.hprof", 700)
    assert found.where("kind = 'summary'").count() == 1


def test_ranges_that_were_misled_are_read_again():
    heads = {"a": 31}
    bounds = [("a", 0, 100, 31, 140), ("a", 100, 200, 120, 210), ("a", 200, 300, 210, 300)]
    assert hprof.misread(bounds, heads) == ([("a", 0)], [("a", 100, 140)])
    bounds[1] = ("a", 100, 200, 140, 350)  # read again: its last record covers the next range
    assert hprof.misread(bounds, heads) == ([("a", 0), ("a", 100)], [])
    assert hprof.misread([("a", 0, 100, 31, 140), ("a", 100, 200, None, None)], heads) == ([("a", 0)], [("a", 100, 140)])


def test_inherited_fields(spark, tmp_path):
    """A supplier's name and nation are fields of two superclasses; own fields come first in an instance's bytes."""
    nations = [{"n_nationkey": 3, "n_regionkey": 1, "suppliers": [{"s_suppkey": 7, "s_name": "seven"}]}]
    (tmp_path / "shop.hprof").write_bytes(b"".join(standins.dump_bytes(nations)))
    t = hprof.read(spark, f"file://{tmp_path}/shop.hprof")
    at = standins.DUMP_IDS
    got = {(r.field, r.to_id) for r in t["refs"].where(f"from_id = {at['supplier'] + 7}").collect()}
    assert got == {("nation", at["nation"] + 3), ("name", at["name"] + 7)}


def test_profiles_of_one_name_in_several_folders(spark, tmp_path):
    from heliograph.sources import pprof

    for folder, n in (("host1", 1), ("host2", 2), ("host2/old", 3)):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "cpu_1.pprof").write_bytes(pprof.encode([("samples", "count")], [(["main"], [n])]))
    (tmp_path / "host2" / "heap_7.pb.gz").write_bytes(pprof.encode([("inuse_space", "bytes")], [(["main"], [9])]))
    found = {r.profile_id: r["values"] for r in pprof.read(spark, str(tmp_path)).collect()}
    assert found == {"host1/cpu_1": [1], "host2/cpu_1": [2], "host2/old/cpu_1": [3], "heap_7": [9]}
    assert {r.profile_id for r in pprof.read(spark, f"file://{tmp_path}/host1").collect()} == {"cpu_1"}


def test_stand_ins_are_made_anew_for_other_files(spark, tmp_path):
    made = []
    ask = lambda: standins.once(spark, f"file://{tmp_path}", "x", lambda: made.append(1) or len(made))
    assert (ask(), ask()) == (1, 1)
    (tmp_path / "orders.parquet").write_bytes(b"new")
    assert (ask(), ask()) == (2, 2)
