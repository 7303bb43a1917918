"""Sampled-profile protobufs (profile.proto, gzip or raw) as tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "struct<func:string,file:string,line:int>"
SCHEMA = f"path string, modified timestamp, duration_nanos long, sample_types array<struct<type:string,unit:string>>, values array<long>, locations array<struct<address:long,lines:array<{LINE}>>>"
#: Kinds of profile by the first part of a file's name or folder that names one.
KINDS = ("cpu", "heap", "goroutine", "block", "mutex", "alloc")
#: Other names of sample types.
ALIASES = {
    "cpu": ["cpu", "nanoseconds", "samples"], "samples": ["samples", "count"], "inuse_space": ["inuse_space", "inuse_bytes"], "inuse_objects": ["inuse_objects", "inuse_count"],
    "alloc_space": ["alloc_space", "alloc_bytes"], "alloc_objects": ["alloc_objects", "alloc_count"], "goroutine": ["goroutine", "count"], "contentions": ["contentions", "count"], "delay": ["delay", "nanoseconds"],
}


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: integers as unsigned, everything else as bytes."""
    at, end = 0, len(raw)
    while at < end:
        key, at = varint(raw, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 1:
            value, at = struct.unpack_from("<Q", raw, at)[0], at + 8
        elif kind == 2:
            size, at = varint(raw, at)
            if at + size > end:
                raise ValueError("a field reaches beyond its message")
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<I", raw, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def numbers(value: int | bytes) -> list[int]:
    """A repeated integer field, packed or single."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = varint(value, at)
        out.append(x)
    return out


def decode(raw: bytes) -> Iterator[tuple[list, list, list, int]]:
    """sample types, values, locations (leaf first) and duration of each sample of a profile."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    types, samples, locations, functions, strings, duration = [], [], {}, {}, [], 0
    for number, value in fields(raw):
        if number == 1:
            types.append(dict(fields(value)))
        elif number == 2:
            samples.append(value)
        elif number == 4:
            at, address, lines = 0, 0, []
            for n, v in fields(value):
                if n == 1:
                    at = v
                elif n == 3:
                    address = v
                elif n == 4:
                    line = dict(fields(v))
                    lines.append((line.get(1, 0), signed(line.get(2, 0))))
            locations[at] = (address, lines)
        elif number == 5:
            function = dict(fields(value))
            functions[function.get(1, 0)] = (function.get(2, 0), function.get(4, 0))
        elif number == 6:
            strings.append(value.decode("utf-8", "replace"))
        elif number == 10:
            duration = signed(value)
    text = lambda i: strings[i] if i < len(strings) else ""
    kinds = [{"type": text(t.get(1, 0)), "unit": text(t.get(2, 0))} for t in types]
    places = {}
    for at, (address, lines) in locations.items():
        named = [(functions.get(f, (0, 0)), n) for f, n in lines]
        places[at] = {"address": signed(address), "lines": [{"func": text(f[0]), "file": text(f[1]), "line": n & 0x7FFFFFFF} for f, n in named]}
    for raw_sample in samples:
        ids, values = [], []
        for number, value in fields(raw_sample):
            if number == 1:
                ids += numbers(value)
            elif number == 2:
                values += [signed(x) for x in numbers(value)]
        yield kinds, values, [places.get(i, {"address": 0, "lines": []}) for i in ids], duration


def _message(*parts: tuple[int, int | bytes]) -> bytes:
    out = bytearray()
    for number, value in parts:
        out += _number(number << 3 | (0 if isinstance(value, int) else 2))
        out += _number(value) if isinstance(value, int) else _number(len(value)) + value
    return bytes(out)


def _number(x: int) -> bytes:
    out, x = bytearray(), x & (1 << 64) - 1
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def encode(types: list[tuple[str, str]], samples: list[tuple[list[str], list[int]]], duration: int = 0) -> bytes:
    """A gzip profile of (stack from the root, values) samples; frames are functions without files."""
    strings = {"": 0}
    text = lambda s: strings.setdefault(s, len(strings))
    kinds = [_message((1, text(t)), (2, text(u))) for t, u in types]
    at: dict[str, int] = {}
    rows = [_message((1, b"".join(_number(at.setdefault(f, len(at) + 1)) for f in reversed(stack))), (2, b"".join(map(_number, values)))) for stack, values in samples]
    places = [_message((1, i), (4, _message((1, i)))) for i in at.values()]
    functions = [_message((1, i), (2, text(f)), (3, text(f))) for f, i in at.items()]
    parts = [(n, x) for n, some in ((1, kinds), (2, rows), (4, places), (5, functions), (6, [s.encode() for s in strings])) for x in some]
    return gzip.compress(_message(*parts, (10, duration)), compresslevel=1, mtime=0)


def write(samples: DataFrame, path: str) -> DataFrame:
    """Write (folder, profile_id, sample_types, stack, values) as a file a profile under path/folder; folder, profile_id, samples.

    Equal stacks should be one row. The result has to be read for the files to be there.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.fs as pafs

        folder, name = (k.as_py() for k in key)
        rows = table.select(["sample_types", "stack", "values"]).to_pylist()
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{base}/{folder}", recursive=True)
        with fs.open_output_stream(f"{base}/{folder}/{name}.pprof", compression=None) as out:
            out.write(encode([(t["type"], t["unit"]) for t in rows[0]["sample_types"]], [(r["stack"], r["values"]) for r in sorted(rows, key=lambda r: r["stack"])]))
        return pa.table([[folder], [name], pa.array([len(rows)], pa.int64())], ["folder", "profile_id", "samples"])

    return samples.select("folder", "profile_id", "sample_types", "stack", "values").groupBy("folder", "profile_id").applyInArrow(run, "folder string, profile_id string, samples long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """pprof_samples of all `.pprof` and `.pb.gz` files below path: profile_id, profile_type, captured_at and SCHEMA's columns.

    A profile is decoded by one task, a file of some megabytes at most by nature; its samples are rows. profile_id is
    the file's name; of files in several folders that share one it is the way from the folder read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pprof,pb.gz}").load(path).select("path", F.col("modificationTime").alias("modified"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [{"path": row["path"], "modified": row["modified"], "duration_nanos": d, "sample_types": t, "values": v, "locations": x} for t, v, x, d in decode(row["content"])]
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=_arrow(batch.schema.field("modified").type))

    rows = files.mapInArrow(run, SCHEMA).join(profile_ids(files.select("path"), root_of(spark, path)), "path")
    return rows.select("profile_id", profile_kind("path").alias("profile_type"), captured_at("path", F.col("modified")).alias("captured_at"), *(c for c in rows.columns if c != "profile_id"))


def _arrow(time: pa.DataType) -> pa.Schema:
    line = pa.struct([("func", pa.string()), ("file", pa.string()), ("line", pa.int32())])
    return pa.schema(
        [("path", pa.string()), ("modified", time), ("duration_nanos", pa.int64()), ("sample_types", pa.list_(pa.struct([("type", pa.string()), ("unit", pa.string())]))), ("values", pa.list_(pa.int64())), ("locations", pa.list_(pa.struct([("address", pa.int64()), ("lines", pa.list_(line))])))]
    )


def file_id(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1), r"\.(pprof|pb\.gz)$", "")


def root_of(spark: SparkSession, path: str) -> str:
    """The folder that is read as its files' paths begin with it; empty for a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return "" if any(c in path for c in "*?[{") else at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"


def profile_ids(paths: DataFrame, root: str) -> DataFrame:
    """path, profile_id: the file's name without its kind's ending, with its folders where the name comes in several."""
    name = file_id("path")
    below = F.regexp_replace(F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 20)).otherwise(F.col("path")), r"\.(pprof|pb\.gz)$", "")
    many = paths.groupBy(name.alias("name")).agg(F.count("*").alias("files"))
    return paths.withColumn("name", name).join(many, "name").select("path", F.when(F.col("files") > 1, below).otherwise(F.col("name")).alias("profile_id"))


def profile_kind(path: Column | str) -> Column:
    """By the folder it lies in, else by the first kind its name holds; `unknown` without."""
    path = F.lower(F.col(path) if isinstance(path, str) else path)
    folder, name = F.get(F.slice(F.split(path, "/"), -2, 1), F.lit(0)), F.substring_index(path, "/", -1)
    out = F.when(folder.isin("cpu", "heap", "goroutine", "block", "mutex", "allocs"), F.when(folder == "allocs", "alloc").otherwise(folder))
    for kind in KINDS:
        out = out.when(name.contains(kind), kind)
    return out.otherwise("unknown")


def captured_at(path: Column | str, otherwise: Column) -> Column:
    """The time in a name like cpu_20240102_030405, else `otherwise`."""
    stamp = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"_(\d{8}_\d{6})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss")), otherwise)


def latest(profiles: DataFrame) -> DataFrame:
    """Rows of the latest file of each kind."""
    last = profiles.groupBy("profile_type").agg(F.max_by("profile_id", F.struct("captured_at", "profile_id")).alias("profile_id"))
    return profiles.join(last, ["profile_type", "profile_id"], "left_semi")


def value_of(kind: str, aliases: bool = True) -> Column:
    """A sample's value of a type, by its name or, with aliases, the first other name that fits."""
    names = F.transform("sample_types", lambda t: t["type"])
    at = F.lit(None).cast("bigint")
    for name in ALIASES.get(kind, [kind]) if aliases else [kind]:
        at = F.coalesce(at, F.nullif(F.array_position(names, name), F.lit(0).cast("bigint")))
    return F.get("values", (at - 1).cast("int"))


def detect_kind(types: Column) -> Column:
    """cpu, heap, goroutine or block of an array of type names; else the first name; `unknown` for none."""
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return (
        F.when(F.size(types) <= 0, "unknown").when(has("cpu", "nanoseconds") & has("samples", "count"), "cpu").when(has("inuse_space", "inuse_objects", "alloc_space", "alloc_objects"), "heap")
        .when(has("goroutine"), "goroutine").when(has("contentions", "delay"), "block").otherwise(F.get(types, F.lit(0)))
    )


def top_functions(profiles: DataFrame, kind: str, n: int = 0, by: str = "flat") -> DataFrame:
    """profile_id, func, flat, cum, flat_pct, cum_pct, file, line: a location's inlined lines all count as flat at the leaf.

    Recursive functions count in cum as often as they stand in a stack. n of 0 gives all.
    """
    from ..functions.values import percent_scaled
    from ..operators.stats import top

    rows = profiles.withColumn("v", value_of(kind)).where("v <> 0").select("profile_id", "v", F.posexplode("locations").alias("pos", "l"))
    rows = rows.select("profile_id", "v", "pos", F.col("l.address").alias("address"), F.explode("l.lines").alias("f"))
    name = F.when(F.coalesce("f.func", F.lit("")) == "", F.concat(F.lit("0x"), F.lower(F.hex("address")))).otherwise(F.col("f.func"))
    by_function = rows.groupBy("profile_id", name.alias("func")).agg(F.sum(F.when(F.col("pos") == 0, F.col("v")).otherwise(0)).alias("flat"), F.sum("v").alias("cum"), F.min(F.struct("f.file", "f.line")).alias("at"))
    whole = profiles.groupBy("profile_id").agg(F.sum(value_of(kind)).alias("__all"))
    found = by_function.join(whole, "profile_id").select("profile_id", "func", "flat", "cum", percent_scaled("flat", "__all").alias("flat_pct"), percent_scaled("cum", "__all").alias("cum_pct"), "at.file", "at.line")
    return top(found, ["profile_id"], [F.desc(by), F.asc("func")], n, "rank")


def to_samples(profiles: DataFrame, kind: str) -> DataFrame:
    """profile_id, sample_id, thread_name, tid, stack (root first), value: what the stack operators take."""
    name = lambda l: F.transform(l["lines"], lambda f: F.when(F.coalesce(f["func"], F.lit("")) == "", F.concat(F.lit("0x"), F.lower(F.hex(l["address"])))).otherwise(f["func"]))  # noqa: E731, E741
    stack = F.reverse(F.flatten(F.transform("locations", name)))
    rows = profiles.withColumn("value", value_of(kind)).where("value <> 0").groupBy("profile_id", stack.alias("stack")).agg(F.sum("value").alias("value"))
    return rows.select("profile_id", F.xxhash64("stack").alias("sample_id"), F.lit("").alias("thread_name"), F.lit(-1).alias("tid"), "stack", "value")


def goroutine_groups(profiles: DataFrame, n: int = 100) -> DataFrame:
    """profile_id, stack, top_func, count, pct: goroutines of equal stacks."""
    from ..functions.values import percent_scaled
    from ..operators.stats import top

    rows = to_samples(profiles, "goroutine").select("profile_id", F.concat_ws(";", "stack").alias("stack"), F.try_element_at("stack", F.lit(-1)).alias("top_func"), F.col("value").alias("count"))
    whole = rows.groupBy("profile_id").agg(F.sum("count").alias("__all"))
    best = top(rows, ["profile_id"], [F.desc("count"), F.asc("stack")], n, "rank")
    return best.join(whole, "profile_id").withColumn("pct", percent_scaled("count", "__all")).drop("__all")


def totals(profiles: DataFrame) -> DataFrame:
    """profile_id, type, unit, total of every sample type, by its exact name."""
    rows = profiles.select("profile_id", F.posexplode("sample_types").alias("i", "t"), "values")
    return rows.groupBy("profile_id", "t.type", "t.unit").agg(F.sum(F.get("values", F.col("i"))).alias("total"))
