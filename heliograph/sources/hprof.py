"""JVM heap dumps as tables: an index of the file's records first, then a task for each heap segment.

Records of strings and classes and the places of heap segments come from record headers, which many tasks look for, each
in its own range of the file, and which skip the segments' bodies. Segments, the long ones in parts, are then decoded by many tasks, each reading its own range of the
file as a stream. Instance references are
taken from the raw field bytes by a join to the class layouts, so it doesn't matter which comes first in a dump.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fn
from ..functions.values import LAYOUT, TYPE_WIDTHS, align8, class_object_size
from ..plans.storage import stored

INDEX = "path string, id_size int, taken_ms long, kind string, id long, other long, text string, offset long, length long"
RECORD = "kind string, id long, class_id long, n long, type int, data binary, text string"
#: Tags of roots inside a heap segment, with the bytes that follow the object's id; "id" is another id.
ROOTS = {
    0xFF: ("UNKNOWN", ()), 0x01: ("JNI_GLOBAL", ("id",)), 0x02: ("JNI_LOCAL", (4, 4)), 0x03: ("JAVA_FRAME", (4, 4)), 0x04: ("NATIVE_STACK", (4,)), 0x05: ("STICKY_CLASS", ()),
    0x06: ("THREAD_BLOCK", (4,)), 0x07: ("MONITOR_USED", ()), 0x08: ("THREAD_OBJECT", (4, 4)), 0x89: ("INTERNED_STRING", ()), 0x8A: ("FINALIZING", ()), 0x8B: ("DEBUGGER", ()),
    0x8C: ("REFERENCE_CLEANUP", ()), 0x8D: ("VM_INTERNAL", ()), 0x8E: ("JNI_MONITOR", (4, 4)),
}
#: Names of the primitive arrays' classes, whose ids aren't in a dump, by type code.
PRIMITIVE_CLASSES = {4: "boolean[]", 5: "char[]", 6: "float[]", 7: "double[]", 8: "byte[]", 9: "short[]", 10: "int[]", 11: "long[]"}
PRIMITIVE_BASE = 0x1000000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Bytes:
    """The bytes of a file from a place on, read as they are taken."""

    WINDOW = 1 << 20

    def __init__(self, file, at: int, length: int, id_size: int) -> None:
        self.file, self.end, self.id_size = file, at + length, id_size
        self.raw, self.at, self.read_to = b"", 0, at
        file.seek(at)

    def place(self) -> int:
        return self.read_to - len(self.raw) + self.at

    def more(self) -> bool:
        return self.place() < self.end

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            if self.place() + n > self.end:
                raise EOFError
            rest = self.raw[self.at :]
            new = self.file.read(min(max(n - len(rest), self.WINDOW), self.end - self.read_to))
            self.read_to += len(new)
            self.raw, self.at = rest + new, 0
            if len(self.raw) < n:
                raise EOFError
        self.at += n
        return self.raw[self.at - n : self.at]

    def skip(self, n: int) -> None:
        if self.at + n <= len(self.raw):
            self.at += n
            return
        to = self.place() + n
        if to > self.end:
            raise EOFError
        self.raw, self.at, self.read_to = b"", 0, to
        self.file.seek(to)

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def id(self) -> int:
        return _signed(self.uint(self.id_size))


#: Bytes of a heap segment that one task decodes, about; longer segments are split between records.
PART_BYTES = 64 << 20


def pass_over(b: _Bytes) -> bool:
    """Skip one record of a heap segment; False, at its tag, where the tag is unknown."""
    ident, start = b.id_size, b.place()
    tag = b.uint(1)
    width = lambda t: ident if t == 2 else TYPE_WIDTHS[t]
    if tag in ROOTS:
        b.skip(ident + sum(ident if n == "id" else n for n in ROOTS[tag][1]))
    elif tag == 0x20:
        b.skip(7 * ident + 8)
        for _ in range(b.uint(2)):
            b.skip(2)
            b.skip(width(b.uint(1)))
        for _ in range(b.uint(2)):
            b.skip(ident)
            b.skip(width(b.uint(1)))
        b.skip(b.uint(2) * (ident + 1))
    elif tag == 0x21:
        b.skip(2 * ident + 4)
        b.skip(b.uint(4))
    elif tag == 0x22:
        b.skip(ident + 4)
        n = b.uint(4)
        b.skip(ident + n * ident)
    elif tag in (0x23, 0xC3):
        b.skip(ident + 4)
        n, kind = b.uint(4), b.uint(1)
        b.skip(n * width(kind) if tag == 0x23 else 0)
    elif tag == 0xFE:
        b.skip(4 + ident)
    elif tag != 0:
        b.skip(start - b.place())
        return False
    return True


def parts_of(file, at: int, length: int, id_size: int) -> Iterator[tuple[int, int]]:
    """Place and length of parts of a heap segment that begin and end with records, of about PART_BYTES each.

    Bodies are skipped, so the pass reads heads of records only. What follows an unknown tag is one part.
    """
    if length <= PART_BYTES:
        yield at, length
        return
    b, first = _Bytes(file, at, length, id_size), at
    try:
        while b.more() and pass_over(b):
            if b.place() - first >= PART_BYTES:
                yield first, b.place() - first
                first = b.place()
    except (EOFError, KeyError):
        pass
    if first < at + length:
        yield first, at + length - first


#: Bytes of a dump whose records one task looks for, and successive heads that have to agree on where they are.
RANGE_BYTES, AGREE = 64 << 20, 8
#: Tags of a dump's records.
TAGS = (0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x1C, 0x2C)


def dump_head(file) -> tuple[int, int, int]:
    """Size of ids, milliseconds when it was taken, and where the first record begins."""
    file.seek(0)
    head = b""
    while not head.endswith(b"\0"):
        if not (one := file.read(1)):
            raise ValueError("not a heap dump: its first line has no end")
        head += one
    return *struct.unpack(">IQ", file.read(12)), file.tell()


def agrees(file, at: int, size: int) -> bool:
    """Whether AGREE heads in a row from `at`, or all up to the file's end, have known tags and lengths that fit."""
    for _ in range(AGREE):
        if at == size:
            return True
        if at + 9 > size:
            return False
        file.seek(at)
        tag, _, length = struct.unpack(">BII", file.read(9))
        at += 9 + length
        if tag not in TAGS or at > size:
            return False
    return True


def first_record(file, start: int, stop: int, size: int) -> int | None:
    """The first place from start on, before stop, where records seem to begin."""
    known = np.zeros(256, bool)
    known[list(TAGS)] = True
    for base in range(start, stop, _Bytes.WINDOW):
        file.seek(base)
        raw = np.frombuffer(file.read(min(_Bytes.WINDOW + 9, size - base)), np.uint8)
        spots = np.flatnonzero(known[raw[: max(0, min(len(raw) - 8, stop - base))]])
        length = sum(raw[spots + 5 + k].astype(np.int64) << 8 * (3 - k) for k in range(4))
        for spot in spots[base + spots + 9 + length <= size].tolist():
            if agrees(file, base + spot, size):
                return base + spot
    return None


def records_from(file, name: str, id_size: int, taken: int, head: int, at: int, stop: int, size: int) -> Iterator[tuple]:
    """INDEX tuples of the records that begin from `at` on and before stop, last of all a `bounds` row with where they end.

    A bounds row has the first record's place as id, where the last one ends as other, the dump's first one's as offset.
    """
    begin = at
    while at < stop and at + 9 <= size:
        file.seek(at)
        tag, _, length = struct.unpack(">BII", file.read(9))
        place = at + 9
        if tag == 0x01:
            b = _Bytes(file, place, length, id_size)
            yield name, id_size, taken, "string", b.id(), None, b.take(length - id_size).decode("utf-8", "replace"), place, length
        elif tag == 0x02:
            b = _Bytes(file, place, length, id_size)
            b.take(4)
            cls = b.id()
            b.take(4)
            yield name, id_size, taken, "class", cls, b.id(), None, place, length
        elif tag in (0x0C, 0x1C):
            for first, part in parts_of(file, place, length, id_size):
                yield name, id_size, taken, "segment", None, None, None, first, part
        elif tag == 0x07:
            live, instances = struct.unpack_from(">II", file.read(length))
            yield name, id_size, taken, "summary", live, instances, None, place, length
        at = place + length
    yield name, id_size, taken, "bounds", begin, size if at < stop else at, None, head, 0


def ranges_read(ranges: DataFrame) -> DataFrame:
    """INDEX rows and `at` of ranges (path, at, stop, start): from start, or where start is null from the first record found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [*INDEX.split(", "), "at long"]
        names = [x.split()[0] for x in columns]
        kinds = [pa.int64() if x.endswith("long") else pa.int32() if x.endswith(" int") else pa.string() for x in columns]
        for batch in batches:
            for name, at, stop, start in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "stop", "start")), strict=True):
                fs, place = pafs.FileSystem.from_uri(name)
                rows: list[tuple] = []
                with fs.open_input_file(place) as file:
                    size = file.size()
                    id_size, taken, head = dump_head(file)
                    begin = start if start is not None else head if at <= head < stop else first_record(file, at, stop, size)
                    if begin is None:
                        rows.append((name, id_size, taken, "bounds", None, None, None, head, 0, at))
                    else:
                        for row in records_from(file, name, id_size, taken, head, begin, stop, size):
                            rows.append((*row, at))
                            if len(rows) >= 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.select("path", "at", "stop", "start").mapInArrow(run, f"{INDEX}, at long")


def misread(bounds: list[tuple], heads: dict[str, int]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Ranges (path, at) that begin where those before end, and (path, at, start) of the first of each dump that don't.

    bounds are (path, at, stop, begin, end) of all ranges; a range that a record of one before covers is right if
    nothing of it is used.
    """
    right, wrong, expected, broken = [], [], dict(heads), set()
    for path, at, stop, begin, end in sorted(bounds, key=lambda b: (b[0], b[1])):
        if path in broken or expected[path] >= stop:
            continue
        if begin == expected[path]:
            right.append((path, at))
            expected[path] = end
        else:
            wrong.append((path, at, expected[path]))
            broken.add(path)
    return right, wrong


def index(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """INDEX rows of the dumps under path: kind is string, class, segment or summary.

    Each task looks for the records that begin in a range of a dump: it searches for a place from which on several
    heads agree. What it found is used only if it begins where the range before it ends; a range that was misled, as
    by bytes of an object that look like records, is read again from the right place. So the rows are those of one
    pass over the whole dump, whatever it holds.
    """
    step = range_bytes or RANGE_BYTES
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("at")
    ranges = files.select("path", "length", at).select("path", "at", F.least(F.col("at") + step, "length").alias("stop"), F.lit(None).cast("long").alias("start"))
    ranges = ranges.repartition(max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism)), "path", "at")
    found = stored(ranges_read(ranges), "hprof-ranges")
    # A row a range reaches the driver, 16 for each GB of a dump.
    stops = {(r["path"], r["at"]): r["stop"] for r in ranges.select("path", "at", "stop").collect()}
    told = found.where("kind = 'bounds'").select("path", "at", "id", "other", "offset").collect()
    bounds, heads = {(r["path"], r["at"]): (r["id"], r["other"]) for r in told}, {r["path"]: r["offset"] for r in told}
    tables = [found]
    while True:
        right, wrong = misread([(*k, stops[k], *v) for k, v in bounds.items()], heads)
        if not wrong:
            break
        redo = spark.createDataFrame([(p, a, stops[p, a], start) for p, a, start in wrong], "path string, at long, stop long, start long")
        more = stored(ranges_read(redo), "hprof-ranges")
        bounds |= {(r["path"], r["at"]): (r["id"], r["other"]) for r in more.where("kind = 'bounds'").collect()}
        tables = [t.join(F.broadcast(redo.select("path", "at")), ["path", "at"], "left_anti").select(*t.columns) for t in tables] + [more]
    kept = spark.createDataFrame(right, "path string, at long")
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    names = [x.split()[0] for x in INDEX.split(", ")]
    return whole.where("kind <> 'bounds'").join(F.broadcast(kept), ["path", "at"], "left_semi").select(*names)


def sub_records(b: _Bytes) -> Iterator[tuple]:
    """RECORD tuples of a part of a segment. An unknown tag, or a record cut short, ends it, and gives a row itself.

    That row is of kind `unknown` or `cut`, with the tag as id and how many bytes are left as n.
    """
    id_size, left = b.id_size, b.end - b.place()
    width = lambda t: id_size if t == 2 else TYPE_WIDTHS[t]
    try:
        while b.more():
            left = b.end - b.place()
            tag = b.uint(1)
            if tag in ROOTS:
                name, rest = ROOTS[tag]
                obj = b.id()
                for n in rest:
                    b.take(id_size if n == "id" else n)
                yield "root", obj, None, None, None, None, name
            elif tag == 0x20:
                cls = b.id()
                b.take(4)
                above, loader, signers, domain = (b.id() for _ in range(4))
                b.take(2 * id_size)
                size = b.uint(4)
                for _ in range(b.uint(2)):
                    b.take(2)
                    b.take(width(b.uint(1)))
                statics = b.uint(2)
                for _ in range(statics):
                    name, kind = b.id(), b.uint(1)
                    value = b.take(width(kind))
                    if kind == 2 and any(value):
                        yield "static", cls, name, _signed(int.from_bytes(value, "big")), None, None, None
                for field, to in (("<superclass>", above), ("<classloader>", loader), ("<signers>", signers), ("<protectionDomain>", domain)):
                    if to:
                        yield "ref", cls, None, to, None, None, field
                if loader:
                    yield "ref", loader, None, cls, None, None, "<loaded_class>"
                for ordinal in range(b.uint(2)):
                    name, kind = b.id(), b.uint(1)
                    yield "field", cls, name, ordinal, kind, None, None
                yield "layout", cls, above, size, statics, None, None
            elif tag == 0x21:
                obj = b.id()
                b.take(4)
                cls = b.id()
                data = b.take(b.uint(4))
                yield "instance", obj, cls, len(data), None, data, None
            elif tag == 0x22:
                obj = b.id()
                b.take(4)
                n = b.uint(4)
                cls = b.id()
                yield "object_array", obj, cls, n, None, b.take(n * id_size), None
            elif tag in (0x23, 0xC3):
                obj = b.id()
                b.take(4)
                n, kind = b.uint(4), b.uint(1)
                if tag == 0x23:
                    b.take(n * width(kind))
                yield "primitive_array", obj, PRIMITIVE_BASE + kind, n, kind, None, None
            elif tag == 0xFE:
                b.take(4 + id_size)
            elif tag != 0:
                yield "unknown", tag, None, left, None, None, None
                return
    except EOFError:
        yield "cut", tag, None, left, None, None, None


def records(spark: SparkSession, found: DataFrame) -> DataFrame:
    """RECORD rows of all segments of an index, with their id size; a task reads the ranges dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for name, id_size, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "id_size", "offset", "length")), strict=True):
                fs, place = pafs.FileSystem.from_uri(name)
                rows: list[tuple] = []
                with fs.open_input_file(place) as file:
                    for row in sub_records(_Bytes(file, at, length, id_size)):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    segments = found.where("kind = 'segment'").select("path", "id_size", "offset", "length")
    dealt = segments.repartition(max(1, min(segments.count(), 4 * spark.sparkContext.defaultParallelism)), "offset")
    return dealt.mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str, compressed: bool = True) -> dict[str, DataFrame]:
    """Tables of one dump: header, strings, objects (obj_id, class_id, class_name, shallow, kind), classes, class_fields, refs, roots, class_objects, summary.

    `undecoded` has a row (kind, tag, bytes) for every stretch of a heap segment that an unknown tag or a cut record hid.
    """
    header, reference, array_header = LAYOUT[compressed]
    found = stored(index(spark, path), "hprof-index")
    rows = stored(records(spark, found), "hprof-records")
    first = found.select("id_size").head()
    id_size = first.id_size if first else 8
    strings = found.where("kind = 'string'").select(F.col("id").alias("name_id"), "text")
    named = found.where("kind = 'class'").select(F.col("id").alias("class_id"), F.col("other").alias("name_id")).join(strings, "name_id", "left").select("class_id", fn.class_name("text").alias("name"))
    primitive = spark.createDataFrame([(PRIMITIVE_BASE + k, v) for k, v in PRIMITIVE_CLASSES.items()], "class_id long, name string")
    class_names = named.unionByName(primitive)
    layouts = rows.where("kind = 'layout'").select(F.col("id").alias("class_id"), F.nullif("class_id", F.lit(0)).alias("super_class_id"), F.col("n").alias("instance_size"), F.col("type").alias("static_fields"))
    fields = rows.where("kind = 'field'").select(F.col("id").alias("class_id"), F.col("n").alias("ordinal"), F.col("type"), F.col("class_id").alias("name_id")).join(strings, "name_id", "left").select("class_id", "ordinal", F.col("text").alias("name"), "type")
    java_class = class_names.where("name = 'java.lang.Class'").select(F.col("class_id").alias("java_class")).limit(1)
    instances = rows.where("kind = 'instance'").join(layouts.select("class_id", "instance_size"), "class_id", "left").select(F.col("id").alias("obj_id"), "class_id", align8(F.lit(header) + F.coalesce("instance_size", "n")).alias("shallow"), "kind")
    width = F.when(F.col("type").isNull(), id_size).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_WIDTHS.items() for x in p)), F.col("type")))
    arrays = rows.where("kind = 'primitive_array' or (kind = 'object_array' and n > 0)").select(F.col("id").alias("obj_id"), "class_id", align8(F.lit(array_header) + F.col("n") * width).alias("shallow"), "kind")
    class_rows = layouts.join(F.broadcast(java_class), F.lit(True), "left").select(F.col("class_id").alias("obj_id"), F.coalesce("java_class", "class_id").alias("class_id"), class_object_size("static_fields", compressed).alias("shallow"), F.lit("class").alias("kind"))
    objects = instances.unionByName(arrays).unionByName(class_rows).join(class_names.withColumnRenamed("name", "class_name"), "class_id", "left")

    class_refs = rows.where("kind = 'ref'").select(F.col("id").alias("from_id"), F.col("n").alias("to_id"), F.col("text").alias("field"))
    static_refs = rows.where("kind = 'static'").select("id", "class_id", "n").join(strings.withColumnRenamed("name_id", "class_id"), "class_id", "left").select(F.col("id").alias("from_id"), F.col("n").alias("to_id"), F.col("text").alias("field"))
    big_endian = lambda data, at: F.conv(F.hex(F.substring(data, at, F.lit(id_size))), 16, -10).cast("bigint")
    places = F.sequence(F.lit(0), F.col("n") - 1)
    array_refs = rows.where("kind = 'object_array' and n > 0").select(F.col("id").alias("from_id"), "data", F.explode(places).alias("i")).select("from_id", big_endian("data", (F.col("i") * id_size + 1).cast("int")).alias("to_id"), F.format_string("[%d]", "i").alias("field"))
    offsets = _field_offsets(layouts, fields, id_size).where("type = 2").select("class_id", "offset", "name")
    field_refs = rows.where("kind = 'instance'").select(F.col("id").alias("from_id"), "class_id", "data").join(offsets, "class_id").select("from_id", big_endian("data", (F.col("offset") + 1).cast("int")).alias("to_id"), F.col("name").alias("field"))
    refs = class_refs.unionByName(static_refs).unionByName(array_refs.where("to_id <> 0")).unionByName(field_refs.where("to_id <> 0"))
    return {
        "header": found.select("id_size", "taken_ms").distinct(),
        "strings": strings,
        "undecoded": rows.where("kind in ('unknown', 'cut')").select("kind", F.col("id").alias("tag"), F.col("n").alias("bytes")),
        "objects": objects.select("obj_id", "class_id", "class_name", "shallow", "kind"),
        "classes": layouts.join(class_names, "class_id", "left").select("class_id", "name", "super_class_id", "instance_size", "static_fields"),
        "class_fields": fields,
        "refs": refs,
        "roots": rows.where("kind = 'root'").select(F.col("id").alias("obj_id"), F.col("text").alias("root_type")).distinct(),
        "class_objects": layouts.select(F.col("class_id").alias("obj_id")),
        "summary": found.where("kind = 'summary'").select(F.col("id").alias("live_bytes"), F.col("other").alias("live_instances")),
    }


def _field_offsets(layouts: DataFrame, fields: DataFrame, id_size: int) -> DataFrame:
    """class_id, name, type, offset: where in an instance's bytes each field lies, the class's own first, then the superclasses'."""
    from pyspark.sql import Window

    from ..operators.heap import class_chain

    widths = F.create_map(F.lit(2), F.lit(id_size), *(F.lit(x) for p in TYPE_WIDTHS.items() for x in p))
    rows = class_chain(layouts).join(fields.withColumnRenamed("class_id", "ancestor_id"), "ancestor_id").withColumn("width", F.element_at(widths, F.col("type")))
    before = Window.partitionBy("class_id").orderBy("depth", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("class_id", "name", "type", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("offset"))
