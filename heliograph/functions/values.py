"""Sizes, shares, enumerations and formats as Spark columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import _col


def align8(n: Column | str) -> Column:
    return (_col(n).cast("bigint") + 7).bitwiseAND(F.lit(-8))


#: Bytes of an object's header, a reference and an array's header, with compressed references or without.
LAYOUT = {True: (12, 4, 16), False: (16, 8, 20)}
#: Bytes of the basic types by their code in a heap dump; an object's is the dump's id size.
TYPE_WIDTHS = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}


def class_object_size(statics: Column | str, compressed: bool = True) -> Column:
    header, reference, _ = LAYOUT[compressed]
    return align8(F.lit(header + 15 * reference + 20) + _col(statics) * reference)


def type_width(code: Column | str, id_size: int = 8) -> Column:
    codes = F.create_map(F.lit(2), F.lit(id_size), *(F.lit(x) for p in TYPE_WIDTHS.items() for x in p))
    return F.try_element_at(codes, _col(code))


def percent(value: Column | str, total: Column | str) -> Column:
    """value / total * 100, 0 where the total isn't positive."""
    value, total = _col(value), _col(total)
    return F.when(total > 0, value / total * 100).otherwise(F.lit(0.0))


def percent_scaled(value: Column | str, total: Column | str) -> Column:
    """value * 100.0 / total; the last bit can differ from percent()."""
    value, total = _col(value), _col(total)
    return F.when(total > 0, value * F.lit(100.0) / total).otherwise(F.lit(0.0))


def is_high_priority(duration: Column | str, perf_duration: Column | str | None = None) -> Column:
    """A short task: either duration from 1 to 120 seconds."""
    short = lambda c: F.coalesce(_col(c).between(1, 120), F.lit(False))
    return short(duration) | short(perf_duration) if perf_duration is not None else short(duration)


#: Names of task types by number, and the resource each looks at.
TASK_TYPES = ["generic", "java", "tracing", "timing", "memleak", "pprof_mem", "java_heap", "phys_mem", "jeprof", "bolt", "pprof_cpu", "pprof_heap", "pprof_goroutine", "pprof_block", "pprof_mutex"]
RESOURCES = {"CPU": [0, 3, 10], "App": [1], "Disk": [2], "Memory": [4, 5, 6, 7, 8, 11], "Goroutine": [12], "Concurrency": [13, 14]}
PROFILERS = ["perf", "async_alloc", "pprof"]


def task_type_name(code: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, TASK_TYPES)), F.when(_col(code) >= 0, _col(code) + 1).otherwise(99)), F.lit("unknown"))


def resource_type(code: Column | str) -> Column:
    out = None
    for name, codes in RESOURCES.items():
        out = (F if out is None else out).when(_col(code).isin(codes), name)
    return out.otherwise("Unknown")


#: States of a recording and of its analysis, by number; an analysis has no state 4.
STATUSES = {0: "pending", 1: "running", 2: "completed", 3: "failed"}
ANALYSIS_STATUSES = {0: "pending", 1: "running", 2: "completed", 3: "failed", 5: "cancelled"}


def _named(code: Column | str, names: dict[int, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, _col(code).cast("int")), F.lit("unknown"))


def status_name(code: Column | str) -> Column:
    return _named(code, STATUSES)


def analysis_status_name(code: Column | str) -> Column:
    return _named(code, ANALYSIS_STATUSES)


def profiler_name(code: Column | str) -> Column:
    return _named(code, dict(enumerate(PROFILERS)))


#: Analysis modes with their task type and profiler.
MODES = {
    "java-cpu": (1, 0), "java-alloc": (1, 1), "java-heap": (6, 0), "cpu": (0, 0), "pprof-cpu": (10, 2),
    "pprof-heap": (11, 2), "pprof-goroutine": (12, 2), "pprof-block": (13, 2), "pprof-mutex": (14, 2), "pprof-all": (10, 2),
}
PRESETS = {"quick": "quick", "fast": "quick", "standard": "standard", "normal": "standard", "default": "standard", "": "standard", "detailed": "detailed", "deep": "detailed", "full": "detailed"}


def parse_mode(text: str) -> str:
    mode = text.strip().lower()
    if mode not in MODES:
        raise ValueError(f"no such mode: {text}")
    return mode


def parse_preset(text: str) -> str:
    preset = text.strip().lower()
    if preset not in PRESETS:
        raise ValueError(f"no such preset: {text}")
    return PRESETS[preset]


def fixed(x: Column | str, places: int) -> Column:
    """x with that many decimals, rounded as C and Go do: the double's exact value, ties to even.

    format_string rounds the double's shortest text, ties away from zero. Here product + error is exactly x * 10**places:
    the error is that of a product of halves, and decides where the product alone is a tie. From 2**45 on, where places
    are few beside the digits before them, and for what is no number, the text is that of format_string.
    """
    x, ten = _col(x).cast("double"), float(10**places)
    product = x * ten
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (x - high) * ten - (product - high * ten)
    over = product - F.rint(product)
    units = F.rint(product) + F.when((F.abs(over) == 0.5) & (over * error > 0), over * 2).otherwise(0.0)
    text = (F.abs(units).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast("string")
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.abs(x) < float(1 << 45), F.concat(sign, text)).otherwise(F.format_string(f"%.{places}f", x))


def format_percent(x: Column | str) -> Column:
    """Two decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(fixed(x, 2), "0+$", ""), r"\.$", "")


def format_bytes(n: Column | str, unit: str = " B", most: str = "GB") -> Column:
    n = _col(n).cast("double")
    units = ["KB", "MB", "GB", "TB"][: ["KB", "MB", "GB", "TB"].index(most) + 1]
    out = F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(unit)))
    for i, u in enumerate(units, 1):
        text = F.concat(fixed(n / 1024**i, 2), F.lit(f" {u}"))
        out = out.otherwise(text) if u == most else out.when(n < 1024 ** (i + 1), text)
    return out


def format_duration_ns(n: Column | str) -> Column:
    n = _col(n).cast("double")
    return F.when(n >= 1e9, F.concat(fixed(n / 1e9, 2), F.lit("s"))).when(n >= 1e6, F.concat(fixed(n / 1e6, 2), F.lit("ms"))).when(n >= 1e3, F.concat(fixed(n / 1e3, 2), F.lit("us"))).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit("ns")))


def format_number(n: Column | str) -> Column:
    """Thousands and more with one decimal and a letter; below, the number."""
    n = _col(n).cast("double")
    return F.when(n >= 1e9, F.concat(fixed(n / 1e9, 1), F.lit("G"))).when(n >= 1e6, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1e3, F.concat(fixed(n / 1e3, 1), F.lit("K"))).otherwise(F.regexp_replace(n.cast("string"), r"\.0$", ""))


def format_time(at: Column | str) -> Column:
    """A time to the second; a dash for none."""
    return F.coalesce(F.date_format(_col(at), "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
