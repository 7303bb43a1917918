"""Names of frames, threads, functions and classes as Spark columns; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULE = r"(?s)^(.*)\(([^(]*)\)$"
APM_THREAD = r"^\[(.+)\s+tid=(\d+)\]$"
BEFORE_DASH = r"(?s)^(.+)-[^-]*$"
AFTER_SLASH = r"(?s)^.+/([^/]+)$"
ALLOCATION = r"_\[(i|k)\]$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame_function(frame: Column | str) -> Column:
    """`func(module)` without its module."""
    frame = _col(frame)
    return F.when(frame.rlike(MODULE), F.regexp_extract(frame, MODULE, 1)).otherwise(frame)


def frame_module(frame: Column | str) -> Column:
    """The module after the last bracket of a frame that ends in one; empty without."""
    frame = _col(frame)
    return F.when(frame.rlike(MODULE), F.regexp_extract(frame, MODULE, 2)).otherwise("")


def thread_name(frame: Column | str) -> Column:
    """`[name tid=n]`, or what stands before the last dash, or the whole frame."""
    frame = _col(frame)
    return F.when(frame.rlike(APM_THREAD), F.regexp_extract(frame, APM_THREAD, 1)).when(frame.rlike(BEFORE_DASH), F.regexp_extract(frame, BEFORE_DASH, 1)).otherwise(frame)


def thread_id(frame: Column | str) -> Column:
    """`[name tid=n]`, or the integer after the last slash; -1 without."""
    frame = _col(frame)
    digits = F.when(frame.rlike(APM_THREAD), F.regexp_extract(frame, APM_THREAD, 2)).when(frame.rlike(AFTER_SLASH), F.regexp_extract(frame, AFTER_SLASH, 1))
    return F.coalesce(F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("int")), F.lit(-1))


def is_idle(thread: Column | str) -> Column:
    """Idle threads as the parser and the statistics tell them."""
    thread = _col(thread)
    return (thread == "swapper") | thread.startswith("swapper-")


def is_idle_in_graphs(thread: Column | str) -> Column:
    """Idle threads as the flame graph and call graph tell them; the two readings differ on purpose."""
    thread = _col(thread)
    return (thread == "swapper") | thread.startswith("swapper/") | (thread == "[swapper]") | thread.startswith("[swapper/")


def is_invalid_marker(frame: Column | str) -> Column:
    return _col(frame).rlike(r"^\d+_\d+_")


def thread_group(name: Column | str) -> Column:
    """The name without trailing digits, dashes, underscores and hashes; a name of nothing else stays."""
    name = _col(name)
    return F.coalesce(F.nullif(F.regexp_replace(name, "[0-9_#-]+$", ""), F.lit("")), name)


#: Forms of thread names, of which the first that fits gives the group.
GROUP_PATTERNS = [r"^(.*?)-\d+$", r"^(.*?)_\d+$", r"^(.*?)\[\d+\]$", r"^(.*?)#\d+$", r"^pool-\d+-(.*?)$"]


def thread_group_by_pattern(name: Column | str) -> Column:
    """The first that fits: name-1, name_1, name[1], name#1, pool-1-name; else the name, `unknown` for none."""
    name = _col(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown")
    for pattern in GROUP_PATTERNS:
        out = out.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))
    return out.otherwise(name)


def stack_to_string(stack: Column | str) -> Column:
    return F.concat_ws(";", _col(stack))


def string_to_stack(text: Column | str) -> Column:
    """Frames of a folded stack; null for an empty one."""
    return F.split(F.nullif(_col(text), F.lit("")), ";")


def leaf(stack: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_col(stack), F.lit(-1)), F.lit(""))


def node_id(name: Column | str, module: Column | str) -> Column:
    name, module = _col(name), _col(module)
    return F.when(module == "", name).otherwise(F.concat(name, F.lit("("), module, F.lit(")")))


def go_module(function: Column | str) -> Column:
    """The package path: up to the first dot after the last slash; the whole name where there is none."""
    function = _col(function)
    return F.coalesce(F.nullif(F.regexp_extract(function, r"^((?:.*/)?[^./][^.]*)", 1), F.lit("")), function)


def hex_address(address: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(address))))


def parse_object_id(text: Column | str) -> Column:
    """An id from `0x` and hexadecimal digits, else hexadecimal, else decimal digits, as the same 64 bits, signed."""
    text = F.lower(_col(text))
    digits = F.regexp_replace(text, "^0x", "")
    as_bits = lambda base: F.conv(digits, base, -10).try_cast("bigint")
    return F.when(digits.rlike("^[0-9a-f]{1,16}$"), as_bits(16)).when(digits.rlike("^[0-9]+$"), as_bits(10))


#: The type codes of array classes in the virtual machine's notation.
ARRAY_CODES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}


def class_name(internal: Column | str) -> Column:
    """`java/lang/String` with dots, `[Ljava/lang/Object;` and `[[I` as `java.lang.Object[]` and `int[][]`."""
    name = F.translate(_col(internal), "/", ".")
    depth = F.length(F.regexp_extract(name, r"^(\[*)", 1))
    rest = F.regexp_replace(name, r"^\[+", "")
    codes = F.create_map(*(F.lit(x) for pair in ARRAY_CODES.items() for x in pair))
    base = F.when(rest.rlike(r"^L.*;$"), F.regexp_extract(rest, r"^L(.*);$", 1)).otherwise(F.coalesce(F.try_element_at(codes, rest), rest))
    return F.when(depth > 0, F.concat(base, F.repeat(F.lit("[]"), depth))).otherwise(name)


def package_name(name: Column | str) -> Column:
    name = _col(name)
    return F.when(name.contains("."), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise("default")


def short_class(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", -1)


def allocation_kind(function: Column | str) -> Column:
    """`instance` for a mark of counts, `size` for one of bytes, else null."""
    mark = F.regexp_extract(_col(function), ALLOCATION, 1)
    return F.when(mark == "i", "instance").when(mark == "k", "size")


def without_allocation_mark(function: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(function), F.lit("")), ALLOCATION, "")


#: Forms of method names (library::function, [tag] function, path/package.function, (*Type).method).
NATIVE_NAME, TAGGED_NAME = r"^(.+\.so(?:\.[0-9.]+)?)::(\w+)$", r"^\[(\w+)\]\s*(.*)$"
GO_NAME, RECEIVER_NAME = r"^((?:[\w-]+/)*[\w-]+(?:/[\w-]+)*)\.(\w+)$", r"\(\*?([^)]+)\)\.(\w+)$"


def method_parts(name: Column | str) -> Column:
    """struct(type, package, class, method) of a name of a native library, kernel, C++, Go, Java or path style."""
    clean = without_allocation_mark(name)
    native, tag, go = NATIVE_NAME, TAGGED_NAME, GO_NAME
    library = F.regexp_extract(clean, native, 1)
    parent = lambda x, sep: F.when(F.instr(x, sep) > 0, F.left(x, F.length(x) - F.length(F.substring_index(x, sep, -1)) - len(sep))).otherwise("")
    make = lambda kind, package, cls, method: F.struct(F.lit(kind).alias("type"), _lit(package).alias("package"), _lit(cls).alias("class"), _lit(method).alias("method"))
    last = lambda x, sep: F.substring_index(x, sep, -1)
    dotted = clean.contains(".") & ~clean.contains("/") & ~clean.contains("::")
    return (
        F.when(clean.rlike(native), make("native_lib", parent(library, "/"), last(library, "/"), F.regexp_extract(clean, native, 2)))
        .when(clean.rlike(tag), make("kernel", "", F.concat(F.lit("["), F.regexp_extract(clean, tag, 1), F.lit("]")), F.regexp_extract(clean, tag, 2)))
        .when(clean.contains("::") & ~clean.contains("."), make("cpp", parent(parent(clean, "::"), "::"), last(parent(clean, "::"), "::"), last(clean, "::")))
        .when(clean.rlike(go) & clean.contains("/"), make("go", F.regexp_extract(clean, go, 1), last(F.regexp_extract(clean, go, 1), "/"), F.regexp_extract(clean, go, 2)))
        .when(dotted, make("java", parent(parent(clean, "."), "."), last(parent(clean, "."), "."), last(clean, ".")))
        .when(clean.startswith("/") & ~clean.contains("::"), make("path", parent(clean, "/"), "", last(clean, "/")))
        .otherwise(make("simple", "", "", clean))
    )


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def search_term(name: Column | str) -> Column:
    """A short part of a name to search for: the method of a Go one, Class.method of a dotted one, and so on."""
    clean = without_allocation_mark(name)
    receiver = RECEIVER_NAME
    after = F.substring_index(clean, "/", -1)
    final = F.substring_index(after, ".", -1)
    two = F.substring_index(clean, ".", -2)
    return (
        F.when(clean.rlike(receiver), F.regexp_extract(clean, receiver, 2))
        .when(clean.contains("/"), F.when(after.contains(".") & (final != "") & ~final.startswith("("), final).otherwise(after))
        .when(clean.contains("."), F.when(F.length(two) > 50, F.substring_index(clean, ".", -1)).otherwise(two))
        .when(clean.contains("::"), F.substring_index(clean, "::", -1))
        .otherwise(clean)
    )


#: What marks a function as the runtime's or system's, by filter.
SYSTEM_PATTERNS = {
    "jvm": [r"^java\.", r"^javax\.", r"^jdk\.", r"^sun\.", r"^com\.sun\.", r"^org\.openjdk\.", r"Unsafe\."],
    "gc": [r"(?i)GC", r"(?i)Garbage", "^G1", "^ZGC", "^Shenandoah", "ParallelGC", "ConcurrentMark", "(?i)SafePoint", "VMThread", "Reference.*Handler"],
    "native": [r"^\[native\]", r"^libc\.", "^libpthread", "^ld-linux", "^__", "^_Z", "^std::", "::operator", "^pthread_", "^malloc", "^free$", "^mmap", "^munmap", "^brk$", "^clone$", "^futex", "^epoll_", "^syscall"],
    "kernel": [r"^\[kernel\]", "^vmlinux", "^do_syscall", "^sys_", "^__x64_sys", "^entry_SYSCALL", "^page_fault", "^handle_mm_fault", "^__schedule", "^schedule$", "^ret_from_fork", "^irq_", "^softirq", "^ksoftirqd", "^kworker", "^rcu_"],
    "reflect": ["(?i)reflect", r"\$Proxy", "CGLIB", "ByteBuddy", "javassist", "MethodHandle", "LambdaForm", "GeneratedMethodAccessor", "DelegatingMethodAccessor", "NativeMethodAccessor", "invoke0", "invokespecial", "invokevirtual"],
}


def is_system_function(name: Column | str, filters: list[str]) -> Column:
    """Whether a name fits a pattern of any of the filters: jvm, gc, native, kernel, reflect."""
    patterns = [p for f in filters for p in SYSTEM_PATTERNS.get(f, [])]
    return F.coalesce(_col(name).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def contains_ignoring_case(text: Column | str, part: str) -> Column:
    return F.lower(_col(text)).contains(part.lower())


def truncated(text: Column | str, n: int) -> Column:
    """A text of more than n bytes as its first n - 3 bytes and three dots; a character that this would cut goes whole."""
    text, kept = _col(text), max(0, n - 3)
    raw = F.encode(text, "UTF-8")
    # Bytes 128 to 191 go on with a character: the cut goes back to where one begins, 3 bytes at most.
    begins = F.filter(F.array(*(F.lit(k) for k in range(kept, max(kept - 4, -1), -1))), lambda k: (F.conv(F.hex(F.substring(raw, k + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0)) != 0x80)
    at = F.coalesce(F.get(begins, F.lit(0)), F.lit(0))
    return F.when(F.octet_length(text) > n, F.concat(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"), F.lit("..."))).otherwise(text)
