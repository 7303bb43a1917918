"""Rules over profiles and heaps. A rule takes a table and gives (rule, func, value) rows; register more with RULES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..functions.values import format_percent

#: Parts of names that tell what a function does; case matters.
GC_WORDS = ["GC", "gc", "G1", "CMS", "ParNew", "ParallelGC", "SafepointSynchronize", "safepoint"]
LOCK_WORDS = ["Monitor", "monitor", "Lock", "lock", "synchronized", "pthread_mutex", "futex", "spin", "Spin"]
ALLOCATION_WORDS = ["alloc", "Alloc", "new", "New", "malloc", "calloc", "StringBuilder", "concat", "toString"]
REFLECTION_WORDS = ["reflect", "Reflect", "invoke", "Invoke", "Method.invoke", "Field.get", "Field.set", "Class.forName", "newInstance"]


def names(words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("func").contains(w)
    return hit


def _keys(functions: DataFrame) -> list[str]:
    """Where functions are of several profiles, each has suggestions of its own."""
    return [c for c in ("profile_id",) if c in functions.columns]


def _each(rule: str, functions: DataFrame, test: Column) -> DataFrame:
    return functions.where(test).select(*_keys(functions), F.lit(rule).alias("rule"), "func", F.col("self_pct").alias("value"))


def hot_functions(functions: DataFrame, above: float = 15.0) -> DataFrame:
    return _each("R01", functions, F.col("self_pct") > above)


def gc_overhead(functions: DataFrame, above: float = 5.0) -> DataFrame:
    keys = _keys(functions)
    return functions.where(names(GC_WORDS)).groupBy(*keys).agg(F.sum("self_pct").alias("value")).where(F.col("value") > above).select(*keys, F.lit("R02").alias("rule"), F.lit("").alias("func"), "value")


def lock_contention(functions: DataFrame, each: float = 1.0, above: float = 3.0) -> DataFrame:
    keys = _keys(functions)
    rows = functions.where(names(LOCK_WORDS) & (F.col("self_pct") > each))
    rows = rows.groupBy(*keys).agg(F.sum("self_pct").alias("value"), F.array_join(F.array_sort(F.collect_list("func")), ", ").alias("func"))  # under 100 functions have over 1 %
    return rows.where(F.col("value") > above).select(*keys, F.lit("R03").alias("rule"), "func", "value")


def frequent_allocation(functions: DataFrame, above: float = 5.0) -> DataFrame:
    return _each("R04", functions, names(ALLOCATION_WORDS) & (F.col("self_pct") > above))


def reflection(functions: DataFrame, above: float = 2.0) -> DataFrame:
    return _each("R05", functions, names(REFLECTION_WORDS) & (F.col("self_pct") > above))


def allocators(functions: DataFrame, above: float = 10.0) -> DataFrame:
    return _each("R06", functions, F.col("self_pct") > above)


#: Rules of a table that may be broadcast.
MOST_RULES = 10_000


def by_rule_table(functions: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """(profile_id or keys,) rule, func, value of rules kept as a table: rule, part, above, deleted (null for rules in force).

    A rule holds for functions whose name holds its part and whose share is above its bound. Up to MOST_RULES rules are
    sent to all tasks; more are dealt, and meet the distinct functions' names in blocks.
    """
    live = rules.where("deleted is null").select("rule", "part", "above")
    hit = F.col("func").contains(F.col("part")) & (F.col("self_pct") > F.col("above"))
    n = live.count()
    if n <= MOST_RULES:
        live = F.broadcast(live)
        rows = functions.join(live, hit)
    else:
        # Each block of rules meets each name once: a stated set of rules against all names.
        blocks = -(-n // MOST_RULES)
        dealt = live.withColumn("__block", F.pmod(F.xxhash64("rule", "part", "above"), F.lit(blocks)))
        names = functions.select("func").distinct().withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        held = names.join(dealt, (names["__block"] == dealt["__block"]) & F.col("func").contains(F.col("part"))).select("func", "rule", "part", "above")
        rows = functions.join(held, "func").where(F.col("self_pct") > F.col("above"))
    return rows.select(*(keys or _keys(functions)), "rule", "func", F.col("self_pct").alias("value"))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"R01": hot_functions, "R02": gc_overhead, "R03": lock_contention, "R04": frequent_allocation, "R05": reflection, "R06": allocators}
PROFILE_RULES = {"cpu": ["R01", "R02", "R03", "R05"], "alloc": ["R01", "R02", "R03", "R04", "R05", "R06"]}


def advise(functions: DataFrame, kind: str = "cpu") -> DataFrame:
    """Suggestions on ((profile_id,) func, self_pct) rows: (profile_id,) rule, func, value."""
    out = None
    for rule in PROFILE_RULES[kind]:
        rows = RULES[rule](functions)
        out = rows if out is None else out.unionByName(rows)
    return out


def heap_shares(histogram: DataFrame, first: int = 10, above: float = 10.0) -> DataFrame:
    """rule, class_name, value of the leading classes that hold more than that share of a heap, whatever its size."""
    lead = histogram.orderBy(F.desc("total_size"), "class_name").limit(first)
    return lead.where(F.col("pct") > above).select(F.lit("R07_share").alias("rule"), "class_name", F.col("pct").cast("double").alias("value"))


def advise_heap(histogram: DataFrame, first: int = 10) -> DataFrame:
    """rule, class_name, value: over the leading classes and the heap as a whole; histogram is of heap.histogram()."""
    lead = histogram.orderBy(F.desc("total_size"), "class_name").limit(first)
    c = F.col
    row = lambda rows, rule, value: rows.select(F.lit(rule).alias("rule"), "class_name", value.cast("double").alias("value"))
    whole = histogram.agg(F.sum("total_size").alias("size"), F.count("*").alias("n")).withColumn("class_name", F.lit(""))
    parts = [
        heap_shares(histogram, first),
        row(lead.where(classes.may_leak("class_name") & (c("instances") > 10_000)), "R07_collections", c("instances")),
        row(lead.where((c("class_name") == "java.lang.String") & (c("instances") > 100_000)), "R07_strings", c("instances")),
        row(lead.where(c("class_name").isin("byte[]", "char[]") & (c("total_size") > 100 << 20)), "R07_buffers", c("total_size")),
        row(whole.where(c("size") > 1 << 30), "R07_heap", c("size")),
        row(whole.where(c("n") > 50_000), "R07_classes", c("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def described(suggestions: DataFrame) -> DataFrame:
    """Suggestions with a sentence."""
    text = F.concat(F.lit("Rule "), "rule", F.when(F.col("func") != "", F.concat(F.lit(" on "), "func")).otherwise(""), F.lit(": "), format_percent("value"), F.lit(" %"))
    return suggestions.withColumn("text", text)
