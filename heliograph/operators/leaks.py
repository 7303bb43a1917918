"""Growth between snapshots of a profile, its severity, and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fn

MIB = 1 << 20
#: Severities by kind of profile; growth per cent at most, and growth a minute below.
SEVERITIES = {
    "heap": [("none", 5, MIB), ("low", 20, 10 * MIB), ("medium", 50, 50 * MIB), ("high", 100, 100 * MIB)],
    "goroutine": [("none", 5, 10), ("low", 20, 50), ("medium", 50, 100), ("high", 100, 500)],
}
#: What to do about growth, by severity.
ADVICE = {
    "none": "No sign of a leak.",
    "low": "Watch the growth over a longer time.",
    "medium": "Look at the functions that grow most.",
    "high": "Examine the growing functions soon; compare further snapshots.",
    "critical": "Act now: memory or goroutines may run out.",
}


def by_leaf(stacks: DataFrame) -> DataFrame:
    """func, value, sample_stack of (stack, value): the least stack stands for the others of its leaf."""
    return stacks.groupBy(fn.leaf("stack").alias("func")).agg(F.sum("value").alias("value"), F.min(fn.stack_to_string("stack")).alias("sample_stack"))


def growth(baseline: DataFrame, current: DataFrame, seconds: float, n: int = 50) -> DataFrame:
    """func, baseline, current, growth, growth_pct, rate, sample_stack of functions that grew, the largest n first.

    A function new in the current snapshot grew by 100 per cent. Without a positive time a second is taken.
    """
    seconds = seconds if seconds > 0 else 1.0
    a = by_leaf(baseline).select("func", F.col("value").alias("a"))
    b = by_leaf(current).select("func", F.col("value").alias("b"), "sample_stack")
    rows = a.join(b, "func", "full").select("func", F.coalesce("a", F.lit(0)).alias("baseline"), F.coalesce("b", F.lit(0)).alias("current"), "sample_stack")
    rows = rows.withColumn("growth", F.col("current") - F.col("baseline")).where("growth > 0")
    share = F.when(F.col("baseline") > 0, F.col("growth") / F.col("baseline") * 100).otherwise(100.0)
    rows = rows.select("func", "baseline", "current", "growth", share.alias("growth_pct"), (F.col("growth") / F.lit(seconds)).alias("rate"), "sample_stack")
    return rows.orderBy(F.desc("growth"), "func").limit(n) if n > 0 else rows


def any_stack(functions: DataFrame, stacks: DataFrame) -> DataFrame:
    """functions (func) with sample_stack: the least stack of (stack) that ends in the function, else that it stands in.

    Stacks are exploded once to their distinct functions, so this is a grouped equi-join, not a search in every stack.
    """
    inside = stacks.select(fn.stack_to_string("stack").alias("text"), F.explode(F.array_distinct("stack")).alias("func"), fn.leaf("stack").alias("leaf"))
    wanted = inside.join(functions.select("func").distinct(), "func", "left_semi")
    best = wanted.groupBy("func").agg(F.min(F.struct((F.col("func") != F.col("leaf")).alias("inner"), "text")).alias("best"))
    return functions.join(best.select("func", F.col("best.text").alias("sample_stack")), "func", "left")


def of_kind(reports: DataFrame, kind: str | None = None) -> DataFrame:
    """Reports of one kind (column kind), of all without; an unknown kind has none."""
    return reports if not kind else reports.where(F.col("kind") == kind.strip().lower())


def severity(kind: str, growth_pct: Column, per_minute: Column) -> Column:
    """The first severity both of whose bounds hold; a shrinking profile is `none`."""
    rows = SEVERITIES["goroutine" if kind == "goroutine" else "heap"]
    out = None
    for name, pct, rate in rows:
        out = (F if out is None else out).when((growth_pct <= pct) & (per_minute < rate), name)
    return out.otherwise("critical")


def report(baseline: DataFrame, current: DataFrame, kind: str, seconds: float) -> DataFrame:
    """baseline_total, current_total, growth, growth_pct, per_minute, severity, advice: one row."""
    seconds = seconds if seconds > 0 else 1.0
    total = lambda df, name: df.agg(F.coalesce(F.sum("value"), F.lit(0)).alias(name))
    rows = total(baseline, "baseline_total").crossJoin(total(current, "current_total")).withColumn("growth", F.col("current_total") - F.col("baseline_total"))  # a row each
    rows = rows.withColumn("growth_pct", F.when(F.col("baseline_total") > 0, F.col("growth") / F.col("baseline_total") * 100).otherwise(0.0))
    rows = rows.withColumn("per_minute", F.col("growth") / F.lit(seconds) * 60)
    rows = rows.withColumn("severity", severity(kind, F.col("growth_pct"), F.col("per_minute")))
    advice = F.create_map(*(F.lit(x) for p in ADVICE.items() for x in p))
    return rows.withColumn("advice", F.element_at(advice, F.col("severity")))


def trend(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("captured_at").agg(F.sum("value").alias("total"), F.count("*").alias("stacks"))
