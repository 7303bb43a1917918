"""Breadth-first searches from many targets at once: a node has one row with a bit for each target, not a row for each.

Targets are numbered; 64 of them are a word, and up to WORDS words a block. A level's rows are (block, node, name) with
words of bits, combined by `bit_or`, partly before they are shuffled. So a level has at most as many rows as nodes and
fields, for each block, where a row for each (target, node) would be up to BITS times as many. Where a node is met by
few targets of a block, most of a row's words would be empty: then blocks have one word (`words_for`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .ranks import ranked
from .trees import TABLES, few, renamed

WORDS = 16
BITS = 64 * WORDS
NAMES = [f"w{k}" for k in range(WORDS)]
#: Blocks of BITS targets that tell how full rows are, and the bytes of a row beside its words, about.
LOOKED_AT, BESIDE = 16, 40


def numbered(targets: DataFrame, *order: str) -> DataFrame:
    """targets (obj_id, ...), each id once, with number: those that are near in `order` are of one block."""
    rows = ranked(targets.withColumn("__all", F.lit(0)), ["__all"], [*(F.col(c) for c in order), F.col("obj_id")])
    return stored(rows.select(*targets.columns, F.col("pos").alias("number")), "numbered")


def _words_of(rows: DataFrame) -> list[str]:
    return [w for w in NAMES if w in rows.columns]


def _or(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in _words_of(rows)))


def _some(words: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [w != 0 for w in words])


def _set(numbers: DataFrame, words: int, *keys: Column) -> DataFrame:
    """block, keys and words: the bit of each number, not combined."""
    spot = F.col("number") % (64 * words)
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    return numbers.select(F.floor(F.col("number") / (64 * words)).alias("block"), *keys, *(F.when(F.floor(spot / 64) == k, bit).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(NAMES[:words])))


def words_for(links: DataFrame, numbers: DataFrame) -> int:
    """Words of a block, 1 or WORDS: with which the first level of some blocks, evenly spread, takes fewer bytes.

    Results are the same with any number of words.
    """
    blocks = (numbers.agg(F.max("number")).head()[0] or 0) // BITS + 1
    block = F.floor(F.col("number") / BITS)
    # The first and then evenly spread ones: LOOKED_AT * BITS targets at most, whatever there are.
    some = numbers.where((block % -(-blocks // LOOKED_AT)) == 0).select(F.col("obj_id").alias("to_id"), "number")
    met = links.join(F.broadcast(some), "to_id").select("from_id", F.floor(F.col("number") / 64).alias("word")).distinct()
    full = met.groupBy("from_id", F.floor(F.col("word") / WORDS).alias("block")).agg(F.count("*").alias("n"))
    short, long = full.agg(F.sum("n"), F.count("*")).head()
    return 1 if (short or 0) * (8 + BESIDE) < long * (8 * WORDS + BESIDE) else WORDS


def search(links: DataFrame, numbers: DataFrame, max_depth: int, stop: Column | None = None, done: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """block, node, class_name, field, depth and words: which targets meet a node first at this depth, and over which field.

    links is (from_id, to_id, field, class_name of from_id), kept by to_id, so that a level shuffles what it has reached
    and not all references again. A target meets a node once, over the least field
    of the references that lead to it. A search goes no further from nodes of which stop holds (over class_name), nor
    for the targets (number) that done(found so far) gives.
    """
    words = words_for(links, numbers)
    names = NAMES[:words]
    # A reference's class and field as one number, in order of fields; so rows that are shuffled hold no text.
    pairs = links.select("class_name", "field").distinct().withColumn("__all", F.lit(0))
    pairs = stored(ranked(pairs, ["__all"], [F.asc("field"), F.asc("class_name")]).select(F.col("class_name").alias("__class"), F.col("field").alias("__field"), F.col("pos").alias("name")), "names")
    coded = links.join(few(pairs), F.col("class_name").eqNullSafe(F.col("__class")) & F.col("field").eqNullSafe(F.col("__field"))).select("from_id", "to_id", "name")
    called = pairs.select("name", F.col("__class").alias("class_name"), F.col("__field").alias("field"))
    frontier = seen = stored(_or(_set(numbers, words, F.col("obj_id").alias("node")), "block", "node"), "seen")
    found = None
    for depth in range(1, max_depth + 1):
        reached = coded.join(renamed(frontier, to_id="node", block="block", **{w: w for w in names}), "to_id").select("block", F.col("from_id").alias("node"), "name", *names)
        # What a node has been met by stands before its names: of those the least has a target first. So what is new
        # is what no row before has. A node's names are those of one object.
        before = seen.select("block", "node", F.lit(-1).cast("long").alias("name"), *names)
        earlier = Window.partitionBy("block", "node").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(w).over(earlier), F.lit(0).cast("long")))).alias(w) for w in names]
        rows = _or(reached.unionByName(before), "block", "node", "name").select("block", "node", "name", *fresh).where("name >= 0")
        step = stored(rows.where(_some([F.col(w) for w in names])), "met")
        if step.isEmpty():
            break
        told = step.join(called, "name").select("block", "node", "class_name", "field", F.lit(depth).alias("depth"), *names)
        found = told if found is None else found.unionByName(told)
        if depth == max_depth:
            break
        seen = seen.unionByName(step.select("block", "node", *names))
        seen = seen if depth % TABLES else stored(seen, "seen")
        onward = step if stop is None else told.where(~stop)
        if done is None and stop is None:
            frontier = step.select("block", "node", *names)  # the next level combines what it leads to
            continue
        frontier = _or(onward, "block", "node")
        if done is not None:
            ended = _or(_set(done(found), words), "block").select("block", *(F.col(w).alias(f"ended_{w}") for w in names))
            left = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"ended_{w}", F.lit(0).cast("long")))).alias(w) for w in names]
            frontier = frontier.join(ended, "block", "left").select("block", "node", *left).where(_some([F.col(w) for w in names]))
        frontier = stored(frontier, "frontier")
    if found is None:
        return links.sparkSession.createDataFrame([], f"block long, node long, class_name string, field string, depth int, {', '.join(f'{w} long' for w in names)}")
    return found


def targets_of(rows: DataFrame, *keys: str) -> DataFrame:
    """number and keys, once each: the targets whose bits are set in rows of those keys."""
    by, names = _or(rows, "block", *keys), _words_of(rows)
    words = by.select("block", *keys, F.posexplode(F.array(*names)).alias("__word", "__bits")).where("__bits <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("__bits", i) == 1)
    one = words.select("block", *keys, "__word", F.explode(places).alias("__place"))
    return one.select((F.col("block") * (64 * len(names)) + F.col("__word") * 64 + F.col("__place")).alias("number"), *keys)
