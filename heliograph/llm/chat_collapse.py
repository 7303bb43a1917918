"""Cumulative-snapshot collapse of logged conversations, and chat rendering: DataFrame functions only.

A chat log often holds a conversation again after every turn. Each conversation's turns get rolling prefix hashes; a
conversation whose whole hash is a proper prefix of a longer one's is a snapshot of that one. Anti-joins keep the
maximal conversations, one of each group of equal ones, and only those are rendered.

Turns are sorted by range over all conversations, so one that has a third of all turns is hashed by as many tasks as it
has turns for: each rolls over its own turns, and what the tasks before it come to is joined to them. A rendered
conversation is one text, so the rendering alone is one row's work for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

START, END = "<|im_start|>", "<|im_end|>"


def within_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the columns of parts, which has a row for each conversation and part."""
    named = parts.withColumnsRenamed({"conv_id": "__conv", "part": "__part"})
    here = (F.col("part") == F.col("__part")) & F.col("conv_id").eqNullSafe(F.col("__conv"))
    return rows.join(named, here).drop("__conv", "__part")


def earlier(total: Column) -> Column:
    """What a conversation's parts before come to."""
    return F.coalesce(total.over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, pos (from 1), n (turns in all), role, text: parts are what one task of a range sort has of a conversation.

    Turns of equal number are ordered by role and text. Turns without conv_id are a conversation of their own. A turn
    that is repeated is as many turns; the sort can cut between them.
    """
    named = [F.col(c).alias(a) for c, a in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))]
    order = ["conv_id", "turn", "role", "text", "row"]
    dealt = turns.select(*named).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(dealt.drop("row").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.min("at").alias("first"))
    shift = F.col("first") - earlier(F.sum("turns")) - 1
    places = parts.select("conv_id", "part", F.sum("turns").over(Window.partitionBy("conv_id")).alias("n"), shift.alias("shift"))
    return within_parts(rows, places).select("conv_id", "part", (F.col("at") - F.col("shift")).cast("int").alias("pos"), "n", "role", "text")


def rolled(rows: DataFrame) -> DataFrame:
    """conv_id, pos, n, role, text, h1, h2 of numbered(): two hashes of the turns up to pos.

    A turn's hash is keyed by its position, role and text, null told apart from empty; a prefix's is their exclusive
    or, so it rolls on in one pass over a part's turns from what the parts before come to.
    """
    own = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "pos", *own) for i in (1, 2)})
    sums = rows.groupBy("conv_id", "part").agg(*(F.bit_xor(f"h{i}").alias(f"h{i}") for i in (1, 2)))
    before = sums.select("conv_id", "part", *(earlier(F.bit_xor(f"h{i}")).alias(f"before{i}") for i in (1, 2)))
    here = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = within_parts(rows.withColumns({f"h{i}": F.bit_xor(f"h{i}").over(here) for i in (1, 2)}), before)
    return rows.select("conv_id", "pos", "n", "role", "text", *(F.col(f"h{i}").bitwiseXOR(F.col(f"before{i}")).alias(f"h{i}") for i in (1, 2)))


def prefix_hashes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), n (turns in all), role, text, h1, h2: two hashes of the turns up to pos; see rolled()."""
    return rolled(numbered(turns, conv_id, turn, role, text))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n, copies: the least id of each different conversation that no longer one continues; how often it was logged.

    Equal conversations and equal prefixes are grouped before they are joined, so neither a conversation nor a first
    turn that a third of the log shares makes a large group.
    """
    whole = prefixes.where("pos = n").groupBy(F.col("n").alias("pos"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = prefixes.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(begun, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n"), "copies")


def quoted(text: Column) -> Column:
    """Text in which no marker of the chat format can stand."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<|_im_"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered of (conv_id, n, copies, pos, role, text): one text a conversation."""
    line = F.concat(F.lit(START), quoted(F.col("role")), F.lit("\n"), quoted(F.col("text")), F.lit(END + "\n"))
    grouped = conversations.groupBy("conv_id", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", F.col("n").alias("n_turns"), "copies", F.array_join("lines.line", "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations of a log (conv_id, turn, role, text), rendered: conv_id, n_turns, copies, rendered.

    Null roles and texts are rendered as empty. An empty log gives no rows.
    """
    rows = numbered(turns)
    prefixes = stored(rolled(rows).select("conv_id", "pos", "n", "h1", "h2"), "prefixes")
    kept = maximal(prefixes).withColumnRenamed("conv_id", "__kept")
    return render(rows.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("__kept"))).drop("__kept"))
