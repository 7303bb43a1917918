"""Best-fit packing, planned on the histogram of lengths: documents only learn their places, by rank within length.

The plan sees counts of at most `capacity` lengths, whatever the number of documents. Documents are ranked within
(length, salt), so that a length that most documents share is ranked by many tasks. The salt is drawn by a number that
each piece has for itself, stored with it: pieces of one row that is repeated are spread like any others.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, partitions, stored, utf8
from .tokens import WordEncoder, default_tokenizer, worker_memory

CAPACITY = 4096
END_ID = 1

#: Runs of the plan that may be broadcast (about 40 bytes each); beyond that Spark joins them by shuffling.
BROADCAST_RUNS = 200_000

#: length, rank_from, rank_to, first_sequence, each (items of this length in one sequence), place (of the first one)
Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts: the items of a length fill, run by run, the fullest open sequences they fit."""
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}  # open sequences by room: (first, how many)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, many))

    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, many = capacity, opened, math.ceil(left / (capacity // length))
                opened += many
            each = room // length
            full = min(many, left // each)
            rest = min(left - full * each, each - 1) if full < many else 0
            for start, sequences, items in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if sequences:
                    n = sequences * items
                    runs.append((length, rank, rank + n, start, items, capacity - room))
                    put(room - items * length, start, sequences)
                    rank, left = rank + n, left - n
            put(room, first + full + bool(rest), many - full - bool(rest))
    return runs


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end id, cut after every `capacity` ids.

    A null or empty text is the end id alone. Every row of docs gives its own pieces, repeated ids included.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memory(("words", tokenizer), lambda: WordEncoder(tokenizer))
        for part in chunks(batches, text):
            ids, at = encode(*utf8(part.column(text)))
            whole = np.insert(ids.astype("<u4"), at[1:], end_id)  # each text's end id goes behind its ids
            at = at + np.arange(len(at))
            size = np.diff(at)
            many = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, size[owner] - start)
            first = at[:-1][owner] + start
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(doc_id).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """items with sequence_id and offset: sequences of at most capacity, each gapless from 0.

    items is stored with numbers of its rows, and read three times. Lengths have to be from 1 to capacity.
    """
    spark, names = items.sparkSession, items.columns
    items = stored(items.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    # At most `capacity` rows reach the driver.
    counts = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths have to be from 1 to {capacity}")
    runs = spark.createDataFrame(found := plan(counts, capacity), "run_length long, rank_from long, rank_to long, first_sequence long, each long, place long")
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(max(64, partitions(spark)))).cast("int"))
    rank = F.row_number().over(Window.partitionBy(length, "__salt").orderBy(*keys, "__row")) - 1
    before = F.sum("__n").over(Window.partitionBy(length).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    first = salted.groupBy(length, "__salt").agg(F.count("*").alias("__n")).select(length, "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", rank).join(first, [length, "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    if len(found) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    within = F.col("__rank") - F.col("rank_from")
    return ranked.join(runs, (F.col(length) == F.col("run_length")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to"))).select(
        *names,
        (F.col("first_sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("place") + within % F.col("each") * F.col(length)).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document of docs.

    Texts are tokenized once: the pieces' table, without texts or ids, goes to the shared folder.
    """
    return pack(pieces(docs, capacity, tokenizer), capacity)
