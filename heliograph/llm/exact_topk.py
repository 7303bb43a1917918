"""Exact top-k inner products: tiles of queries x shards as matrix products, a partial selection per tile, tree merges.

Vectors are integers floor(scale * x). Products run in double precision where every partial sum stays below 2**53,
so they are exact; rows with larger components, and only these, are multiplied as Python integers. A score that no long
holds is given as the nearest long, but ranked by what it is.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
#: Vectors of a shard, and queries of a block: a tile holds SHARD x BLOCK scores, a task 256 queries of them at once.
SHARD, BLOCK = 8192, 4096
#: Lists that one merge takes together.
FAN_IN = 16
#: The least and greatest long.
LIMITS = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and vector of rows whose id is known and whose vector has finite components only, none of them null."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)


def tiles(queries: DataFrame, vectors: DataFrame, shard: int, block: int) -> tuple[DataFrame, int, int]:
    """vec_id, vector, and tile (s, b) and whether the row is a query there; how many shards and blocks.

    Each shard meets each block of queries. Shards and blocks are dealt by a number that each row has for itself, stored
    with it, so rows of one id, however many, are spread like any others, and a lost task deals them alike.
    """
    vectors, queries = (stored(x.withColumn("row", F.monotonically_increasing_id()), "numbered") for x in (vectors, queries))
    # Two counts reach the driver.
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    stored_side = vectors.select("vec_id", "vector", own(shards, 1).alias("s"), F.explode(spread(blocks)).alias("b"), F.lit(False).alias("asks"))
    asking_side = queries.select("vec_id", "vector", F.explode(spread(shards)).alias("s"), own(blocks, 2).alias("b"), F.lit(True).alias("asks"))
    return stored_side.unionByName(asking_side), shards, blocks


def tile_rows(batch: pa.Table) -> dict[bool, list[tuple[np.ndarray, np.ndarray]]]:
    """By asks: for each width of vectors, ids in ascending order and their matrix."""
    found: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {}
    asks, ids = batch["asks"].to_numpy(), batch["vec_id"].to_numpy()
    column = batch["vector"].combine_chunks()
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(widths) - widths
    for side in (False, True):
        found[side] = []
        for width in np.unique(widths):
            rows = np.flatnonzero((asks == side) & (widths == width))
            rows = rows[np.argsort(ids[rows], kind="stable")]
            found[side].append((ids[rows], flat[at[rows, None] + np.arange(width)]))
    return found


def select(scores: np.ndarray, ids: np.ndarray, k: int, whole: dict[int, int] | None = None) -> np.ndarray:
    """Places of the k greatest scores, greatest first, ties to smaller ids; ids are ascending.

    whole has the scores, by place, of those that a long doesn't hold.
    """
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, level if whole else level[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    if whole:
        return np.array(sorted(places.tolist(), key=lambda i: (-whole.get(i, int(scores[i])), ids[i]))[:k], np.int64)
    return places[np.lexsort((ids[places], -scores[places]))]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, where that is below 2**53; larger x are whole numbers, given as an infinity here."""
    with np.errstate(over="ignore"):
        found = np.floor(x * scale)
    return np.where(np.abs(x) < 2.0**53, found, np.copysign(np.inf, x))


def exact_scores(a: np.ndarray, b: np.ndarray, scale: int = 1) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """floor(scale * a) @ floor(scale * b).T, exactly: as longs, and by place those that no long holds (there the nearest one)."""
    a_whole, b_whole = integers(a, scale), integers(b, scale)
    bound = math.isqrt((2**53 - 1) // max(1, a.shape[1]))  # products of components up to it stay exact when summed
    small_a, small_b = ((np.abs(x).max(axis=1, initial=0) <= bound) for x in (a_whole, b_whole))
    with np.errstate(invalid="ignore"):
        found = np.where(small_a[:, None], a_whole, 0) @ np.where(small_b[:, None], b_whole, 0).T
    found, beyond = found.astype(np.int64), {}
    number = lambda v: math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale
    exact = lambda rows: [[number(v) for v in row] for row in rows.tolist()]
    large_a, large_b = np.flatnonzero(~small_a), np.flatnonzero(~small_b)
    for rows, columns, every in ((large_a, np.arange(len(b)), b), (np.flatnonzero(small_a), large_b, b[large_b])):
        if not len(rows) or not len(columns):
            continue
        others = exact(every)
        for i, x in zip(rows.tolist(), exact(a[rows]), strict=True):
            for j, y in zip(columns.tolist(), others, strict=True):
                score = sum(map(operator.mul, x, y))
                found[i, j] = held = max(-(1 << 63), min(score, (1 << 63) - 1))
                if held in LIMITS:
                    beyond[i, j] = score
    return found, beyond


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers given as doubles, exactly: longs, or Python integers where one isn't."""
    found, beyond = exact_scores(a, b)
    found = found.astype(object) if beyond else found
    for place, score in beyond.items():
        found[place] = score
    return found


def sortable(score: int) -> bytes:
    """Bytes that are ordered as whole numbers of any size are."""
    size = (score.bit_length() + 7) // 8
    text = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + text if score >= 0 else b"\x00" + bytes(255 - c for c in text)


def merged(lists: DataFrame, k: int, score: str = "score", whole: str | None = None) -> DataFrame:
    """The k best of each query, merging FAN_IN lists (column s) at a time, level by level; whole orders equal scores."""
    top = lists.agg(F.max("s")).head()[0] or 0
    best = [F.desc(score), *([F.desc(whole)] if whole else []), F.asc("vec_id")]
    while True:
        top //= FAN_IN
        lists = lists.withColumn("s", F.floor(F.col("s") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "s").orderBy(*best))).where(F.col("rank") <= k)
        if top == 0:
            return lists.select("query_id", "rank", "vec_id", score)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, column: str = "embedding", vec_id: str = "vec_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the greatest integer inner product with each query.

    A query never finds rows of its own id. Vectors that are null or hold null or non-finite components take no part;
    those of another width than the query's aren't compared with it. Fewer candidates than k give them all; ties go
    to smaller ids; repeated ids are candidates each, and queries of one id are ranked together. Any finite components
    take part: scores are exact, and those beyond a long are given as the least or greatest long, ranked as they are.
    Empty tables give no rows.
    """

    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = tile_rows(table)
        out: list[tuple[np.ndarray, ...]] = []
        beyond: list[bytes | None] = []
        for (ids, base), (query_ids, asked) in zip(found[False], found[True], strict=True):
            for at in range(0, len(query_ids), 256):
                products, large = exact_scores(asked[at : at + 256], base, scale)
                by_row: dict[int, dict[int, int]] = {}
                for (i, j), v in large.items():
                    by_row.setdefault(i, {})[j] = v
                for i, (q, row) in enumerate(zip(query_ids[at : at + 256].tolist(), products, strict=True)):
                    others = np.flatnonzero(ids != q)
                    whole = by_row.get(i, {})
                    near = others[select(row[others], ids[others], k, {n: whole[j] for n, j in enumerate(others.tolist()) if j in whole} if whole else None)]
                    out.append((np.full(len(near), q), ids[near], row[near]))
                    beyond += [sortable(whole[j]) if j in whole else None for j in near.tolist()] if whole else [None] * len(near)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        shard_of = pa.array(np.full(len(columns[0]), key[0].as_py()), pa.int32())
        return pa.table([pa.array(columns[0], pa.int64()), shard_of, *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array(beyond, pa.binary())], ["query_id", "s", "vec_id", "score", "whole"])

    base, asked = usable(vectors, column, vec_id), usable(queries, column, vec_id)
    lists = tiles(asked, base, shard, block)[0].groupBy("s", "b").applyInArrow(score, "query_id long, s int, vec_id long, score long, whole binary")
    return merged(stored(lists, "tiles"), k, whole="whole")
