"""Approximate nearest neighbours by 2-stable projections: few projected dimensions, a kd-tree, a chi-square stop.

Every row is indexed. A shard's vectors are projected to M dimensions by Gaussian vectors; the squared projected
distance of two rows, divided by their squared true distance, is chi-square with M degrees of freedom. A kd-tree over
the projections gives a query's neighbours in ascending order of projected distance: a heap holds the nodes met but
not entered, each with its cell's distance from the query, and the nearest is entered or, if it is a leaf, its points
are verified on the original vectors, a few leaves at a time. The search of a shard stops once the nearest node's
distance r and the k-th best true distance d so far satisfy chi2_M(r**2 / d**2) >= stop: a row nearer than d would then
lie within r with that probability.

Largest inner products become nearest neighbours by one more dimension, sqrt(R**2 - |x|**2) for rows and 0 for
queries, with R the greatest norm of the shard. Shards and queries are scaled by their greatest components first, so
that no finite vector's square overflows; scores are the inner products of the original vectors.

A task builds a shard's index once and searches it for a block of queries that stream by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exact_topk import merged, tiles, usable

M = 10
LEAF, BUSH = 16, 32
STOP = 0.97
SEED = 20
#: Rows of a shard, and queries that one index of it serves.
SHARD, BLOCK = 32768, 8192
#: Leaves verified before the stopping test is made first; each time after that a quarter more, MOST_LEAVES at most.
FIRST_LEAVES, MOST_LEAVES = 16, 256


def chi_square(x: np.ndarray | float, m: int = M):
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x) / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stop_ratio(stop: float = STOP, m: int = M) -> float:
    """The least r**2 / d**2 at which the stopping test holds."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < stop else (low, mid)
    return high


class KdTree:
    """A kd-tree over points: inner nodes with the axis and place of their cut, above leaves with their boxes' corners.

    Nodes of BUSH leaves at most are the lowest that are entered one by one; their leaves are met together.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.axis, self.cut, self.children, self.bush, self.leaves = [], [], [], [], []
        self.low, self.high = points.min(0).tolist(), points.max(0).tolist()
        parts, most = [(-1, np.arange(len(points)))], leaf * BUSH
        while parts:
            parent, rows = parts.pop()
            node = len(self.axis)
            if parent >= 0:
                self.children[parent].append(node)
            axis, lower, upper = self.halves(points, rows)
            self.axis.append(axis)
            self.children.append([])
            if len(rows) <= most or lower is None:
                self.cut.append(0.0)
                self.bush.append((len(self.leaves), self.plant(points, rows, leaf)))
                continue
            self.cut.append(float(points[upper, axis].min()))
            self.bush.append(None)
            # The part below the cut comes off the stack first, so it is the first child.
            parts += [(node, upper), (node, lower)]
        self.least = np.array([points[r].min(0) for r in self.leaves])
        self.most = np.array([points[r].max(0) for r in self.leaves])

    @staticmethod
    def halves(points: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray | None]:
        """The axis in which rows spread most, and its lower and upper half; none of rows that are all alike."""
        spread = np.ptp(points[rows], axis=0)
        axis, half = int(np.argmax(spread)), len(rows) // 2
        if not spread[axis]:
            return axis, None, None
        order = np.argpartition(points[rows, axis], half)
        return axis, rows[order[:half]], rows[order[half:]]

    def plant(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Append the leaves of a part; where they end."""
        parts = [rows]
        while parts:
            rows = parts.pop()
            _, lower, upper = self.halves(points, rows) if len(rows) > leaf else (0, None, None)
            if lower is None:
                self.leaves += [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
            else:
                parts += [upper, lower]
        return len(self.leaves)

    def nearest(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves and the squared distances of their boxes, nearest first, as many at a time as are known to be next.

        A node is entered only when leaves are asked for that can lie in it.
        """
        z = q.tolist()
        apart = [max(0.0, a - x, x - b) for x, a, b in zip(z, self.low, self.high, strict=True)]
        heap = [(sum(x * x for x in apart), 0, apart)]
        met, far_of = np.zeros(0, np.int64), np.zeros(0)
        while heap:
            far, node, apart = heapq.heappop(heap)
            if self.bush[node] is None:
                axis = self.axis[node]
                past = z[axis] - self.cut[node]
                near, other = self.children[node] if past < 0 else self.children[node][::-1]
                heapq.heappush(heap, (far, near, apart))
                # The other side's cell is at least as far as the cut in this axis, and as far as this cell in others.
                own = apart[axis]
                further = max(own, abs(past))
                apart = apart.copy()
                apart[axis] = further
                heapq.heappush(heap, (far + further * further - own * own, other, apart))
                continue
            a, b = self.bush[node]
            box = (np.maximum(0, np.maximum(self.least[a:b] - q, q - self.most[a:b])) ** 2).sum(1)
            met, far_of = np.concatenate([met, np.arange(a, b)]), np.concatenate([far_of, box])
            ready = far_of <= heap[0][0] if heap else np.ones(len(met), bool)
            if ready.any():
                order = np.argsort(far_of[ready], kind="stable")
                yield met[ready][order], far_of[ready][order]
                met, far_of = met[~ready], far_of[~ready]


def inner(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """points @ x in double precision; where it overflows, an infinity of the true product's sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = points @ x
        odd = np.flatnonzero(~np.isfinite(found))
        if len(odd):
            a, b = np.abs(points[odd]).max(1), np.abs(x).max()
            found[odd] = ((points[odd] / a[:, None]) @ (x / b)) * a * b
    return found


class Shard:
    """Index of a shard's vectors of one width.

    Equal vectors are one point of the tree. Of its rows those stay that a query can need, whatever its own id: k rows
    at most of each of the k + 1 least ids.
    """

    def __init__(self, ids: np.ndarray, base: np.ndarray, k: int, m: int, leaf: int) -> None:
        points, owner = np.unique(base, axis=0, return_inverse=True)
        order = np.lexsort((ids, owner.ravel()))
        owner, ids = owner.ravel()[order], ids[order]
        fresh = np.ones(len(ids), bool)  # the first row of an id at its point
        fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
        place = np.arange(len(ids))
        of_id = place - np.maximum.accumulate(np.where(fresh, place, 0))
        begin = np.searchsorted(owner, np.arange(len(points)))
        nth_id = np.cumsum(fresh) - np.cumsum(fresh)[begin][owner]
        kept = (nth_id <= k) & (of_id < k)
        owner, self.ids = owner[kept], ids[kept]
        self.first = np.searchsorted(owner, np.arange(len(points) + 1))
        self.points, self.k, self.m = points, k, m
        self.largest = np.abs(points).max()
        # Where the shard's vectors are of one scale, the original ones are searched; else a scaled copy.
        self.even = 2.0**-400 < self.largest < 2.0**400
        self.scale = 1.0 if self.even else self.largest
        self.scaled = points if self.even else points / self.scale
        norms = (self.scaled**2).sum(1)
        self.radius = norms.max()
        self.axes = np.random.default_rng(SEED).standard_normal((points.shape[1] + 1, m))
        self.projected = self.scaled @ self.axes[:-1] + np.sqrt(np.maximum(self.radius - norms, 0))[:, None] * self.axes[-1]
        self.tree = KdTree(self.projected, leaf)
        self.verified = 0

    def search(self, q: int, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k nearest found, nearest first."""
        largest = np.abs(x).max()
        # A query of another scale than the shard's has the same nearest rows when it is scaled.
        y = x if self.even and 2.0**-400 < largest < 2.0**400 else x / largest
        z, reach = y @ self.axes[:-1], self.radius + y @ y  # squared distance = reach - 2 * inner product
        best, dots = (np.zeros(0, np.int64), np.zeros(0)), np.zeros(0)
        limit, step = np.inf, FIRST_LEAVES
        waiting: list[int] = []

        def check() -> None:
            nonlocal best, dots, limit, step
            best, dots = self.verify(q, x, y, np.concatenate([self.tree.leaves[i] for i in waiting]), best, dots)
            waiting.clear()
            step = min(step + -(-step // 4), MOST_LEAVES)
            if len(best[0]) == self.k:
                nearest = max(reach - 2 * dots[-1], 0.0)
                limit = ratio * nearest if nearest else np.nextafter(0, 1)

        for leaves, far in self.tree.nearest(z):
            at = 0
            while at < len(leaves) and far[at] < limit:
                some = leaves[at : at + step - len(waiting)]
                waiting += some.tolist()
                at += len(some)
                if len(waiting) >= step:
                    check()
            if at < len(leaves):
                break
        if waiting:
            check()
        return best

    def verify(self, q: int, x: np.ndarray, y: np.ndarray, rows: np.ndarray, best: tuple[np.ndarray, np.ndarray], dots: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The best with these points: ids and scores on the original vectors, and the scaled inner products."""
        self.verified += len(rows)
        new = inner(self.points[rows], x)
        if len(best[0]) == self.k:
            rows, new = rows[new >= best[1][-1]], new[new >= best[1][-1]]
        scaled = new if y is x and self.even else self.scaled[rows] @ y
        times = self.first[rows + 1] - self.first[rows]
        place = np.repeat(self.first[rows] - np.cumsum(times) + times, times) + np.arange(times.sum())
        others = self.ids[place] != q
        found, scores = np.concatenate([best[0], self.ids[place][others]]), np.concatenate([best[1], np.repeat(new, times)[others]])
        dots = np.concatenate([dots, np.repeat(scaled, times)[others]])
        order = np.lexsort((found, -scores))[: self.k]
        return (found[order], scores[order]), np.sort(dots)[::-1][: self.k]


def search_shard(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int, stop: float, m: int, leaf: int) -> list[tuple[np.ndarray, ...]]:
    """(query_id repeated, vec_id, score) lists of each query's best in a shard."""
    shard, ratio = Shard(ids, base, k, m, leaf), stop_ratio(stop, m)
    found = [(q, *shard.search(q, x, ratio)) for q, x in zip(query_ids.tolist(), asked, strict=True)]
    return [(np.full(len(got), q), got, scores) for q, got, scores in found]


def by_width(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of the batch's vectors of each width above 0."""
    ids, column = batch.column("vec_id").to_numpy(), batch.column("vector")
    widths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(widths) - widths
    return {int(w): (ids[rows], flat[at[rows, None] + np.arange(w)]) for w in np.unique(widths) if w for rows in [np.flatnonzero(widths == w)]}


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, stop: float = STOP, m: int = M, leaf: int = LEAF, column: str = "embedding", vec_id: str = "vec_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (inner product in double precision): the k nearest found for each query.

    Vectors that are null, zero or hold null or non-finite components take no part; those of another width than the
    query's aren't compared with it. A query never finds rows of its own id; ties go to smaller ids. Repeated ids are
    candidates each; queries of one id are ranked together. Scores that overflow are infinite and tie. Empty tables give
    no rows.
    """
    if m < 2 or m % 2:
        raise ValueError("m has to be even")
    ratio = stop_ratio(stop, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile, a tile's vectors before its queries."""
        tile, held, index = None, {}, {}
        for batch in batches:
            s, b, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "b", "asks"))
            key = s.astype(np.int64) << 32 | b
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True) if batch.num_rows else ():
                if key[i] != tile:
                    tile, held, index = key[i], {}, {}
                for width, (ids, rows) in by_width(batch.slice(i, j - i)).items():
                    if not asks[i]:
                        held.setdefault(width, []).append((ids, rows))
                        continue
                    if width in held:
                        index[width] = Shard(*(np.concatenate(c) for c in zip(*held.pop(width), strict=True)), k, m, leaf)
                    if width in index:
                        found = [(np.full(len(got), q), got, scores) for q, x in zip(ids.tolist(), rows, strict=True) for got, scores in [index[width].search(q, x, ratio)]]
                        query, got, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.full(len(got), s[i]), pa.int32()), pa.array(got, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "s", "vec_id", "score"])

    some = F.exists("vector", lambda x: x != 0)
    base, asked = usable(vectors, column, vec_id).where(some), usable(queries, column, vec_id).where(some)
    dealt, shards, blocks = tiles(asked, base, shard, block)
    rows = dealt.repartitionById(shards * blocks, F.col("s") * blocks + F.col("b")).sortWithinPartitions("s", "b", "asks")
    return merged(stored(rows.mapInArrow(run, "query_id long, s int, vec_id long, score double"), "lists"), k)
