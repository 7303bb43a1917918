"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie.

Two sorted arrays of fingerprints are two tries: a node is the range of those that share a prefix. Node pairs are
traversed together from the roots; a pair has as many differing bits as its prefixes, and is dropped once these are
more than the budget. Pairs of few fingerprints are compared outright.

The trie's upper part is cut into cells of at most `most` fingerprints, deeper where fingerprints crowd together. The
join of the cells, by the same traversal, says which cells can hold links. Each such pair of cells belongs to one of
the two: its task holds its own cell and has the other one's fingerprints stream by. A task returns a spanning forest
of the links that it finds, so a crowd of fingerprints all near each other gives no more rows than it has members.

Equal fingerprints are one; their documents are joined again at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored

WORDS, SEED, BUDGET = 3, 42, 2
BITS = 64
#: Fingerprints of a cell: an equal share of 2 ** CELL_BITS cells, LEAST at least. So the cells don't grow with the data.
CELL_BITS, LEAST = 14, 256
#: Bits by which a crowded cell is cut.
STEP = 4
#: Node pairs that a traversal looks at together, and fingerprint pairs below which a node pair is compared outright.
FRONTIER, OUTRIGHT = 1 << 17, 32
#: Bytes of a text that are split into words together; cut at white space, whole words and shingles are kept.
PIECE_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")

U = np.uint64


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, repeats included, in pieces; fewer words are one shingle, none give none."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            found = SPACE.search(text, end)
            end = found.start() if found else len(text)
        held += text[at:end].lower().split()
        at = end
        if (n := len(held) - words + 1) > 0:
            yield np.fromiter(map(digest, map(b" ".join, zip(*(held[i:] for i in range(words)), strict=False))), U, n)
            some = True
            del held[:n]
    if held and not some:
        yield np.array([digest(b" ".join(held))], U)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row of docs; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
            fps = [fingerprint(x.as_py(), words, seed) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(np.array(fps, U).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray, deep_a: np.ndarray, deep_b: np.ndarray, budget: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in a and b whose common prefix differs in at most `budget` bits; with same, b is a and i < j.

    a and b are ascending; an element is known to deep bits, and no element is another's prefix. Whole fingerprints
    are 64 deep.
    """
    if not len(a) or not len(b):
        return
    one = np.zeros(1, np.int64)
    stack = [(0, one, one + len(a), one, one + len(b), one)]
    while stack:
        level, al, ah, bl, bh, differ = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(level, *(x[:half] for x in (al, ah, bl, bh, differ))), (level, *(x[half:] for x in (al, ah, bl, bh, differ)))]
            continue
        na, nb = ah - al, bh - bl
        ended = ((na == 1) & (deep_a[al] <= level)) | ((nb == 1) & (deep_b[bl] <= level))
        outright = ended | (na * nb <= OUTRIGHT)
        if outright.any():
            many = (na * nb)[outright]
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(nb[outright], many)
            i, j = np.repeat(al[outright], many) + k // wide, np.repeat(bl[outright], many) + k % wide
            depth = np.minimum(deep_a[i], deep_b[j])
            apart = np.bitwise_count(np.where(depth > 0, (a[i] ^ b[j]) >> (U(BITS) - np.maximum(depth, 1).astype(U)), U(0)))
            kept = apart <= budget
            if same:
                kept &= i < j
            if kept.any():
                yield i[kept], j[kept]
        al, ah, bl, bh, differ = (x[~outright] for x in (al, ah, bl, bh, differ))
        if not len(al):
            continue
        bit = U(1) << U(BITS - 1 - level)
        above = ~((bit << U(1)) - U(1)) if level else U(0)
        am, bm = np.searchsorted(a, (a[al] & above) | bit), np.searchsorted(b, (b[bl] & above) | bit)
        mirrored = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        sides = [(al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)]
        children = []
        for k, (cl, ch, dl, dh, more) in enumerate(sides):
            lives = (cl < ch) & (dl < dh) & (differ + more <= budget)
            if k == 3:
                lives &= ~mirrored  # the same pairs as those of the third, the other way round
            children.append(tuple(x[lives] for x in (cl, ch, dl, dh, differ + more)))
        stack.append((level + 1, *(np.concatenate(c) for c in zip(*children, strict=True))))


def forest(lead: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each node is connected with by the links (i, j); lead has it for the links before, and is reused."""
    while True:
        x, y = lead[i], lead[j]
        apart = x != y
        if not apart.any():
            return lead
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(lead, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = lead[lead]
            if (further == lead).all():
                break
            lead = further


def cells(fps: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First fingerprint and depth of the trie's cells, ascending: the shortest prefixes that at most `most` share.

    Each round counts the children of crowded nodes, of which there are n / most at most; nothing else reaches the driver.
    """
    starts, depths = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    spark, depth, crowded = fps.sparkSession, 0, np.zeros(1 if n > most else 0, U)
    if n <= most:
        return np.zeros(1, U), np.zeros(1, np.int64)
    while len(crowded):
        inside = fps
        if depth:
            nodes = spark.createDataFrame(pa.table({"__node": pa.array(crowded.view(np.int64))}))
            inside = fps.join(F.broadcast(nodes), F.shiftrightunsigned("fp", BITS - depth) == F.col("__node"), "left_semi")
        depth = depth + STEP if depth else min(12, BITS)
        found = inside.groupBy(F.shiftrightunsigned("fp", BITS - depth).alias("node")).count().toArrow()
        node, count = found["node"].to_numpy().view(U), found["count"].to_numpy()
        full = (count > most) & (depth < BITS)
        starts.append(node[~full] << U(BITS - depth))
        depths.append(np.full((~full).sum(), depth))
        crowded = node[full]
    start, deep = np.concatenate(starts), np.concatenate(depths)
    order = np.argsort(start)
    return start[order], deep[order]


def homes(start: np.ndarray, deep: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, the cells whose tasks its fingerprints go to: places in the second array, and that array."""
    own = np.arange(len(start))
    found = [(own, own), *near_pairs(start, start, deep, deep, budget, same=True)]
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    # Of two cells, that of even sum's first or odd sum's second is home, so that homes have about as many guests.
    turned = (i + j) % 2 == 1
    guest, home = np.where(turned, i, j), np.where(turned, j, i)
    order = np.lexsort((home, guest))
    return np.searchsorted(guest[order], np.arange(len(start) + 1)), home[order].astype(np.int32)


def links(fps: DataFrame, budget: int = BUDGET, most: int | None = None) -> DataFrame:
    """a, b (fp): enough pairs of the distinct fingerprints fps that differ in at most budget bits to connect all that do."""
    spark = fps.sparkSession
    n = fps.count()
    start, deep = cells(fps, n, most or max(LEAST, n >> CELL_BITS))
    shared = spark.sparkContext.broadcast((start, *homes(start, deep, budget)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, at, home = shared.value
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            cell = np.searchsorted(start, fp.view(U), "right") - 1
            many = at[cell + 1] - at[cell]
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            to = home[np.repeat(at[cell], many) + k]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(to != np.repeat(cell, many)), pa.array(np.repeat(fp, many))], ["home", "guest", "fp"])

    def rows_of(values: np.ndarray, lead: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values[lead[kept]].view(np.int64)), pa.array(values[kept].view(np.int64))], ["a", "b"])

    def joined(own: np.ndarray, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        deep = lambda x: np.full(len(x), BITS)
        return near_pairs(own, own if other is None else other, deep(own), deep(own if other is None else other), budget, same=other is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by home, its own fingerprints before its guests."""
        at, parts, own, lead = None, [], np.zeros(0, U), np.zeros(0, np.int64)

        def settle() -> Iterator[pa.RecordBatch]:
            """The links between the home's own fingerprints, once all have come."""
            nonlocal own, lead
            if parts:
                own = np.sort(np.concatenate(parts))
                lead = np.arange(len(own))
                for i, j in joined(own):
                    lead = forest(lead, i, j)
                parts.clear()
                yield rows_of(own, lead, lead != np.arange(len(own)))

        for batch in batches:
            home, guest, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "guest", "fp"))
            cuts = np.flatnonzero((home[1:] != home[:-1]) | (guest[1:] != guest[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(home)], strict=True) if len(home) else ():
                if home[i] != at:
                    yield from settle()
                    at, own, lead = home[i], np.zeros(0, U), np.zeros(0, np.int64)
                if not guest[i]:
                    parts.append(fp[i:j].view(U))
                    continue
                yield from settle()
                guests = np.sort(fp[i:j].view(U))
                before = np.concatenate([lead, len(own) + np.arange(len(guests))])
                after = before.copy()
                for x, y in joined(own, guests):
                    after = forest(after, x, y + len(own))
                yield rows_of(np.concatenate([own, guests]), after, after != before)
                lead = after[: len(own)]  # own ones come first, so none is led by a guest
        yield from settle()

    dealt = fps.mapInArrow(sent, "home int, guest boolean, fp long").repartition(max(partitions(spark), 1), "home").sortWithinPartitions("home", "guest")
    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, words: int = WORDS, seed: int = SEED, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """doc_id, fp (long), component_id (the least doc_id reachable by links) of every row of docs.

    A text of fewer words than a shingle is one shingle; one without words, empty or null, has fingerprint 0 and links
    like any other. Repeated rows are rows each. A null doc_id is never the least of several: component_id is null only
    where no document of a class has an id. An empty table gives no rows; other columns aren't read.
    """
    every = stored(fingerprints(docs, words, seed, doc_id, text), "fingerprints")
    first = stored(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(stored(links(first.select("fp"), budget, most), "links"))
    of_class = first.join(linked, first.fp == linked.node)
    named = linked.join(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("node").alias("fp"), "component_id")
    by_fp = stored(first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return every.join(by_fp, "fp").select("doc_id", "fp", "component_id")
