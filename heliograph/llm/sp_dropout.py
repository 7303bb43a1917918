"""SentencePiece encoding with seeded merge dropout, and decoding.

Byte-pair merging works through an agenda of candidate merges, the best-scored first, ties to the left. With dropout
a candidate is skipped for good where a hash of (seed, document, the segment's place in it, the candidate's start,
middle and end) falls below the dropout's share; the hash is keyed, so the same seed gives the same segmentation on
every machine and in every retry. A document's key is its id and text: every occurrence of a word is cut on its own.

No merge crosses from a word into white space after it, so texts are cut into segments, (spaces, word). What is kept of
a distinct segment are the merges made without dropout: an occurrence that drops none of them has its ids, and all
others are merged anew. The agendas of all short segments to be merged advance together, a merge each a round; a long
segment's agenda is a heap, so a text of n characters without white space takes n log n steps. Both give the same.
Characters that are no piece become byte pieces, and so does the space mark itself where a text holds one; so ids
decode to the very bytes that were encoded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import WordHasher, chunks, mix, utf8
from .tokens import IdPool, worker_memory

SPACE = "▁"
DROPOUT, SEED = 0.1, 17
NONE = np.int64(1) << 62
#: Slots (by hash) of the table of pairs.
TABLE_BITS = 19
#: Characters of a segment from which its agenda is a heap.
LONG = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model as arrays: characters, merges of two pieces with their ranks, and each piece's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, plain, strict=True) if ok):
            raise ValueError("pieces with white space after a word aren't cut into segments rightly")
        self.size = n
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int64)
        # The better a piece's score, the lower its rank; equal scores share one, and then the left candidate wins.
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        found = [(ids[p[:k]] * n + ids[p[k:]], i, rank[i]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found.sort()
        self.pairs, self.merged, self.rank = (np.array(c, np.int64) for c in zip(*found, strict=True))
        self.table = self.slots()
        self.merge_of = {pair: (merged, int(r)) for pair, merged, r in found}
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def slots(self) -> np.ndarray:
        """A hash table of the pairs: their places, -1 where there is none; a taken slot's pair goes to the next one."""
        if len(self.pairs) > 1 << TABLE_BITS - 1:
            raise ValueError("the model has more merges than the table of pairs is made for")
        table = np.full(1 << TABLE_BITS, -1, np.int64)
        left, at = np.arange(len(self.pairs)), self.slot(self.pairs)
        while len(left):
            free = table[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            table[at[put]] = left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) % len(table)
        return table

    def find(self, pair: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, -1 for one that isn't there."""
        at = self.slot(pair)
        place = self.table[at]
        open_ = np.flatnonzero((place >= 0) & (self.pairs[place] != pair))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.table)
            found = self.table[at[open_]]
            place[open_] = found
            open_ = open_[(found >= 0) & (self.pairs[found] != pair[open_])]
        return place

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of pieces in a row, and the len(ids) + 1 places where pieces begin."""
        size = self.length[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        return self.raw[np.repeat(self.first[ids] - at[:-1], size) + np.arange(at[-1])], at


def dropped(keys: np.ndarray, spots: np.ndarray, dropout: float) -> np.ndarray:
    """Which of the candidates (start, middle, end as one number) segments with these keys drop."""
    return mix(keys ^ mix(spots + np.uint64(1))) < np.uint64(min(dropout, 1.0) * (2**64 - 1025))


def merge_long(vocabulary: Vocabulary, symbol: np.ndarray, key: int, dropout: float) -> tuple[list[int], list[int], list[int]]:
    """Symbols that are left of one segment's, their places, and the spots of the merges made: by a heap of candidates.

    A candidate's entry is (rank, start) as one number. It is stale unless it still is what `wanted` has for its start,
    which holds each start's candidate, or -1 for none, for one that is dropped, and for a symbol merged into another.
    """
    n, size, mask = len(symbol), vocabulary.size, (1 << 64) - 1
    share = int(np.uint64(min(dropout, 1.0) * (2**64 - 1025)))
    i = np.flatnonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
    pair = symbol[i] * size + symbol[i + 1]
    place = vocabulary.find(pair)
    hit = place >= 0
    i, place = i[hit], place[hit]
    if dropout > 0:
        a = i.astype(np.uint64)
        spot = a * np.uint64(1 << 42) ^ (a + np.uint64(1)) * np.uint64(1 << 21) ^ np.where(i + 2 < n, i + 2, 0).astype(np.uint64)
        kept = ~dropped(np.uint64(key), spot, dropout)
        i, place = i[kept], place[kept]
    order = vocabulary.rank[place] << 40 | i
    wanted, into = np.full(n + 1, -1), np.zeros(n, np.int64)
    wanted[i], into[i] = order, vocabulary.merged[place]
    heap, wanted, into, symbols = order.tolist(), wanted.tolist(), into.tolist(), symbol.tolist()
    after, before, spots = list(range(1, n + 1)), list(range(-1, n)), []
    merge_of, place_of = vocabulary.merge_of, (1 << 40) - 1
    heapq.heapify(heap)
    while heap:
        found = heapq.heappop(heap)
        x = found & place_of
        if wanted[x] != found:
            continue
        y = after[x]
        z = after[y]
        spots.append(((x << 42) ^ (y << 21) ^ (z if z < n else 0)) & mask)
        symbols[x], after[x], before[z], wanted[y] = into[x], z, x, -1
        for x in (x, before[x]):  # noqa: B020, PLW2901  the merged symbol with its right neighbour, and its left one with it
            if x < 0:
                continue
            wanted[x], y = -1, after[x]
            if y >= n or symbols[x] < 0 or symbols[y] < 0 or (made := merge_of.get(symbols[x] * size + symbols[y])) is None:
                continue
            if share:
                z = after[y]
                h = (((x << 42) ^ (y << 21) ^ (z if z < n else 0)) + 1) & mask
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
                h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
                h ^= h >> 31 ^ key
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
                h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
                if h ^ h >> 31 < share:
                    continue
            into[x] = made[0]
            wanted[x] = entry = made[1] << 40 | x
            heapq.heappush(heap, entry)
    places, x = [], 0
    while x < n:
        places.append(x)
        x = after[x]
    return [symbols[x] for x in places], places, spots


def merge_all(vocabulary: Vocabulary, chars: np.ndarray, owner: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the segments' pieces in a row, the piece count of each segment, and the same of the merges made.

    chars: code points of all segments; owner: each one's segment, ascending; keys: hash of (seed, document, place).
    """
    n = len(keys)
    symbol = vocabulary.char[chars]
    symbol = np.where(symbol < 0, -1 - chars, symbol)  # a character that is no piece never merges
    start = np.arange(len(chars))
    begin = np.searchsorted(owner, np.arange(n))
    made: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    many = np.bincount(owner, minlength=n)
    for k in np.flatnonzero(many > LONG).tolist():
        left, places, spots = merge_long(vocabulary, symbol[begin[k] : begin[k] + many[k]], int(keys[k]), dropout)
        done.append((np.full(len(left), k), begin[k] + np.array(places, np.int64), np.array(left, np.int64)))
        made.append((np.full(len(spots), k), np.array(spots, np.uint64)))
    if (many > LONG).any():
        short = ~(many > LONG)[owner]
        symbol, owner, start = symbol[short], owner[short], start[short]
    while len(symbol):
        # Rank of the merge with the next symbol; NONE where there is none, or where it is dropped.
        joined = np.zeros(len(symbol), bool)
        joined[:-1] = (owner[1:] == owner[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0)
        i = np.flatnonzero(joined)
        pair = symbol[i] * vocabulary.size + symbol[i + 1]
        place = vocabulary.find(pair)
        hit = place >= 0
        i, place = i[hit], place[hit]
        spot = np.zeros(0, np.uint64)
        if len(i):
            after = np.append(start[1:], start[-1] + 1)
            stop = np.where(i + 2 < len(start), start[np.minimum(i + 2, len(start) - 1)], -1)
            ends = np.where((i + 2 < len(owner)) & (owner[np.minimum(i + 2, len(owner) - 1)] == owner[i]), stop, -1)
            base = begin[owner[i]]
            spot = (start[i] - base).astype(np.uint64) * np.uint64(1 << 42) ^ (after[i] - base).astype(np.uint64) * np.uint64(1 << 21) ^ np.where(ends < 0, 0, ends - base).astype(np.uint64)
            if dropout > 0:
                kept = ~dropped(keys[owner[i]], spot, dropout)
                i, place, spot = i[kept], place[kept], spot[kept]
        # The best candidate of each segment: least rank, then leftmost.
        best = np.full(n, NONE)
        order = vocabulary.rank[place] * np.int64(1 << 40) + i
        np.minimum.at(best, owner[i], order)
        active = best < NONE
        idle = ~active[owner]
        if idle.any():
            done.append((owner[idle], start[idle], symbol[idle]))
        chosen = order == best[owner[i]]
        i, place = i[chosen], place[chosen]
        made.append((owner[i], spot[chosen]))
        symbol[i] = vocabulary.merged[place]
        stays = ~idle
        stays[i + 1] = False
        symbol, owner, start = symbol[stays], owner[stays], start[stays]
    if not done:
        return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(0, np.uint64), np.zeros(n, np.int64)
    whose, spots = (np.concatenate(c) for c in zip(*made, strict=True))
    spots = spots[np.argsort(whose, kind="stable")]
    owner, start, symbol = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(start, kind="stable")
    owner, symbol = owner[order], symbol[order]
    unknown = np.flatnonzero(symbol < 0)
    size = np.ones(len(symbol), np.int64)
    spelled = [(chr(-1 - c) if c != -1 - 0x10FFFF else SPACE).encode("utf-8", "surrogatepass") for c in symbol[unknown].tolist()]
    size[unknown] = [len(x) for x in spelled]
    ids = np.repeat(symbol, size)
    ids[np.repeat(symbol < 0, size)] = vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return ids.astype(np.uint32), np.bincount(owner, weights=size, minlength=n).astype(np.int64), spots, np.bincount(whose, minlength=n)


class Encoder:
    """Ids of whole texts, with dropout, and their decoding."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a share, from 0 to 1")
        self.vocabulary, self.dropout, self.seed = Vocabulary(path), dropout, seed
        # Ids and merges of segments without dropout; both pools see the same segments, so they know the same ones.
        self.hasher, self.pool, self.merges = WordHasher(fold=False), IdPool(), IdPool()

    def __call__(self, data: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 places where texts begin; doc_keys key each text's dropout."""
        size = np.diff(offsets)
        full = np.flatnonzero(size > 0)
        text = np.insert(data, offsets[:-1][full], 0x20)  # the model's leading space, of texts that aren't empty
        offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
        space, line = text == 0x20, text == 0x0A
        new = np.zeros(len(text), bool)
        new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        new[offsets[:-1][full]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(text))
        doc = np.searchsorted(offsets, start, "right") - 1
        sums = self.hasher.sums(text, start)
        words, spots = self.hasher.hashes(sums, start, end), []

        def learn(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, many, merges, made = self.encode_segments(text, start[first], end[first], words[first], 0.0)
            spots.extend((merges.view(np.uint32), 2 * made))
            return ids, many

        ids, at = self.pool.gather(words, learn)
        if self.dropout > 0 and len(start):
            merges, made = self.merges.gather(words, lambda first: (spots[0], spots[1]))
            key = mix(doc_keys ^ mix(np.uint64(self.seed & (1 << 64) - 1) + np.zeros(1, np.uint64)))
            key = mix(key[doc] + (start - offsets[doc]).astype(np.uint64) * np.uint64(WordHasher.BASE))
            whose = np.repeat(np.arange(len(start)), np.diff(made) // 2)
            again = np.unique(whose[dropped(key[whose], merges.view(np.uint64), self.dropout)])
            if len(again):
                new, many, _, _ = self.encode_segments(text, start[again], end[again], key[again], self.dropout)
                size, source = np.diff(at), at[:-1].copy()
                size[again], source[again] = many, len(ids) + np.cumsum(many) - many
                at = np.concatenate([[0], np.cumsum(size)])
                ids = np.concatenate([ids, new])[np.repeat(source - at[:-1], size) + np.arange(at[-1])]
        return ids, at[np.searchsorted(start, offsets)]

    def encode_segments(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = end - start
        at = np.cumsum(size) - size
        raw = text[np.repeat(start - at, size) + np.arange(size.sum())]
        leads = (raw < 0x80) | (raw >= 0xC0)
        owner = np.repeat(np.arange(len(start)), size)[leads]
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        # The mark stands for spaces; a mark in the text is no piece, so that it comes back as itself.
        chars = np.where(chars == ord(SPACE), 0x10FFFF, np.where(chars == 0x20, ord(SPACE), chars))
        return merge_all(self.vocabulary, chars, owner, keys, dropout)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the n + 1 places where texts begin; the leading space is taken off."""
        raw, place = self.vocabulary.spell(ids)
        offsets = place[at]
        first = offsets[:-1][np.diff(offsets) > 0]
        leading = first[raw[first] == 0x20]
        offsets = offsets - np.searchsorted(leading, offsets, "left")
        return np.delete(raw, leading), offsets


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, ids_crc32, lossless of every row of docs; no shuffle.

    lossless says that the ids, decoded, are the text's bytes. A null or empty text has no ids. Repeated ids are rows
    of their own; a null id is a key like any other. Only rows of equal id and text are cut alike.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(("pieces", model, dropout, seed), lambda: Encoder(model, dropout, seed))
        for part in chunks(batches, text):
            data, offsets = utf8(part.column(text))
            keys = np.array([xxhash.xxh3_64_intdigest(str(x).encode(), zlib.crc32(data[a:b])) for x, a, b in zip(part.column(doc_id).to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False)], np.uint64)
            ids, at = coder(data, offsets, keys)
            back, ends = coder.decode(ids, at)
            same = [bool(np.array_equal(back[a:b], data[c:d])) for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:], strict=False)]
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(doc_id), lists, pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_tokens", "ids_crc32", "lossless"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the column text, decoded from ids; null ids give the empty text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_memory(("pieces", model), lambda: Encoder(model))
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            raw, ends = coder.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), at)
            whole = raw.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(text, StringType())]))
