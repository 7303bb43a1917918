"""Spelling variants by a symmetric-delete join: words near each other share a single deletion, or one is the other's.

Every word emits itself and its distinct single deletions, each with the place of the deletion. Keys are hashes that a
word's prefix sums give for all its deletions at once, so a word of a million letters costs a million rows, not as
many copies of itself. Equi-joins on shared keys find the candidates:
  * a word that is a deletion of another one: one letter less;
  * words that share a deletion at the same place: one letter replaced. Those with another place differ in two.
A key and place have 90 words at most, one for each letter that can stand there, whatever the data; a word is a deletion
of at most 90 a place. Candidates are verified to be exactly one edit apart on the words themselves, so no hash
decides a result.

Each word's form is an aggregate over its near words; forms' forms are joined until roots no longer change, twice as
far each round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Of (document, run) pairs one in ALTERED loses a letter.
ALTERED = 97
LEAST_LETTERS, LEAST_COUNT, DOMINANCE = 5, 3, 2
#: Distinct words that a task counts before it passes counts on.
COUNTED = 1_000_000
#: Letters whose deletions are hashed together.
LETTERS = 1 << 19

#: Latin-1 code points: letters of a run keep their value, A-Z lower-cased; all others are spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

PRIME, BASES = np.uint64((1 << 31) - 1), (0x2545F491, 0x5DEECE66)


def altered(word: bytes, start: int, altered_share: int = ALTERED) -> bytes:
    """The word (Latin-1) as it is counted in a document; start is the crc32 of the document's id and a colon."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % altered_share:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counts(docs: DataFrame, altered_share: int = ALTERED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all runs of letters of docs, summed in the tasks first, so a frequent word is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for x, whole in zip(batch.column(doc_id).to_pylist(), batch.column(text), strict=True):
                if not whole.is_valid:
                    continue
                words = Counter(whole.as_py().encode("latin-1", "replace").translate(FOLD).split())
                if x is None:
                    total.update(words)
                else:
                    start = zlib.crc32(f"{x}:".encode())
                    for w, n in words.items():
                        total[altered(w, start, altered_share)] += n
                if len(total) >= COUNTED:
                    yield flush()
        yield flush()

    return docs.select(doc_id, text).mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Deleter:
    """Hashes of words and of all their single deletions, modulo 2 ** 31 - 1 to two bases, from prefix sums."""

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.uint64) for _ in BASES]

    @staticmethod
    def reduced(x: np.ndarray) -> np.ndarray:
        x = (x & PRIME) + (x >> np.uint64(31))
        x = (x & PRIME) + (x >> np.uint64(31))
        return np.where(x >= PRIME, x - PRIME, x)

    def prepare(self, n: int) -> None:
        for k, base in enumerate(BASES):
            p = self.powers[k]
            while len(p) <= n:
                p = np.concatenate([p, self.reduced(p * np.uint64(pow(base, len(p), int(PRIME))))])
            self.powers[k] = p

    def __call__(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words (letters in a row, and the len + 1 places where words begin): their hashes, and those without each letter.

        A word's hash is that of its letters c as sum(c * base ** (letters behind)), so that words of other lengths
        differ, and with them the deletions.
        """
        size = np.diff(at)
        self.prepare(int(size.max(initial=0)) + 1)
        owner = np.repeat(np.arange(len(size)), size)
        start, end = at[:-1][owner], at[1:][owner]
        whole, without = np.zeros(len(size), np.uint64), np.zeros(len(code), np.uint64)
        place = np.arange(len(code))
        for p in self.powers:
            behind = end - 1 - place
            # Terms of the letters in place, and of those before, which stand one place further right without a letter.
            here, nearer = self.reduced(code * p[behind]), self.reduced(code * p[np.maximum(behind - 1, 0)])
            right = np.concatenate([np.zeros(1, np.uint64), np.cumsum(here)])
            left = np.concatenate([np.zeros(1, np.uint64), np.cumsum(nearer)])
            whole = (whole << np.uint64(31)) | self.reduced(right[at[1:]] - right[at[:-1]])
            rest = self.reduced(self.reduced(left[place] - left[start]) + self.reduced(right[end] - right[place + 1]))
            without = (without << np.uint64(31)) | rest
        return whole, without


def deletions(words: DataFrame) -> DataFrame:
    """key, place, distinct, id: of each word (id, word) its own key at place -1, and its deletions at their places.

    distinct marks the word itself and the first of equal deletions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Deleter()
        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            ids = batch.column("id").to_numpy()
            sizes = np.array([len(w) for w in raw], np.int64)
            group = (np.cumsum(sizes) - sizes) // LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(raw)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                code = np.frombuffer(b"".join(raw[a:b]), np.uint8).astype(np.uint64)
                at = np.concatenate([[0], np.cumsum(sizes[a:b])])
                whole, without = hasher(code, at)
                first = np.ones(len(code), bool)
                first[1:] = code[1:] != code[:-1]
                first[at[:-1]] = True
                place = np.arange(len(code)) - np.repeat(at[:-1], sizes[a:b])
                columns = [
                    np.concatenate([whole, without]).view(np.int64),
                    np.concatenate([np.full(b - a, -1), place]).astype(np.int32),
                    np.concatenate([np.ones(b - a, bool), first]),
                    np.concatenate([ids[a:b], np.repeat(ids[a:b], sizes[a:b])]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "place", "distinct", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, place int, distinct boolean, id long")


def near_words(words: DataFrame) -> DataFrame:
    """a, b (ids, a < b) of all pairs of distinct words (id, word) that are one insertion, deletion or replacement apart."""
    keys = stored(deletions(words), "deletions")
    whole = keys.where("place < 0").select("key", F.col("id").alias("a"))
    shorter = whole.join(keys.where("place >= 0 and distinct").select("key", F.col("id").alias("b")), "key").where("a <> b")
    at = keys.where("place >= 0")
    replaced = at.select("key", "place", F.col("id").alias("a")).join(at.select("key", "place", F.col("id").alias("b")), ["key", "place"]).where("a < b")
    pairs = shorter.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(replaced.select("a", "b")).distinct()
    spelled = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"))
    return pairs.join(spelled("a"), "a").join(spelled("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the last of the chain of forms (id, form) of each word that has one. Chains have no circles.

    Each round joins what the reached word reaches, so it goes twice as far as the one before.
    """
    reached = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = stored(reached.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return reached


def variants(
    docs: DataFrame, altered_share: int = ALTERED, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, dominance: int = DOMINANCE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of docs with enough letters and occurrences.

    A null text has no runs. Without a doc_id no run is altered. Repeated rows count each. Of near words equally
    frequent the first in code-point order is the form. An empty table gives no rows; other columns aren't read.
    """
    counted = counts(docs, altered_share, doc_id, text).where((F.length("word") >= letters) & (F.col("n") >= least))
    words = stored(stored(counted, "counted").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other", "b")).alias("best")
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    strong = form_n >= dominance * F.col("n")
    formed = words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(strong, c).alias(k) for c, k in ((F.col("best.other"), "form"), (form_n, "form_n"), (F.col("best.b"), "form_id")))
    )
    formed = stored(formed, "forms")
    last = roots(formed.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
