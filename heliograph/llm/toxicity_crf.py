"""Toxicity: a linear-chain conditional random field over words, with states plain and toxic.

Only documents carry labels, so words are labelled first: `lexicon` counts, over the training sample, in how many
toxic and plain documents each word stands, and takes those that stand in toxic ones far beyond chance. A word of a
toxic document that is in the lexicon is a toxic token, every other word a plain one. `fit` trains the field on
these token sequences by gradient descent on the conditional likelihood (forward-backward, as in scoring). Features
of a word are itself, its first four and last three characters, hashed to tables; transitions are weighted too.

A text's chains are its sentences, whole, however long. The marginals of its words sum to an expected count
of toxic words, from which, with the greatest marginal, a logistic layer makes the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import WordHasher, chunks, stored, utf8
from .rule_quality import training_rows

#: Labelled rows that fit() looks at, at most, those with the least hash of doc_id.
MAX_ROWS = 12_000
#: Documents whose tokens train the field, at most as many of either label.
MAX_TOKEN_ROWS = 700
#: Logarithm of the likelihood ratio that makes a word of the lexicon.
EVIDENCE = 9.0
#: Step sizes of the feature tables: a word itself says more than its ends.
RATES = {"word": 0.3, "head": 0.08, "tail": 0.04}
#: Bytes of the texts whose tokens train the field, at most: whole texts in the sample's order, as many as fit.
MAX_TOKEN_BYTES = 8 << 20
#: Words of a chain that forward-backward takes in one go; longer chains are taken piece by piece, with the same result.
PIECE = 64
#: Entries of each feature table.
TABLE = 1 << 18
#: Marginal from which on a word is reported as offending.
OFFENDS = 0.5


@dataclass
class Field:
    """Weights of the chain: per table entry a score of toxic over plain, and 2 x 2 transitions; the document's layer."""

    words: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    bias: float
    transitions: np.ndarray
    layer: tuple[float, float, float]


class Tokens:
    """Words of a buffer as features and chains. Non-letters at a word's end or start don't count as its characters."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.edge = np.zeros(256, bool)
        self.edge[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
        self.stop = np.zeros(256, bool)
        self.stop[[ord(c) for c in ".!?"]] = True
        self.starts = np.ones(256, bool)
        self.starts[0x80:0xC0] = False

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        start, end, sums = self.hasher(data, offsets)
        last = self.stop[data[end - 1]]
        doc = np.searchsorted(offsets, start, "right") - 1
        inner = np.concatenate([np.flatnonzero(~self.edge[data]), [len(data)]])
        a, z = inner[np.searchsorted(inner, start)], inner[np.searchsorted(inner, end) - 1] + 1
        bare = a >= end  # nothing but such characters: they are the word
        a, b = np.where(bare, start, a), np.where(bare, end, z)
        # Places of the first 4 and last 3 characters, by counting the bytes that begin one.
        count = np.concatenate([[0], np.cumsum(self.starts[data])])
        places = np.concatenate([np.flatnonzero(self.starts[data]), [len(data)]])
        head = np.minimum(places[np.minimum(count[a] + 4, len(places) - 1)], b)
        tail = np.maximum(places[np.maximum(count[b] - 3, 0)], a)
        h = lambda x, y, salt: self.hasher.hashes(sums, x, y) ^ np.uint64(salt)
        entry = lambda x: (x >> np.uint64(40)).astype(np.int64) % TABLE
        word = h(a, b, 0)
        # A chain begins with a document and after a sentence's end.
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | last[:-1]
        return {"doc": doc, "start": a, "end": b, "hash": word, "word": entry(word), "head": entry(h(a, head, 0x5EED)), "tail": entry(h(tail, b, 0x7A11)), "new": new}


class Pieces:
    """Chains cut into pieces of PIECE words, laid out so that all pieces take each step together, longest first."""

    def __init__(self, new: np.ndarray) -> None:
        n = len(new)
        head = np.flatnonzero(new)
        run = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        self.first = np.flatnonzero(run % PIECE == 0)
        self.size = np.diff(np.append(self.first, n))
        self.nth = run[self.first] // PIECE  # which piece of its chain
        self.goes_on = np.append(self.nth[1:] > 0, False)  # its chain has another piece

    def steps(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each step from the second word on, which of these pieces take it, and their words."""
        some = some[np.argsort(-self.size[some], kind="stable")]
        live = np.searchsorted(-self.size[some], -np.arange(1, PIECE + 1), "right")
        for i in range(1, PIECE):
            if not live[i]:
                return
            yield some[: live[i]], self.first[some[: live[i]]] + i


def _even(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(emission: np.ndarray, new: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word, and of every pair of neighbours in a chain P of the four state pairs, by forward-backward.

    A piece that isn't its chain's first turns the message it gets into the one it gives by a 2 x 2 matrix, so the
    messages at pieces' ends come first, and then all pieces run forward and backward at once: a chain of n words
    takes about 2 * PIECE + n / PIECE steps. Messages are kept as probabilities, so none under- or overflows.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    p = Pieces(new)
    every, later = np.arange(len(p.first)), np.flatnonzero(p.nth > 0)
    potential = np.exp(np.clip(np.column_stack([-emission / 2, emission / 2]), -30, 30))
    t = np.exp(transitions)
    # What comes into a piece: from the left before its first word, from the right behind its last one.
    left, right = np.ones((len(every), 2)), np.full((len(every), 2), 0.5)
    if len(later):
        through = np.zeros((len(every), 2, 2))
        through[later] = t * potential[p.first[later]][:, None, :]
        for some, at in p.steps(later):
            m = (through[some] @ t) * potential[at][:, None, :]
            through[some] = m / m.sum((1, 2), keepdims=True)
        start = np.flatnonzero(p.goes_on & (p.nth == 0))
        out = np.zeros((len(every), 2))
        out[start] = _even(potential[p.first[start]])
        for some, at in p.steps(start):
            out[some] = _even((out[some] @ t) * potential[at])
        order = later[np.argsort(p.nth[later], kind="stable")]
        cuts = np.flatnonzero(np.diff(p.nth[order])) + 1
        rounds = np.split(order, cuts)
        for some in rounds:
            left[some] = out[some - 1] @ t
            out[some] = _even((out[some - 1][:, None, :] @ through[some])[:, 0])
        for some in reversed(rounds):
            right[some - 1] = _even((through[some] @ right[some][:, :, None])[:, :, 0])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[p.first] = _even(left * potential[p.first])
    backward[p.first + p.size - 1] = right
    for _, at in p.steps(every):
        forward[at] = _even((forward[at - 1] @ t) * potential[at])
    for _, at in reversed(list(p.steps(every))):
        backward[at - 1] = _even((backward[at] * potential[at]) @ t.T)
    both = forward * backward
    single = both[:, 1] / both.sum(1)
    inner = np.flatnonzero(~new)
    pair = forward[inner - 1][:, :, None] * t * (backward[inner] * potential[inner])[:, None, :]
    return single, pair / pair.sum((1, 2), keepdims=True)


def lexicon(counted: DataFrame, share: float) -> DataFrame:
    """The words of (word, bad, many) whose documents, `many`, are toxic (`bad` of them) far beyond the share of all.

    A likelihood ratio of e**EVIDENCE is asked for: among a hundred thousand words few reach it by chance.
    """
    bad, many = F.col("bad"), F.col("many")
    rate = bad / many
    plain = F.when(bad < many, (many - bad) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    return counted.where((bad > 0) & (rate >= 0.7) & (bad * F.log(rate / share) + plain >= EVIDENCE)).select("word")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(t: dict[str, np.ndarray], gold: np.ndarray, steps: int = 60, rate: float = 1.0, decay: float = 1e-6) -> Field:
    """Adagrad on the mean log-likelihood of the token labels `gold` (bool) given the words."""
    tables = {k: np.zeros(TABLE) for k in ("word", "head", "tail")}
    bias, transitions = -4.0, np.zeros((2, 2))
    past = {k: np.full(TABLE, 1e-8) for k in tables}
    past_b, past_t = 1e-8, np.full((2, 2), 1e-8)
    inner = np.flatnonzero(~t["new"])
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[inner - 1].astype(int), gold[inner].astype(int)), 1)
    total = max(1, len(gold))
    for _ in range(steps):
        emission = bias + sum(tables[k][t[k]] for k in tables)
        p, pairs = marginals(emission, t["new"], transitions)
        error = gold - p
        for k in tables:
            g = np.bincount(t[k], weights=error, minlength=TABLE) / total - decay * tables[k]
            past[k] += g * g
            tables[k] += RATES[k] * rate * g / np.sqrt(past[k])
        g = error.sum() / total
        past_b += g * g
        bias += 0.1 * rate * g / np.sqrt(past_b)
        g = (seen - pairs.sum(0)) / total
        past_t += g * g
        transitions = transitions + 0.1 * rate * g / np.sqrt(past_t)
    return Field(tables["word"], tables["head"], tables["tail"], bias, transitions, (0.0, 0.0, 0.0))


def summed(t: dict[str, np.ndarray], field: Field, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected count of toxic words and greatest marginal of each of n texts, and all marginals."""
    p, _ = marginals(field.bias + field.words[t["word"]] + field.heads[t["head"]] + field.tails[t["tail"]], t["new"], field.transitions)
    most = np.zeros(n)
    np.maximum.at(most, t["doc"], p)
    return np.bincount(t["doc"], weights=p, minlength=n), most, p


def _tokens_of(texts: list[str | None]) -> tuple[dict[str, np.ndarray], int]:
    return Tokens()(*utf8(pa.array(texts, pa.string()))), len(texts)


def _token_rows(rows: DataFrame, max_token_rows: int) -> list[tuple]:
    """(doc_id, label, text) of whole texts, max_token_rows of either label and MAX_TOKEN_BYTES in all at most."""
    own = F.xxhash64("doc_id")
    sizes = [
        rows.where(F.col("label") > 0 if side else F.col("label") <= 0).select("doc_id", own.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy("h", "doc_id").limit(max_token_rows).collect()
        for side in (True, False)
    ]
    wanted: set = set()
    for side in sizes:
        left = MAX_TOKEN_BYTES // 2
        for r in side:
            if r["bytes"] <= left:
                left -= r["bytes"]
                wanted.add(r.doc_id)
    return sorted((r.doc_id, r.label, r.text or "") for r in rows.where(F.col("doc_id").isin(list(wanted))).collect())


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_token_rows: int = MAX_TOKEN_ROWS) -> Field:
    """Learn from at most max_rows labelled documents; without a toxic or a plain one scores are 0.5.

    Tasks count the words' documents; the lexicon, and MAX_TOKEN_BYTES of whole texts at most, reach the driver. Empty
    tables give the scores of no labels.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for part in chunks(batches):
            t = tokens(*utf8(part.column("text")))
            at = np.searchsorted(t["doc"], np.arange(part.num_rows + 1))
            h = [np.unique(t["hash"][a:b]).view(np.int64) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "label", "words"])

    rows = stored(training_rows(documents, labels, "toxic", max_rows), "sample")
    both = rows.groupBy("label").count().collect()
    toxic, plain = (sum(r["count"] for r in both if (r["label"] > 0) == side) for side in (True, False))
    empty = Field(np.zeros(TABLE), np.zeros(TABLE), np.zeros(TABLE), 0.0, np.zeros((2, 2)), (0.0, 0.0, 0.0))
    if not toxic or not plain:
        return empty
    share = toxic / (toxic + plain)
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(words, f"doc_id {kind}, label double, words array<long>").select("label", F.explode("words").alias("word"))
    counted = counted.groupBy("word").agg(F.sum("label").cast("long").alias("bad"), F.count("*").alias("many"))
    words_found = np.sort(lexicon(counted, share).toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    some = _token_rows(rows, max_token_rows)
    t, n = _tokens_of([r[2] for r in some])
    label = np.array([r[1] > 0 for r in some])
    inside = np.zeros(len(t["hash"]), bool)
    if len(words_found):
        inside = words_found[np.minimum(np.searchsorted(words_found, t["hash"]), len(words_found) - 1)] == t["hash"]
    field = train(t, inside & label[t["doc"]])
    count, most, _ = summed(t, field, n)
    x = np.column_stack([np.log1p(count), most, np.ones(n)])
    w = np.zeros(3)
    weight = np.where(label, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))  # to the sample's shares
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(hessian, x.T @ (weight * (label - p)) - 0.05 * w)
    field.layer = tuple(float(v) for v in w)
    return field


def score(docs: DataFrame, field: Field, text: str = "text", column: str = "toxicity", spans: str | None = None) -> DataFrame:
    """docs with the score (0 to 1), and with spans a column of offending stretches: start, end (characters), p.

    Texts are scored whole; null and empty ones have no words, and so the least score. Each row is scored for itself:
    repeated rows have equal scores, and a table without rows gives none. It is an error if docs has a column of the
    score's or the spans' name. No shuffle.
    """
    for name in (column, spans):
        if name and name.lower() in map(str.lower, docs.columns):
            raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(field)  # three tables of TABLE numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, field = Tokens(), shared.value
        for part in chunks(batches, text):
            data, offsets = utf8(part.column(text))
            t = tokens(data, offsets)
            count, most, p = summed(t, field, part.num_rows)
            a, b, c = field.layer
            columns = [*part.columns, pa.array(_sigmoid(a * np.log1p(count) + b * most + c))]
            names = [*part.schema.names, column]
            if spans:
                columns.append(_spans(data, offsets, t, p))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [*docs.schema.fields, StructField(column, DoubleType())]
    if spans:
        span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("p", DoubleType())])
        fields.append(StructField(spans, ArrayType(span)))
    return docs.mapInArrow(run, StructType(fields))


def _spans(data: np.ndarray, offsets: np.ndarray, t: dict[str, np.ndarray], p: np.ndarray) -> pa.Array:
    """For each text the runs of neighbouring words with a marginal of OFFENDS or more."""
    bad = np.flatnonzero(p >= OFFENDS)
    begins = np.concatenate([[0], np.cumsum((data < 0x80) | (data >= 0xC0))])
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    before = -2
    for i in bad.tolist():
        doc = int(t["doc"][i])
        base = begins[offsets[doc]]
        start, end = int(begins[t["start"][i]] - base), int(begins[t["end"][i]] - base)
        if i == before + 1 and out[doc] and not t["new"][i]:
            out[doc][-1]["end"] = end
            out[doc][-1]["p"] = max(out[doc][-1]["p"], float(p[i]))
        else:
            out[doc].append({"start": start, "end": end, "p": float(p[i])})
        before = i
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))
