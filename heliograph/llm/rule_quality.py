"""Quality classifier: tree paths become conjunctive rules over text statistics, weighted by lasso logistic regression.

Training looks at a bounded sample of labelled rows (`max_rows`), the one place where a bound is allowed. Statistics
are counted in Python tasks, on Arrow batches; the fitted rules are compiled to one Spark column over them that scores
every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WordHasher, chunks, utf8

#: Labelled rows that fit() looks at, at most, those with the least hash of doc_id.
MAX_ROWS = 12_000


#: Bytes counted for a statistic; every byte belongs to one class at most.
CLASSES = {"pipes": b"|", "symbols": b"#$%&*+<=>@[\\]^_`{}~/", "digits": b"0123456789", "stops": b".,;:!?", "capitals": bytes(range(65, 91)), "breaks": b"\n"}

#: Statistics of a text, in the order of the model's inputs: each a count over words or characters.
STATISTICS = ["log_words", "word_length", "distinct_share", "pipe_share", "symbol_share", "digit_share", "stop_share", "capital_share", "break_share"]

#: Prefix of the working columns that with_statistics() adds.
OWN = "__q_"


def text_statistics(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """A row of STATISTICS for each text of a buffer."""
    n, size = len(offsets) - 1, len(CLASSES) + 2
    kinds = np.zeros(256, np.int64)
    kinds[0x80:0xC0] = size - 1  # bytes that continue a character
    for k, chars in enumerate(CLASSES.values(), 1):
        kinds[np.frombuffer(chars, np.uint8)] = k
    text = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(text * size + kinds[data], minlength=n * size).reshape(n, size).astype(float)
    start, end, sums = hasher(data, offsets)
    owner = text[start] if len(start) else np.zeros(0, np.int64)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(44) | hasher.hashes(sums, start, end) >> np.uint64(20))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    words = np.bincount(owner, minlength=n).astype(float)
    distinct = np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)
    chars = counts.sum(1) - counts[:, -1]
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    pipes, symbols, digits, stops, capitals, breaks = counts[:, 1:-1].T
    return np.column_stack([np.log1p(words), chars / w, distinct / w, pipes / w, symbols / c, digits / c, stops / w, capitals / c, breaks / w])


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df and a column OWN + name for each of STATISTICS; null and empty texts give zeros. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part in chunks(batches, text):
            found = text_statistics(*utf8(part.column(text)), hasher)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in found.T)], [*part.schema.names, *(OWN + k for k in STATISTICS)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(OWN + k, DoubleType()) for k in STATISTICS)]))


#: A rule holds where each (statistic, is_above, threshold) holds.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleEnsemble:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The ensemble as one Spark expression over the columns of with_statistics()."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & (F.col(OWN + name) > at if above else F.col(OWN + name) <= at)
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _best_split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[float, int, float]:
    """Gain, feature and threshold of the split that lowers the squared error of g most."""
    best = (1e-9, -1, 0.0)
    total, n = g.sum(), len(g)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, left = x[order, j], np.cumsum(g[order])[:-1]
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if ok.any():
            gain = np.where(ok, left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n, -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    return best


def tree_paths(x: np.ndarray, g: np.ndarray, names: list[str], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """All paths of a regression tree on g as rules, and the tree's predictions."""
    rules: list[Rule] = []
    fitted = np.zeros(len(g))

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        gain, j, at = _best_split(x[rows], g[rows], least) if len(path) < depth and len(rows) >= 2 * least else (0.0, -1, 0.0)
        if j < 0:
            fitted[rows] = g[rows].mean() if len(rows) else 0.0
            return
        above = x[rows, j] > at
        grow(rows[~above], (*path, (names[j], False, at)))
        grow(rows[above], (*path, (names[j], True, at)))

    grow(np.arange(len(g)), ())
    return rules, fitted


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept isn't penalised."""
    n, k = r.shape
    a = np.hstack([r, np.ones((n, 1))])
    size = max(float(np.linalg.norm(a, 2)) ** 2 / (4 * n), 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        new = z - a.T @ (_sigmoid(a @ z) - y) / n / size
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - penalty / size, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return w[:k], float(w[k])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleEnsemble:
    """Boost shallow trees, turn their paths into rules, keep those that the lasso gives a weight.

    With one class only, or no rows, the ensemble is its intercept (score 0.5 without rows).
    """
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(intercept=0.0 if len(y) == 0 else 3.0 * (2 * float(y[0]) - 1))
    random = np.random.default_rng(7)
    f = np.full(len(y), math.log((y.mean()) / (1 - y.mean())))
    rules: list[Rule] = []
    for _ in range(trees):
        rows = random.permutation(len(y))[: max(20, len(y) // 2)]
        found, _ = tree_paths(x[rows], (y - _sigmoid(f))[rows], names, depth, max(3, len(rows) // 200))
        rules += found
        at = {r: i for i, r in enumerate(found)}
        value = np.zeros(len(y))
        held = holds_matrix(x, found, names)
        for r, i in at.items():
            if not any(o[: len(r)] == r and len(o) > len(r) for o in found):
                inside = held[:, i] > 0
                p = _sigmoid(f[inside])
                value[inside] = (y[inside] - p).sum() / max((p * (1 - p)).sum(), 1.0)
        f = f + 0.5 * np.clip(value, -4, 4)
    rules = list(dict.fromkeys(rules))
    if not rules:
        return RuleEnsemble(intercept=float(f[0]))
    w, b = lasso_logistic(holds_matrix(x, rules, names), y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def holds_matrix(x: np.ndarray, rules: list[Rule], names: list[str]) -> np.ndarray:
    at = {n: i for i, n in enumerate(names)}
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for name, above, t in rule:
            out[:, k] *= (x[:, at[name]] > t) == above
    return out


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents outside the held-out fold, by least hash of doc_id: doc_id, text, label.

    Null labels and ids take no part; a doc_id labelled twice counts once, with its greater label, and one that
    several documents have counts once, with the least text.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # At most max_rows ids and labels: a proven bound of 16 bytes each.
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("label"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Learn `labels.quality` from the texts' statistics; only max_rows rows of numbers reach the driver.

    Without labelled rows, or tables without rows, every score is 0.5.
    """
    rows = training_rows(documents, labels, "quality", max_rows)
    rows = with_statistics(rows).select("doc_id", "label", *(F.col(OWN + k).alias(k) for k in STATISTICS)).toPandas()
    rows = rows.sort_values(["doc_id", "label", *STATISTICS])
    return fit_rules(rows[STATISTICS].to_numpy(float), rows["label"].to_numpy(float), STATISTICS)


def score(documents: DataFrame, model: RuleEnsemble, column: str = "quality_score") -> DataFrame:
    """documents with the score (0 to 1); every text is read whole, a null or empty one has statistics of zero.

    Each row is scored for itself: repeated rows have equal scores, other columns (of whatever name) stay as they are,
    and a table without rows gives none. It is an error if documents has the score's column already.
    """
    names = documents.columns
    if column.lower() in map(str.lower, names):
        raise ValueError(f"there is a column {column} already")
    # While statistics are there, the table's own columns go by number, so that none has a statistic's name.
    plain = documents.toDF(*(f"{OWN}in_{i}" for i in range(len(names))))
    scored = with_statistics(plain, f"{OWN}in_{names.index('text')}").withColumn(OWN + "score", model.column())
    return scored.select(*(F.col(f"{OWN}in_{i}").alias(n) for i, n in enumerate(names)), F.col(OWN + "score").alias(column))
