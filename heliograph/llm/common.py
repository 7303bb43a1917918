"""Helpers shared by the training-data operators: tables, shared storage, Arrow text buffers, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task looks at together; a longer document is taken alone, whole.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master that names none, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps don't redo it, and a lost executor doesn't lose it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_in_place(fs: pafs.FileSystem, made: str, name: str) -> None:
    """Give a whole file its name, unless another attempt of the task has: then its bytes are there already.

    Renames onto a file that exists fail on some file systems, so none is tried.
    """
    there = lambda: fs.get_file_info(name).type != pafs.FileType.NotFound
    if not there():
        try:
            return fs.move(made, name)
        except OSError:
            if not there():
                raise
    fs.delete_file(made)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it a name that no column of df has."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of about CHUNK_BYTES of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """62-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of texts, for a whole buffer at once; A-Z lower-cased if fold.

    A word's hash is sum(code(byte) * base ** place) modulo 2 ** 31 - 1 for two bases with codes of their own, from
    differences of prefix sums, then mixed. Modulo a prime two words of n bytes are alike by chance about (n / 2 ** 31)
    ** 2; modulo 2 ** 64 there are words that collide for every base.
    """

    PRIME = np.uint64((1 << 31) - 1)
    BASES = (0x5DEECE66, 0x2545F491)
    #: Spreads places for keys of other kinds.
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, fold: bool = True) -> None:
        self.codes = [self.reduced(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.BASE ^ base))) for base in self.BASES]
        for codes in self.codes:
            if fold:
                codes[65:91] = codes[97:123]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.up = [np.ones(1, np.uint64) for _ in self.BASES]
        self.down = [np.ones(1, np.uint64) for _ in self.BASES]

    @classmethod
    def once(cls, x: np.ndarray) -> np.ndarray:
        """x below 2 ** 62 to less than 2 ** 32, the same modulo PRIME."""
        return (x & cls.PRIME) + (x >> np.uint64(31))

    @classmethod
    def reduced(cls, x: np.ndarray) -> np.ndarray:
        x = cls.once(cls.once(x))
        return np.where(x >= cls.PRIME, x - cls.PRIME, x)

    def prepare(self, most: int) -> None:
        """Powers up to a word's greatest place."""
        for k, base in enumerate(self.BASES):
            for table, step in ((self.up, base), (self.down, pow(base, -1, int(self.PRIME)))):
                while len(table[k]) <= most:
                    table[k] = np.concatenate([table[k], self.reduced(table[k] * np.uint64(pow(step, len(table[k]), int(self.PRIME))))])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Start, end and the prefix sums of all words; see hashes()."""
        space = self.space[data]
        first = np.ones(len(data), bool)
        first[1:] = space[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        last = np.ones(len(data), bool)
        last[:-1] = space[1:]
        ends = offsets[1:][offsets[1:] > 0]
        last[ends - 1] = True
        word = ~space
        start = np.flatnonzero(first & word)
        return start, np.flatnonzero(last & word) + 1, self.sums(data, start, word)

    def sums(self, data: np.ndarray, start: np.ndarray, inside: np.ndarray | None = None) -> tuple:
        """Places of bytes in the words that begin at start, and prefix sums; bytes not inside words count for nothing."""
        begin = np.zeros(len(data), np.int64)
        begin[start] = start
        place = np.arange(len(data)) - np.maximum.accumulate(begin)
        if inside is not None:
            place *= inside
        self.prepare(int(place.max(initial=0)))
        found = []
        for codes, up in zip(self.codes, self.up, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.once(codes[data] * up[place]), out=sums[1:])
            found.append(sums)
        return place, *found

    def hashes(self, sums: tuple, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the parts of words from start to end."""
        place, *found = sums
        at = place[start]
        both = [self.reduced(self.reduced(x[end] - x[start]) * down[at]) for x, down in zip(found, self.down, strict=True)]
        return mix(both[0] << np.uint64(31) | both[1])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the least node reachable.

    In each round a node goes to its least neighbour, and on to that one's; edges then link the nodes gone to, so that
    they shrink from round to round until none is left. Every round is written to the shared folder. No edge, label
    or component passes through the driver: it only sees whether edges are left.
    """
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x <> y").distinct()
    left, labels = stored(ordered(edges, a, b), "edges"), None
    while True:
        both = left.select(F.col("x").alias("node"), "y").unionByName(left.select(F.col("y").alias("node"), F.col("x").alias("y")))
        near = stored(both.groupBy("node").agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("up")), "near")
        gone = stored(near.join(near.select(F.col("node").alias("mid"), F.col("up").alias("to")), F.col("up") == F.col("mid")).select("node", "to"), "gone")
        if labels is None:
            labels = gone.select("node", F.col("to").alias("component"))
        else:
            step = gone.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        x, y = (gone.select(F.col("node").alias(k), F.col("to").alias(k + "_to")) for k in ("x", "y"))
        left = stored(ordered(left.join(x, "x").join(y, "y"), "x_to", "y_to"), "edges")
        if left.isEmpty():
            return labels
