"""Shared helpers: batches of text, word and shingle hashing, stashed tables, connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch; texts are long, so batches stay small.
ARROW_ROWS = 512

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only in local mode where that is unset."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="tessella-"))
    return own


class Stash:
    """A table written to the shared folder, so that its lineage ends there."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.path = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        release(spark)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def int_keyed(df: DataFrame, key: str, *others: str) -> DataFrame:
    """Only the columns an operator needs, so that further columns of any name do no harm."""
    return df.select(F.col(key).cast("long").alias(key), *others)


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the whole row in one column, so that its other columns can have any name."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def with_text(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a ``wrapped`` frame with its text in place of theirs; n_chars follows."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about max_bytes; a single longer row is a piece of its own."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, math.floor(rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Maximal runs of characters other than space, tab to carriage return; lower folds A-Z only.

    The split of bytes uses exactly those six characters and the fold of bytes exactly those letters.
    """
    if not text:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if lower else raw).split()


#: Bytes hashed at a time, but for a longer word.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\v\f\r")] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to 0 .. n - 1 modulo 2**64; remembered, as n is bounded by the pieces that are hashed at a time."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held)
    return held[:n]


class Sums:
    """Hashes of runs of values: a polynomial of the run, from sums over the whole sequence."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start])


class Words:
    """The words of a column of texts: ``hashes``, ``starts`` and ``ends`` in the texts' bytes, and ``bounds`` of each text in them.

    Words are maximal runs of bytes other than space and tab to carriage return; lower folds A-Z. A null text has none.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        values = _VALUES[_FOLDED] if lower else _VALUES
        starts, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        at, last = int(offsets[0]), int(offsets[-1])
        while at < last:
            to = min(last, at + PIECE)
            while to < last and not (cut := np.flatnonzero(_SPACES[self.bytes[at:to]])).size:
                to = min(last, to + PIECE)  # a word longer than a piece
            if to < last:
                to = at + int(cut[-1]) + 1
            own = self.bytes[at:to]
            solid = np.zeros(len(own) + 2, np.int8)
            solid[1:-1] = ~_SPACES[own]
            turn = np.diff(solid)
            begins = np.flatnonzero(turn == 1)
            edges = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at  # texts that begin in a word cut it
            edges = np.unique(edges[(solid[edges] == 1) & (solid[edges + 1] == 1)]) if len(edges) else edges
            stops = np.flatnonzero(turn == -1)
            if len(edges):
                begins, stops = np.sort(np.concatenate([begins, edges])), np.sort(np.concatenate([stops, edges]))
            starts.append(begins + at)
            ends.append(stops + at)
            hashes.append(Sums(values[own]).run(begins, stops))
            at = to
        self.starts, self.ends, self.hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.bounds = np.searchsorted(self.starts, offsets)

    def text(self, first: int, last: int) -> str:
        """The bytes from word ``first`` to word ``last``, that one excluded, with the white space between."""
        return self.bytes[self.starts[first] : self.ends[last - 1]].tobytes().decode()


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, PIECE):
        own = words[at : at + PIECE + k - 1]
        start = np.arange(len(own) - k + 1)
        out[at : at + PIECE] = Sums(mix64(own)).run(start, start + k)
    return out


#: A key is hot when more than one in so many rows has it; so many keys at most can be.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and in ``weight`` how many of the ``total`` rows have that key.

    Hot keys, fewer than HOT by that count, are broadcast with what the table has for them, so that none of them is one
    task's; all others are joined as Spark likes.
    """
    hot = F.col(weight) * HOT > total
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that it is connected to within the task."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
        x, y = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        root = np.arange(len(nodes))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = low != high
            x, y, low, high = x[apart], y[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while (further := root[root] != root).any():
                root[further] = root[root[further]]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "local"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root the smallest node; nodes without an edge to another one are absent.

    Each task finds the components of its own edges. A node's root is its smallest in any task, and what other tasks found
    for it are edges between roots, on which the next round works; their number falls at least by half with each round.
    Then the rounds' roots are followed back. A task holds its split of the edges, and no key has more rows than there
    are tasks; every round is written, so that no lineage grows.
    """
    rounds: list[Stash] = []
    now = Stash(spark, edges.where("a <> b").select("a", "b"))
    told = Window.partitionBy("node").orderBy("local")
    while True:
        found = now.df.mapInArrow(_local_roots, "node long, local long")
        rounds.append(Stash(spark, found.withColumns({"root": F.first("local").over(told), "place": F.row_number().over(told)})))
        now.drop()
        now = Stash(spark, rounds[-1].df.where("local <> root").select(F.col("local").alias("a"), F.col("root").alias("b")).distinct())
        if now.df.isEmpty():
            break
    roots = None
    for r in reversed(rounds):
        own = r.df.where("place = 1").select("node", "root")
        if roots is None:
            roots = own
        else:
            later = roots.select(F.col("node").alias("root"), F.col("root").alias("final"))
            roots = own.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    result = Stash(spark, roots)
    for r in (now, *rounds):
        r.drop()
    return result.df
