"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Each task packs lots of about half a million ids. Whole windows are cut off long documents
first. What is left of each document is an item; items start as partial partitions with
one loaded window each. The two partitions with the largest imbalance are merged again
and again, the fullest window of one onto the emptiest of the other, until one partition
into near-equal windows is left. If its fullest window is over capacity the lot is
partitioned again into more windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chunks import library_encoder
from tessella.llm.common import int_keyed, prepare, slices

CAPACITY = 4096
#: Ids of a lot, about: what one task packs at a time.
LOT = 1 << 19
#: Items at most this long, so that windows can be made near-equal; longer remainders are cut in two.
ITEM = CAPACITY // 2
#: Items shorter than this go together up to it, so that a lot has at most about LOT / BUNDLE of what is partitioned.
BUNDLE = 128


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by largest differencing into a number of windows."""
    if windows == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    n, left, right = len(sizes), [], []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        loads, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        loads[-1], nodes[-1] = size, i
        heap.append((-size, i, loads, nodes))  # loads rise, with the least taken off
    heapq.heapify(heap)
    merges = []
    node, tick = n, n
    while len(heap) > 1:
        _, _, a_loads, a_nodes = heapq.heappop(heap)
        _, _, b_loads, b_nodes = heap[0]
        loads, other = a_loads + b_loads[::-1], b_nodes[::-1]
        both = np.flatnonzero((a_nodes >= 0) & (other >= 0))
        nodes = np.where(a_nodes >= 0, a_nodes, other)
        if len(both):
            made = node + np.arange(len(both))
            merges.append((made, a_nodes[both], other[both]))
            nodes[both] = made
            node += len(both)
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        loads -= loads[0]
        tick += 1
        heapq.heapreplace(heap, (-int(loads[-1]), tick, loads, nodes[order]))
    window = np.full(node, -1, np.int64)
    final = heap[0][3]
    window[final[final >= 0]] = np.flatnonzero(final >= 0)
    for made, left, right in reversed(merges):
        window[left] = window[right] = window[made]
    return window[:n]


def pack_lot(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents with these lengths; sequences count from 0."""
    pieces, items, sequence = [], [], 0
    for doc, length in enumerate(lengths.tolist()):
        whole = length // capacity * capacity
        for start in range(0, whole, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        rest = length - whole
        if rest > capacity // 2:
            items += [(doc, whole, capacity // 2), (doc, whole + capacity // 2, rest - capacity // 2)]
        elif rest:
            items.append((doc, whole, rest))
    if not items:
        return pieces
    bundles, open_one, held = [], [], 0
    for item in items:
        if item[2] >= BUNDLE:
            bundles.append([item])
            continue
        open_one.append(item)
        held += item[2]
        if held >= BUNDLE:
            bundles.append(open_one)
            open_one, held = [], 0
    if open_one:
        bundles.append(open_one)
    sizes = np.array([sum(x[2] for x in b) for b in bundles], np.int64)
    windows = -(-int(sizes.sum()) // capacity)
    if windows > 8:  # differencing leaves windows a few ids apart; without that room it would only be repeated
        windows = -(-int(sizes.sum()) // (capacity - capacity // 256))
    while True:
        window = difference(sizes, windows)
        most = int(np.bincount(window, sizes, windows).max())
        if most <= capacity:
            break
        mean = sizes.sum() / windows
        windows = max(windows + 1, int(windows * (1 + (most - capacity) / mean / 2)))
    used = np.zeros(windows, np.int64)
    names = np.unique(window, return_inverse=True)[1]
    for bundle, w in zip(bundles, names.tolist(), strict=True):
        for doc, start, length in bundle:
            pieces.append((doc, start, length, sequence + w, int(used[w])))
            used[w] += length
    return pieces


def _pack_rows(blob, name: str, end_id: int, capacity: int, lot: int, keep_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = library_encoder(blob.value, name), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        ids, docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            lengths = np.array([len(d) for d in docs], np.int64)
            pieces = pack_lot(lengths, capacity)
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            cut = [docs[d][s : s + n] for d, s, n, _, _ in pieces]
            columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(lengths[doc]), pa.array(sequence + base), pa.array(offset)]
            if keep_ids:
                columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
            base += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in slices(batches, 2 << 20):
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist()), strict=True):
                ids.append(doc)
                docs.append(np.concatenate([own, end]))
                held += len(own) + 1
                if held >= lot:
                    yield flush()
                    ids, docs, held = [], [], 0
        if docs:
            yield flush()

    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, lot: int = LOT, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of docs (doc_id, text).

    A document's ids are those of the tokenizers library without added special tokens, and end_id; a null or empty text has
    end_id alone. Pieces of a sequence follow each other from offset 0 without gaps and hold at most ``capacity`` ids.
    Every row is a document of its own, also with a null or repeated doc_id. sequence_id has the task's number in its
    upper bits, so that no task needs to know of another. An empty table has no pieces; further columns are ignored. A long
    text is cut into whole windows and a rest.
    """
    prepare(spark)
    with open(tokenizer, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())  # a vocabulary of a few MB
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return int_keyed(docs, "doc_id", "text").mapInArrow(_pack_rows(blob, tokenizer, end_id, capacity, lot, keep_ids), schema)
