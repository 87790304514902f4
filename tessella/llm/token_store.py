"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Each block starts from nothing. Three models predict the next id: order 2 and order 1
name the id that followed the same two or one ids last in the block, order 0 is a
distribution over all ids, adaptive over classes of ids and even within a class. They are
mixed by weights that follow how often each named id was right lately in a like state, and
one step of a range coder of 62 bits codes an id by the mixture. Many
blocks are coded in lockstep, one array element each.

A file is a set of segments; a segment holds whole documents in ascending doc_id, their
lengths and the coded blocks, each with the CRC-32 of its ids. Segments travel as rows, so
that any file system that Spark writes to will do and a retried task writes nothing twice.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.chunks import library_encoder
from tessella.llm.common import Stash, int_keyed, prepare, slices

MAGIC = b"TSM3"
#: Ids of a block, blocks coded together, and ids of a segment (but for one long document).
BLOCK, LANES = 2048, 4096
SEGMENT = BLOCK * LANES
#: Slots for the contexts of a block by order 1 and order 2.
SLOTS_ONE, SLOTS_TWO = 1024, 1024
#: Bits of the mixture's total, of order 2's and order 1's probabilities and of order 0's shares.
TOTAL_BITS, TWO_BITS, ODDS_BITS, ZERO_BITS = 27, 15, 16, 10
TOTAL = 1 << TOTAL_BITS
#: Least and greatest probability of order 2, and of order 1 where order 2 fails, multiples of 1 << PACE; how fast they follow hits.
LEAST_TWO, MOST_TWO, LEAST_ONE, MOST_ONE, PACE = 112, 30_464, 208, 48_000, 4
#: Steps after which the shares of order 0 are renewed, besides those of EARLY; weight of an id seen; steps prepared together.
RENEW, EARLY, SEEN, AHEAD = 64, (16, 32), 24, 16
#: Bits of an id for which classes are made, at least and at most.
LEAST_BITS, MOST_BITS = 16, 20
#: Bits of a coded word: a span below 2**WORD_BITS takes one.
WORD_BITS = 31
_WORD = (1 << WORD_BITS) - 1
_HASH = np.int32(40503)
# Both probabilities of a state lie in one integer and follow in one go: each loses its part by PACE and gains its aim's.
_GAIN, _GAIN_TWO, _GAIN_ONE = (LEAST_TWO >> PACE << ODDS_BITS) + (LEAST_ONE >> PACE), MOST_TWO - LEAST_TWO >> PACE << ODDS_BITS, MOST_ONE - LEAST_ONE >> PACE
_LOSS = ~((1 << ODDS_BITS) - (1 << ODDS_BITS - PACE))


class Classes:
    """Classes of ids below 2**bits; widths grow with the id, as ids of such vocabularies are by frequency."""

    def __init__(self, bits: int):
        most = 1 << bits
        kind = np.floor(6 * np.log2(np.arange(most) / 64 + 1)).astype(np.int64)
        self.kind = np.unique(kind, return_inverse=True)[1].astype(np.uint8)
        self.first = np.flatnonzero(np.diff(self.kind.astype(np.int64), prepend=-1))
        self.width = np.diff(self.first, append=most)
        self.count = len(self.width)
        #: So that each id of a class has a part of its own even where order 0 has the least part of the total.
        most_two, most_one = MOST_TWO + (1 << PACE), MOST_ONE + (1 << PACE)
        smallest = ((1 << TWO_BITS) - most_two) * ((1 << ODDS_BITS) - most_one) >> TWO_BITS + ODDS_BITS - TOTAL_BITS
        self.least = 1 + self.width // (smallest >> ZERO_BITS)
        self.share_of_one = 1 / self.width


_classes: dict[int, Classes] = {}


def classes_for(bits: int) -> Classes:
    if bits not in _classes:
        _classes[bits] = Classes(bits)
    return _classes[bits]


class Mixture:
    """The models of a number of blocks, all at the same step.

    A slot of order 1 or 2 holds the id that came last in its context, in its upper bits, and whether it is the first one
    or came twice in a row. For each such state of both and by whether they name the same id, a block learns how often
    order 2 is right, and order 1 where order 2 isn't; these are the weights of the mixture. What they leave goes to
    order 0. The time goes by what is moved: arrays are of 32 bits where they can and are written in place, and choices
    are made by masks (all bits where true), as ``numpy.where`` branches at each element.
    """

    def __init__(self, lanes: int, classes: Classes):
        lane = np.arange(lanes, dtype=np.int32)
        self.classes, self.lanes = classes, lanes
        self.base_one, self.base_two, self.base_zero = lane * SLOTS_ONE, lane * SLOTS_TWO, lane * classes.count
        self.base_odds, self.base_table = lane * 32, lane << ZERO_BITS
        self.one, self.two = np.zeros(lanes * SLOTS_ONE, np.int32), np.zeros(lanes * SLOTS_TWO, np.int32)
        state = np.arange(32)
        two = (1 << TWO_BITS) // 100 * np.array([0, 25, 0, 60])[state >> 3] + LEAST_TWO
        one = np.where(state & 1, 0, np.array([0, 6000, 0, 20000])[state >> 1 & 3] + LEAST_ONE)
        one = np.maximum(one, LEAST_ONE)
        self.odds = np.tile((two << ODDS_BITS | one).astype(np.int32), lanes)
        self.counts = np.tile(np.maximum(1, np.sqrt(classes.width).astype(np.int32)), lanes)
        self.least, self.share_of_one = classes.least.astype(np.int32), classes.share_of_one
        self.spare = (1 << ZERO_BITS) - int(classes.least.sum())
        self.at_one, self.at_two, self.state = (np.zeros(lanes, np.int64) for _ in range(3))
        names = "held_one held_two by_one by_two weight_two rest_one both unit odd t u v"
        self.__dict__ |= {n: np.zeros(lanes, np.int32) for n in names.split()}

    def renew(self, cells: list[np.ndarray]) -> None:
        """Shares of order 0 from the classes seen, with those of ``cells``, which came since the last time."""
        if cells:
            self.counts += (SEEN * np.bincount(np.concatenate([c.ravel() for c in cells]), minlength=len(self.counts))).astype(np.int32)
        counts = self.counts.reshape(self.lanes, -1)
        scale = self.spare * (1 - 2.0**-20) / counts.sum(axis=1, keepdims=True)  # so that rounding adds nothing
        shares = (counts * scale.astype(np.float32)).astype(np.int32) + self.least
        shares[:, 0] += (1 << ZERO_BITS) - shares.sum(axis=1, dtype=np.int32)
        self.shares = shares.ravel()
        #: Where each class begins, and its share.
        self.cells = (np.cumsum(shares, axis=1, dtype=np.int32) - shares << ZERO_BITS | shares).ravel()

    def table(self) -> np.ndarray:
        """The class of each share of order 0, block by block."""
        return np.repeat(np.tile(np.arange(self.classes.count, dtype=np.uint8), self.lanes), self.shares)

    def predict(self, at_one: np.ndarray, at_two: np.ndarray) -> None:
        """What orders 1 and 2 name, from these slots, and their parts of the total."""
        self.at_one, self.at_two = at_one, at_two
        held_one, held_two, t, u, odd, both, rest, weight = self.held_one, self.held_two, self.t, self.u, self.odd, self.both, self.rest_one, self.weight_two
        self.one.take(at_one, out=held_one, mode="clip")
        self.two.take(at_two, out=held_two, mode="clip")
        np.right_shift(held_one, 5, self.by_one)
        np.right_shift(held_two, 5, self.by_two)
        same(self.by_one, self.by_two, t)
        np.bitwise_and(held_two, 24, held_two)
        np.bitwise_and(held_one, 6, held_one)
        np.bitwise_or(held_two, held_one, u)
        np.subtract(u, t, u)
        np.add(u, self.base_odds, self.state)
        self.odds.take(self.state, out=odd, mode="clip")
        np.right_shift(odd, ODDS_BITS, weight)
        np.bitwise_and(odd, (1 << ODDS_BITS) - 1, rest)
        np.subtract(1 << TWO_BITS, weight, u)
        np.multiply(rest, u, rest)
        np.right_shift(rest, TWO_BITS + ODDS_BITS - TOTAL_BITS, rest)
        np.left_shift(weight, TOTAL_BITS - TWO_BITS, weight)
        np.add(weight, rest, both)
        np.subtract(TOTAL, both, self.unit)
        np.right_shift(self.unit, ZERO_BITS, self.unit)

    def order_zero(self, cell: np.ndarray, share_of_one: np.ndarray, begin: np.ndarray, part: np.ndarray) -> None:
        """Where the class begins in the total, and the part of one id of it."""
        self.cells.take(cell, out=part, mode="clip")
        np.right_shift(part, ZERO_BITS, begin)
        np.multiply(begin, self.unit, begin)
        np.add(begin, self.both, begin)
        np.bitwise_and(part, (1 << ZERO_BITS) - 1, part)
        np.multiply(part, self.unit, part)
        np.multiply(part, share_of_one, part, casting="unsafe")

    def choose(self, begin: np.ndarray, part: np.ndarray, not_two: np.ndarray, not_one: np.ndarray) -> None:
        """Begin and part of the id by the first order that names it; those given are order 0's."""
        weight, rest = self.weight_two, self.rest_one
        np.subtract(begin, weight, begin)
        np.bitwise_and(begin, not_one, begin)
        np.add(begin, weight, begin)
        np.bitwise_and(begin, not_two, begin)
        np.subtract(part, rest, part)
        np.bitwise_and(part, not_one, part)
        np.add(part, rest, part)
        np.subtract(part, weight, part)
        np.bitwise_and(part, not_two, part)
        np.add(part, weight, part)

    def learn(self, seen: np.ndarray, not_two: np.ndarray, not_one: np.ndarray) -> None:
        """seen: the ids, shifted as they are held in slots."""
        t, u, odd = self.t, self.u, self.odd
        np.right_shift(odd, PACE, t)
        np.bitwise_and(t, _LOSS, t)
        np.subtract(odd, t, odd)
        np.bitwise_and(not_two, _GAIN_TWO, t)
        np.subtract(odd, t, odd)
        np.invert(not_one, u)
        np.bitwise_and(u, not_two, u)
        np.bitwise_and(u, _GAIN_ONE, u)
        np.add(odd, u, odd)
        np.add(odd, _GAIN + _GAIN_TWO, odd)
        self.odds[self.state] = odd
        np.bitwise_and(not_two, 16, t)
        np.subtract(seen, t, t)
        np.add(t, 24, t)
        self.two[self.at_two] = t
        np.bitwise_and(not_one, 4, u)
        np.subtract(seen, u, u)
        np.add(u, 6, u)
        self.one[self.at_one] = u


def same(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """A mask of where two arrays of numbers that aren't negative are equal."""
    np.bitwise_xor(a, b, out)
    np.subtract(out, 1, out)
    np.right_shift(out, 31, out)


def encode_blocks(ids: np.ndarray, bits: int = LEAST_BITS) -> tuple[list[bytes], np.ndarray]:
    """(coded blocks, CRC-32 of each block's ids) of ids below 2**bits; every block has BLOCK ids, the last one what is left.

    What depends on ids alone is prepared AHEAD steps at a time. A word is kept at each step, and the steps at which one is
    due are told apart at the end. Words may run over by a carry while coding; carries are settled there too.
    """
    lanes, classes = -(-len(ids) // BLOCK), classes_for(bits)
    if not lanes:
        return [], np.empty(0, "<u4")
    steps, raw = min(BLOCK, len(ids)), np.ascontiguousarray(ids, "<u4")
    rows = raw if len(raw) == lanes * BLOCK else np.concatenate([raw, np.zeros(lanes * BLOCK - len(raw), "<u4")])
    rows, first = rows.view(np.int32).reshape(lanes, BLOCK), classes.first.astype(np.int32)
    model = Mixture(lanes, classes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, (1 << 2 * WORD_BITS) - 1, np.int64)
    words, due = np.empty((lanes, steps + 2), np.uint32), np.ones((lanes, steps + 2), bool)
    told, full = np.empty((AHEAD, lanes), np.uint32), np.empty((AHEAD, lanes), bool)
    begin, part, not_two, not_one = (np.empty(lanes, np.int32) for _ in range(4))
    unit, wide, mask = (np.empty(lanes, np.int64) for _ in range(3))
    hashes, cells = np.zeros((AHEAD + 2, lanes), np.int32), []
    for start in range(0, steps, AHEAD):
        if start % RENEW == 0 or start in EARLY:
            model.renew(cells)
            cells = []
        ahead = min(AHEAD, steps - start)
        own = np.ascontiguousarray(rows[:, start : start + ahead].T)
        kinds = classes.kind.take(own).astype(np.int64)
        inside, share_of_one = own - first.take(kinds), classes.share_of_one.take(kinds)
        cells.append(kinds + model.base_zero)
        hashes[:2] = hashes[AHEAD:]
        np.multiply(own, _HASH, hashes[2 : ahead + 2])
        at_one = np.add(hashes[1 : ahead + 1] >> 6 & (SLOTS_ONE - 1), model.base_one, dtype=np.int64)
        at_two = np.add(hashes[1 : ahead + 1] + hashes[:ahead] * 5 >> 5 & (SLOTS_TWO - 1), model.base_two, dtype=np.int64)
        seen = own << 5
        for i in range(ahead):
            model.predict(at_one[i], at_two[i])
            same(own[i], model.by_two, not_two)
            np.invert(not_two, not_two)
            same(own[i], model.by_one, not_one)
            np.invert(not_one, not_one)
            model.order_zero(cells[-1][i], share_of_one[i], begin, part)
            np.multiply(inside[i], part, model.v)
            np.add(begin, model.v, begin)
            model.choose(begin, part, not_two, not_one)
            np.right_shift(span, TOTAL_BITS, unit)
            np.multiply(unit, begin, wide)
            np.add(low, wide, low)
            np.multiply(unit, part, span)
            np.right_shift(low, WORD_BITS, told[i], casting="unsafe")
            np.less_equal(span, _WORD, full[i])
            np.subtract(span, _WORD + 1, mask)
            np.right_shift(mask, 63, mask)
            np.bitwise_and(mask, ~_WORD, wide)
            np.invert(wide, wide)
            np.bitwise_and(low, wide, low)
            np.bitwise_and(mask, WORD_BITS, mask)
            np.left_shift(low, mask, low)
            np.left_shift(span, mask, span)
            model.learn(seen[i], not_two, not_one)
        words[:, start : start + ahead], due[:, start : start + ahead] = told[:ahead].T, full[:ahead].T
    words[:, steps], words[:, steps + 1] = low >> WORD_BITS, low & _WORD
    counts, coded = due.sum(axis=1), words[due]
    while (over := coded >> WORD_BITS).any():
        coded &= _WORD
        coded[:-1] += over[1:]  # the first word of a block never runs over
    coded, ends = coded.astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    sums = np.array([zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) for i in range(lanes)], "<u4")
    return [coded[a:b] for a, b in zip(ends, ends[1:])], sums


def decode_blocks(blocks: list[bytes], total: int, sums: np.ndarray, bits: int = LEAST_BITS) -> np.ndarray:
    """The ids of all blocks; a block whose checksum differs is an error."""
    lanes, steps, classes = len(blocks), min(BLOCK, total), classes_for(bits)
    words = np.frombuffer(b"".join([*blocks, bytes(12)]), "<u4").astype(np.uint32)
    model = Mixture(lanes, classes)
    first = classes.first.astype(np.int32)
    used = np.cumsum([0, *(len(b) // 4 for b in blocks[:-1])])
    span = np.full(lanes, (1 << 2 * WORD_BITS) - 1, np.int64)
    code = words.take(used).astype(np.int64) << WORD_BITS | words.take(used + 1)
    used += 2
    begin, part, not_two, not_one, value, ids, hashed, before, kind = (np.zeros(lanes, np.int32) for _ in range(9))
    unit, wide, mask, at, at_one, at_two, cell = (np.empty(lanes, np.int64) for _ in range(7))
    ratio, share_of_one, of, word = np.empty(lanes), np.empty(lanes), np.empty(lanes, np.uint8), np.empty(lanes, np.uint32)
    out, raw, t, since = np.empty((RENEW, lanes), np.int32), np.zeros((lanes, BLOCK), "<u4"), model.v, 0
    for step in range(steps):
        if step % RENEW == 0 or step in EARLY:
            seen = out[since % RENEW : (step - 1) % RENEW + 1]
            model.renew([classes.kind.take(seen, mode="clip").astype(np.int64) + model.base_zero] if step else [])
            raw[:, since:step] = seen[: step - since].T
            table, since = model.table(), step
        np.right_shift(hashed, 6, t)
        np.bitwise_and(t, SLOTS_ONE - 1, t)
        np.add(t, model.base_one, at_one)
        np.multiply(before, 5, t)
        np.add(t, hashed, t)
        np.right_shift(t, 5, t)
        np.bitwise_and(t, SLOTS_TWO - 1, t)
        np.add(t, model.base_two, at_two)
        model.predict(at_one, at_two)
        np.right_shift(span, TOTAL_BITS, unit)
        np.divide(code, unit, ratio)
        np.subtract(ratio, 2.0**-20, value, casting="unsafe")  # exact or one too few
        np.multiply(unit, value, wide)
        np.subtract(code, wide, wide)
        np.subtract(wide, unit, wide)
        np.right_shift(wide, 63, wide)
        np.add(wide, 1, wide)
        np.add(value, wide, value, casting="unsafe")
        np.minimum(value, TOTAL - 1, out=value)
        np.subtract(model.weight_two, 1, not_two)
        np.subtract(not_two, value, not_two)
        np.right_shift(not_two, 31, not_two)
        np.subtract(value, model.both, begin)
        np.right_shift(begin, 31, not_one)
        np.invert(not_one, not_one)
        np.bitwise_and(begin, not_one, begin)
        np.divide(begin, model.unit, ratio)
        np.minimum(ratio, (1 << ZERO_BITS) - 1, out=ratio)
        np.add(ratio, model.base_table, at, casting="unsafe")
        table.take(at, out=of, mode="clip")
        np.add(of, model.base_zero, cell)
        at[:] = of
        classes.share_of_one.take(at, out=share_of_one, mode="clip")
        first.take(at, out=kind, mode="clip")
        model.order_zero(cell, share_of_one, begin, part)
        np.subtract(value, begin, t)
        np.divide(t, part, t, casting="unsafe")
        np.add(kind, t, ids)
        np.multiply(t, part, t)
        np.add(begin, t, begin)
        np.subtract(ids, model.by_one, ids)
        np.bitwise_and(ids, not_one, ids)
        np.add(ids, model.by_one, ids)
        np.subtract(ids, model.by_two, ids)
        np.bitwise_and(ids, not_two, ids)
        np.add(ids, model.by_two, ids)
        model.choose(begin, part, not_two, not_one)
        np.multiply(unit, begin, wide)
        np.subtract(code, wide, code)
        np.multiply(unit, part, span)
        np.subtract(span, _WORD + 1, mask)
        np.right_shift(mask, 63, mask)
        words.take(used, out=word, mode="clip")
        np.subtract(used, mask, used)
        np.bitwise_and(mask, word, wide)
        np.bitwise_and(mask, WORD_BITS, mask)
        np.left_shift(code, mask, code)
        np.bitwise_or(code, wide, code)
        np.left_shift(span, mask, span)
        out[step % RENEW] = ids
        same(ids, model.by_one, not_one)
        np.invert(not_one, not_one)
        np.left_shift(ids, 5, value)
        model.learn(value, not_two, not_one)
        hashed, before = before, hashed
        np.multiply(ids, _HASH, hashed)
    raw[:, since:steps] = out[since % RENEW : (steps - 1) % RENEW + 1].T
    raw = raw[:, :steps].ravel()[:total]
    for i in range(lanes):
        if zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK]) != int(sums[i]):
            raise ValueError(f"block {i} is damaged")
    return raw


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """Header, whether and which doc_id, length of each document, words and checksum of each block, coded blocks."""
    ids = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs], "<i8")
    bits = max(LEAST_BITS, int(ids.max()).bit_length()) if len(ids) else LEAST_BITS
    if bits > MOST_BITS:
        raise ValueError(f"ids have at most {MOST_BITS} bits")
    parts = [encode_blocks(ids[i : i + SEGMENT], bits) for i in range(0, len(ids), SEGMENT)]
    blocks = [b for bs, _ in parts for b in bs]
    sums = np.concatenate([np.empty(0, "<u4"), *(s for _, s in parts)])
    table = zlib.compress(np.array([i is not None for i in doc_ids], "u1").tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + lengths.tobytes(), 1)
    head = MAGIC + struct.pack("<qqqqq", len(doc_ids), len(ids), len(blocks), len(table), bits)
    return b"".join([head, table, np.array([len(b) // 4 for b in blocks], "<u4").tobytes(), sums.tobytes(), *blocks])


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if data[:4] != MAGIC:
        raise ValueError("no segment of token ids")
    n, total, count, size, bits = struct.unpack_from("<qqqqq", data, 4)
    table = zlib.decompress(data[44 : 44 + size])
    given, doc_ids, lengths = np.frombuffer(table, "u1", n), np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<i8", n, 9 * n)
    at = 44 + size
    words, sums = np.frombuffer(data, "<u4", count, at), np.frombuffer(data, "<u4", count, at + 4 * count)
    at += 8 * count
    ends = at + 4 * np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    blocks = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    per = SEGMENT // BLOCK
    parts = [decode_blocks(blocks[i : i + per], min(SEGMENT, total - i * BLOCK), sums[i : i + per], bits) for i in range(0, count, per)]
    ids = np.concatenate([np.empty(0, "<u4"), *parts])
    cuts = np.cumsum(lengths)[:-1]
    return [int(d) if g else None for d, g in zip(doc_ids, given, strict=True)], np.split(ids, cuts)


def _segments(blob, name: str, end_id: int):
    schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(blob.value, name), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        ids, docs, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, number, held, pack_segment(ids, docs)), schema.types, strict=True)], schema=schema)

        for batch in slices(batches, 2 << 20):
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist()), strict=True):
                if docs and held + len(own) + 1 > SEGMENT:
                    yield flush()
                    ids, docs, held, number = [], [], 0, number + 1
                ids.append(doc)
                docs.append(np.concatenate([own, end]))
                held += len(own) + 1
        if docs:
            yield flush()

    return rows


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Segments (part, segment, n_ids, data) in ascending doc_id (null first), to be written to a folder as they are.

    Each document's ids are those of the tokenizers library, without added special tokens, and end_id. Null and empty
    texts have end_id alone. Every row is a document of its own, also when it repeats a doc_id: rows of one doc_id are in
    the order of a hash of their texts, and can go to several tasks. A long text is one document of as many blocks as it
    takes. An empty table has no segments. Further columns are ignored. Ids of more than MOST_BITS bits are an error.
    """
    prepare(spark)
    with open(tokenizer, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())  # a vocabulary of a few MB
    told = int_keyed(docs, "doc_id", "text").withColumns({"k": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    by = ("doc_id", "k", "row")  # so that a repeated row is no single range
    ordered = told.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    return ordered.mapInArrow(_segments(blob, tokenizer, end_id), "part long, segment long, n_ids long, data binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
            doc_ids, docs = unpack_segment(data.as_py())
            lengths = np.array([len(d) for d in docs], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array([zlib.crc32(d) for d in docs], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in segments, start counting the ids of all before it.

    A task holds the segments of its split of the file and decodes one at a time.
    """
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment")
    sizes = segments.select("part", "segment", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inner"))
    starts = sizes.join(before, "part").select("part", "segment", (F.col("base") + F.col("inner")).alias("start"))
    return segments.join(starts, ["part", "segment"]).select("start", "data").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the documents' ids to the shared folder and reads them back (``read_tokens``)."""
    return read_tokens(spark, Stash(spark, write_tokens(spark, docs, tokenizer, end_id)).df)
