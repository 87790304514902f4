"""Substring dedup with repeated-phrase automata.

In every window the smallest hash of a few words is its anchor. Neighbouring windows with
one anchor form a span; a span whose anchor occurs once in all documents holds no window
that recurs. Of the other spans, those that are equal as a whole name their earliest copy
as what they may repeat, and the earliest copies whose anchor has several of them name,
window by window, the earliest place of each. What is named forms passages. These are dealt
to shards of bounded size; each shard compiles an Aho-Corasick automaton over blocks of
half a window, and the stretches of documents that may repeat its passages stream through
it. The windows around a found block are compared whole, so that an occurrence is an
equality of words, not of hashes.

No occurrence is missed: equal windows have equal anchors at equal offsets, so both are in
spans of one anchor. Either their spans are equal and the later one names the earlier, or
their earliest copies differ and the windows are compared one by one. Only a window that
shares its whole 64-bit hash with a different one that starts earlier could be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import HOT, PIECE, Stash, Sums, Words, int_keyed, join_hot, mix64, prepare, rolling, slices, split_words, with_text, wrapped

#: Words of an anchor.
ANCHOR = 6
#: Words of passages that one automaton holds, about; of documents that one task streams through it, about; of a document whose passages go to one shard.
SHARD_WORDS, STREAM_WORDS, BLOCK = 250_000, 1_000_000, 4096
#: Parts that a hot anchor is dealt to.
SALTS = 64
#: Low bits of a number that holds a word's place in a piece.
_PLACE = 24


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of so many keys."""
    held, size = keys, 1
    while size * 2 <= width:
        held, size = np.minimum(held[:-size], held[size:]), size * 2
    return np.minimum(held[: len(held) - (width - size)], held[width - size :]) if size < width else held


def _spans_of(words: Words, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, hash of the span, text, first window, windows) of the spans of each text, a piece of the words at a time."""
    total = len(words.hashes)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    for at in range(0, total - window + 1, PIECE):
        own = words.hashes[at : at + PIECE + window - 1]
        mixed = Sums(mix64(own))
        first = np.arange(len(own) - ANCHOR + 1)
        grams = mixed.run(first, first + ANCHOR)
        keys = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | first.astype(np.uint64)
        place = (_smallest(keys, window - ANCHOR + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        starts = np.flatnonzero(owner[at : at + len(place)] == owner[at + window - 1 : at + window - 1 + len(place)])
        if not len(starts):
            continue
        place = place[starts]
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        low, count = starts[new], np.diff(new, append=len(starts))
        text = owner[at + low]
        yield grams[place[new]], mixed.run(low, low + count + window - 1), text, at + low - words.bounds[text], count


def _spans(window: int, hot: np.ndarray):
    """(h, salt, s, doc_id, twin, pos, n) of every span; hot anchors are salted by the span."""
    schema = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("s", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
            for h, s, text, pos, n in _spans_of(Words(batch.column("text"), lower=False), window):
                h, s = h.view(np.int64), s.view(np.int64)
                salt = np.where(np.isin(h, hot), s & (SALTS - 1), 0) if len(hot) else np.zeros(len(h))
                columns = (h, salt.astype(np.int32), s, ids[text], twins[text], pos.astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return rows


def _anchors(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for h, *_ in _spans_of(Words(batch.column("text"), lower=False), window):
                own, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return rows


def _listed(batch: pa.RecordBatch, column: str, *fields: str) -> tuple[np.ndarray, ...]:
    """For a column of lists of structs: the row of each struct, and its fields."""
    lists = batch.column(column)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _windows(window: int):
    """The hash of every window of the listed spans: (w, doc_id, twin, pos)."""
    schema = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=False)
            row, pos, n = _listed(batch, "spans", "pos", "n")
            of = np.repeat(np.arange(len(n)), n)
            start = pos[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            hashes = rolling(words.hashes, window)[words.bounds[row[of]] + start]
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False)[row[of]] for c in ("doc_id", "twin"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes.view(np.int64), ids, twins, start.astype(np.int32))], schema=schema)

    return rows


class PhraseAutomaton:
    """Passages of at least ``window`` words, and where their windows occur in a document.

    A window holds a whole block of half its length that starts at a multiple of that length in its passage, so blocks
    find every window. Around a found block the windows that can hold it are compared whole, and with the earliest place
    of each, however many passages share it. In the automaton a word is a letter, or two where there are more words than letters.
    """

    LETTERS = 1_000_000

    def __init__(self, passages: list[tuple[tuple[int, int], int, list[bytes]]], window: int):
        self.window, self.step = window, window // 2
        known = dict.fromkeys(w for _, _, words in passages for w in words)
        self.size = 1 if len(known) < self.LETTERS else 2
        self.letters = {w: self._letters(n) for n, w in enumerate(known, 1)}
        self.none = "\0" * self.size
        self.first: dict[str, tuple[tuple[int, int], int]] = {}
        self.automaton = ahocorasick.Automaton()
        size, whole, block = self.size, window * self.size, self.step * self.size
        for doc, place, words in passages:
            coded = "".join(map(self.letters.__getitem__, words))
            for at in range(0, len(coded) - block + 1, block):
                self.automaton.add_word(coded[at : at + block], True)
            for at in range(len(words) - window + 1):
                own, seen = (doc, place + at), coded[at * size : at * size + whole]
                held = self.first.get(seen)
                if held is None or own < held:
                    self.first[seen] = own
        self.automaton.make_automaton()

    def _letters(self, n: int) -> str:
        if self.size == 2:  # the first of two letters is never a second one, so that words can't be found across two
            return chr(0x10000 + n // 0x8000) + chr(0x100 + n % 0x8000)
        return chr(n if n < 0xD800 else n + 0x800)  # without surrogates

    def occurrences(self, words: list[bytes], doc: tuple[int, int], first: int) -> list[tuple[int, int]]:
        """(start, length) of stretches of the words, which start at word ``first`` of a document, whose windows start earlier elsewhere."""
        get, known, none, window, step, size = self.letters.get, self.first.get, self.none, self.window, self.step, self.size
        text = "".join([get(w, none) for w in words])
        out: list[tuple[int, int]] = []
        tested = begin = end = 0
        for last, _ in self.automaton.iter(text):
            start = (last + 1) // size - step
            for at in range(max(tested, start - step + 1), min(start, len(words) - window) + 1):
                place = known(text[at * size : (at + window) * size])
                if place is not None and place < (doc, first + at):
                    if at > end:
                        out.append((begin, end - begin))
                        begin = at
                    end = at + window
            tested = max(tested, start + 1)
        out.append((begin, end - begin))
        return [x for x in out if x[1]]


def _fragments(window: int):
    """The words of the listed windows of a document, for each shard and use: (shard, is_passage, doc_id, twin, pos, n_words, text)."""
    schema = pa.schema([("shard", pa.int32()), ("is_passage", pa.bool_()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32()), ("n_words", pa.int32()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=False)
            row, shard, use, pos, n = _listed(batch, "asks", "shard", "is_passage", "pos", "n")
            order = np.lexsort((pos, use, shard, row))
            row, shard, use, pos, n = (x[order] for x in (row, shard, use, pos, n))
            group = np.cumsum((np.diff(row, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0) | (np.diff(use.astype(np.int8), prepend=-1) != 0))
            ends = np.maximum.accumulate(pos + n + group * (1 << 32)) - group * (1 << 32)  # of the windows so far in each group
            new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (pos[1:] > ends[:-1])][: len(row)])
            last = np.r_[new[1:], len(row)] - 1 if len(new) else new
            row, shard, use, pos, size = row[new], shard[new], use[new], pos[new], ends[last] - pos[new] + window - 1
            at = words.bounds[row] + pos
            texts = [words.text(a, b) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "twin"))
            columns = (shard.astype(np.int32), use.astype(bool), ids, twins, pos.astype(np.int32), size.astype(np.int32), texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows


def _locate(window: int):
    """For a shard: the stretches of documents that are later occurrences of its passages."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        told = zip(pdf["is_passage"].tolist(), pdf["doc_id"].tolist(), pdf["twin"].tolist(), pdf["pos"].tolist(), pdf["text"].tolist(), strict=True)
        own = [(p, (d, t), at, split_words(text, lower=False)) for p, d, t, at, text in told]
        automaton = PhraseAutomaton([(doc, at, words) for p, doc, at, words in own if p], window)
        found = []
        if automaton.first:
            for p, doc, at, words in own:
                if not p:
                    found += [(*doc, at + start, at + start + length) for start, length in automaton.occurrences(words, doc, at)]
        return pd.DataFrame(found, columns=["doc_id", "twin", "a", "b"]).astype("int64")

    return rows


_PLACED = ["doc_id", "twin", "pos"]


def _stretches(spark: SparkSession, docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, twin, a, b), the words a to b - 1 of a document that go, for docs (doc_id, twin, text) whose first two columns are a key."""
    used: list[Stash] = []

    def stash(df: DataFrame) -> DataFrame:
        used.append(Stash(spark, df))
        return used[-1].df

    often = stash(docs.select("text").mapInArrow(_anchors(window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    anchors = often.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = [r["h"] for r in often.where(F.col("n") * HOT > anchors).select("h").collect()]  # fewer than HOT, by what they are
    salted = often.select("h", F.explode(F.when(F.col("n") * HOT > anchors, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    every = docs.mapInArrow(_spans(window, np.array(hot, np.int64)), "h long, salt int, s long, doc_id long, twin long, pos int, n int")
    spans = stash(every.join(salted, ["h", "salt"]).drop("salt"))
    total = spans.count()

    place, first = F.struct(*_PLACED), F.col("first")
    target = [first[c].alias(f"t_{c}") for c in _PLACED]
    copies = stash(spans.groupBy("h", "s", "n").agg(F.min(place).alias("first"), F.count("*").alias("rows")))
    later = join_hot(spans, copies.where("rows > 1"), ["h", "s", "n"], "rows", total).where(place != first).select(*_PLACED, "n", *target)

    several = copies.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    contested = join_hot(copies, several, ["h"], "kinds", copies.count()).groupBy("first.doc_id", "first.twin").agg(F.collect_list(F.struct("first.pos", "n")).alias("spans"))
    windows = stash(docs.join(contested, ["doc_id", "twin"]).mapInArrow(_windows(window), "w long, doc_id long, twin long, pos int"))
    firsts = windows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    single = join_hot(windows, firsts, ["w"], "rows", windows.count()).where(place != first).select(*_PLACED, F.lit(1).alias("n"), *target)

    visits = stash(later.unionByName(single))
    targets = visits.select(*(F.col(f"t_{c}").alias(c) for c in _PLACED), "n").distinct()
    size = targets.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    home = lambda *c: F.pmod(F.xxhash64(*c[:2], F.floor(F.col(c[2]) / BLOCK)), F.lit(shards)).cast("int").alias("shard")
    asks = targets.select("doc_id", "twin", F.struct(home(*_PLACED), F.lit(True).alias("is_passage"), "pos", "n").alias("ask"))
    asks = asks.unionByName(visits.select("doc_id", "twin", F.struct(home(*(f"t_{c}" for c in _PLACED)), F.lit(False).alias("is_passage"), "pos", "n").alias("ask")))
    by_doc = asks.groupBy("doc_id", "twin").agg(F.collect_list("ask").alias("asks"))
    fragments = stash(docs.join(by_doc, ["doc_id", "twin"]).mapInArrow(_fragments(window), "shard int, is_passage boolean, doc_id long, twin long, pos int, n_words int, text string"))
    loads = fragments.where("NOT is_passage").groupBy("shard").agg((F.floor(F.sum("n_words") / STREAM_WORDS) + 1).cast("int").alias("parts"), F.count("*").alias("streams"))
    dealt = F.when(F.col("is_passage"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "twin", "pos"), F.col("parts")).cast("int")))
    tiles = join_hot(fragments.drop("n_words"), loads, ["shard"], "streams", fragments.count()).withColumn("part", F.explode(dealt))
    found = Stash(spark, tiles.groupBy("shard", "part").applyInPandas(_locate(window), "doc_id long, twin long, a long, b long"))
    for old in used:
        old.drop()
    return found.df


def _twin(docs: DataFrame) -> tuple[bool, Column]:
    """Whether a doc_id repeats, and what tells its rows apart: a hash of the text, or 0 where none repeats."""
    repeats = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    return repeats, (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("twin")


def _keep(words: list[bytes], stretches: list[dict] | None) -> tuple[int, list[bytes]]:
    gone = np.zeros(len(words) + 1, np.int64)
    for s in stretches or ():
        gone[s["a"]] += 1
        gone[s["b"]] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return int(len(words) - stays.sum()), [w for w, s in zip(words, stays, strict=True) if s]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [split_words(t, lower=False) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array(map(len, words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())], names=["doc_id", "twin", "n_words", "whole_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cut = [_keep(split_words(t, lower=False), s) for t, s in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist(), strict=True)]
        texts = [b" ".join(w) for _, w in cut]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array([n for n, _ in cut], pa.int64()), pa.array([t.decode() for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "twin", "n_removed", "kept_text", "kept_sha256"])


def cut_texts(spark: SparkSession, docs: DataFrame, repeats: bool, window: int = 20) -> DataFrame:
    """(doc_id, twin, n_removed, kept_text, kept_sha256) of the documents (doc_id, twin, text) that lose words, once for rows that repeat a key; rows with a null doc_id are left out."""
    docs = docs.where("doc_id IS NOT NULL")
    unique = docs.dropDuplicates(["doc_id", "twin"]) if repeats else docs
    by_doc = _stretches(spark, unique, window).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("a", "b")).alias("stretches"))
    return unique.join(by_doc, ["doc_id", "twin"]).mapInArrow(_cut, "doc_id long, twin long, n_removed long, kept_text string, kept_sha256 string")


def substring_report(spark: SparkSession, docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text).

    A word goes if a run of ``window`` words that covers it also starts earlier: in a document with a smaller doc_id or
    earlier in its own. Null and empty texts have no words. Rows with a null doc_id keep all their words and don't count
    as earlier. Of rows that repeat a doc_id those with the same text are one document, listed as often; of different
    texts the one with the smaller hash is earlier. Texts of any length are taken whole. An empty table gives no rows;
    further columns are ignored.
    """
    prepare(spark)
    docs = int_keyed(docs, "doc_id", "text")
    repeats, twin = _twin(docs)
    docs = docs.select("*", twin)
    cut = cut_texts(spark, docs, repeats, window).drop("kept_text")
    whole = docs.mapInArrow(_whole, "doc_id long, twin long, n_words long, whole_sha256 string")
    return whole.join(cut, ["doc_id", "twin"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def cut_documents(spark: SparkSession, docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with the texts that are left, by the rule of ``substring_report``.

    Documents that lose no word keep their text as it is, a null one too; n_chars follows. Rows with a null doc_id stay as
    they are, repeated rows lose the same words. All columns are returned, whatever their names.
    """
    prepare(spark)
    own = int_keyed(docs, "doc_id", "text")
    repeats, twin = _twin(own)
    cut = cut_texts(spark, own.select("*", twin), repeats, window).select("doc_id", "twin", "kept_text")
    rows = wrapped(docs).select("*", twin)
    return with_text(rows.join(cut, ["doc_id", "twin"], "left").withColumn("text", F.coalesce("kept_text", "text")), docs)
