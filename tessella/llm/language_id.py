"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a mask with a bit for each language,
so the masks of an n-gram's slots, and-ed, name all languages that have it. For a text the
bits of each language are counted, corrected for the rate at which its filter answers
falsely, and the language with most of the text's n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import int_keyed, mix64, prepare, slices

#: Documents of each language that filters are learned from, about; drawn by a hash of doc_id.
SAMPLE = 4000
#: Letters of an n-gram; its least share in a language, there and against the language where it is most common.
SIZE, LEAST_SHARE, LEAST_OF_MOST = 3, 4e-6, 0.05
#: Slots for each entry, and slots of an entry.
ROOM, HASHES = 12, 2
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of n-grams, the text of each, whether each text has a letter). Other characters are spaces; an n-gram has letters but at its ends."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in lowered], np.int64)
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32) if texts else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = is_letter()[points]
    has = np.bincount(owner, letter, len(texts)) > 0
    points = np.where(letter, points, 32).astype(np.uint64)
    inside = letter[1:-1] & (letter[:-2] | letter[2:])
    codes = (points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])[inside]
    return codes, owner[1:-1][inside], has


class Filters:
    """masks: the slots; languages: the names of the bits; false: how often each language's filter answers falsely."""

    def __init__(self, languages: list[str], entries: list[np.ndarray]):
        self.languages = languages
        count = max(1, sum(len(e) for e in entries))
        self.bits = max(10, int(np.ceil(np.log2(ROOM * count))))
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(64, len(languages)))
        self.masks = [np.zeros(1 << self.bits, kind) for _ in range(0, len(languages), 64)]  # of 64 languages each
        for bit, codes in enumerate(entries):
            for slot in self.slots(codes):
                self.masks[bit // 64][np.unique(slot)] |= kind(1 << bit % 64)
        self.false = np.array([float(self._bit(self.masks, b).mean()) ** HASHES for b in range(len(languages))])

    @staticmethod
    def _bit(masks: list[np.ndarray], language: int) -> np.ndarray:
        own = masks[language // 64]
        return own >> own.dtype.type(language % 64) & own.dtype.type(1)

    def slots(self, codes: np.ndarray) -> list[np.ndarray]:
        mixed = mix64(codes)
        low = np.uint64((1 << self.bits) - 1)
        return [(mixed >> np.uint64(32 * i) & low).astype(np.int64) for i in range(HASHES)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, owner, has = ngrams(texts)
        first, *others = self.slots(codes)
        masks = [m[first] for m in self.masks]
        for slot in others:
            for own, m in zip(masks, self.masks, strict=True):
                own &= m[slot]
        total = np.bincount(owner, minlength=len(texts))
        shares = np.zeros((len(texts), len(self.languages)))
        for b in range(len(self.languages)):
            hits = np.bincount(owner, self._bit(masks, b), len(texts))
            shares[:, b] = (hits - total * self.false[b]) / (1 - self.false[b]) / np.maximum(total, 1)
        best = shares.argmax(axis=1)
        scores = np.clip(shares[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, scores, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        codes, owner, _ = ngrams(batch.column("text").to_pylist())
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])[owner] if len(owner) else owner
        for i, name in enumerate(names):
            own, n = np.unique(codes[of == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def learn(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Filters | None:
    """Filters from docs (doc_id, text, lang) with a lang, brought down to about ``sample`` documents a language; None without any.

    What reaches the driver is bounded by the least share of an n-gram in a language.
    """
    prepare(spark)
    own = int_keyed(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = own.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), sample / F.col("count"))).select("lang", "share")
    drawn = own.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = drawn.select("text", "lang").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    held = [(r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()]
    if not held:
        return None
    totals = spark.createDataFrame(held, "lang string, total long")
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "code", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    rows = shares.collect()
    most: dict[int, float] = {}
    for r in rows:
        most[r["code"]] = max(r["share"], most.get(r["code"], 0.0))
    languages = sorted({x for x, _ in held})
    entries: dict[str, list[int]] = {x: [] for x in languages}
    for r in rows:
        if r["share"] >= LEAST_OF_MOST * most[r["code"]]:
            entries[r["lang"]].append(r["code"])
    return Filters(languages, [np.array(entries[x], np.int64).view(np.uint64) for x in languages])


def predict(spark: SparkSession, docs: DataFrame, filters: Filters | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text).

    Null texts and texts without a letter are undetermined, with score 0, and so is everything without filters. Of
    languages with equal shares the first by name is taken. Texts are taken whole, each row stands for itself, also with a
    null or repeated doc_id. An empty table gives no rows; further columns are ignored.
    """
    prepare(spark)
    held = spark.sparkContext.broadcast(filters)  # its size is bounded by the least share of an n-gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            names, scores = held.value.decide(texts) if held.value else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return int_keyed(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
