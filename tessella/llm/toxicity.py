"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding undoes homoglyphs and digits or symbols put for letters, and drops
decoration at the ends of words. The lexicon holds words and stems with log odds
as weights, learned from labelled documents; for some stems one word tells nothing, but two
different ones do, and these are entries of their own. Hits inside an exception phrase don't
count. The sum of weights is normalised by the length of the text and becomes a
probability by a rate fitted on the same documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import int_keyed, prepare, slices

#: Labelled documents that the lexicon and the rate are learned from, about; drawn by a hash of doc_id.
SAMPLE = 24_000
#: Letters of the shortest and longest stem, documents with a label that an entry needs (and as a share of them).
SHORTEST, LONGEST, LEAST_DOCS, LEAST_SHARE = 3, 14, 6, 0.002
#: Odds against chance that an entry needs.
LEAST_ODDS = 30.0
#: A stem is followed while at most so many continuations hold nearly all of its documents.
BRANCHES, NEARLY = 3, 0.95
#: Documents that only an entry explains, or its share of all with the label: entries that fall short of both come from copies of a few documents.
ALONE, WIDE = 2, 0.05
#: Words at which length starts to weigh.
LENGTH = 500.0

# Letters that look like Latin ones, signs that stand for letters, and harmless phrases.
HOMOGLYPHS = dict(zip("аеорсухіјѕкмнтвгαορνικτβε", "aeopcyxijskmhtbraopviktbe", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "clown fish", "class clown", "pond scum", "stupid question")

_ends = re.compile(r"[^\w\s]{2,}(?!\w)|[^\w\s$€](?!\w)")
_table = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(c): " " for c in "“”„«»‘’…–—¿¡·"} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_table |= {ord(a): b for a, b in (HOMOGLYPHS | LEET).items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def fold(text: str | None) -> str:
    """Words in folded letters between single spaces, with a space at either end."""
    if not text:
        return " "
    return f" {' '.join(_ends.sub('', text).lower().translate(_table).split())} "


#: Before a stem: the entry needs two different words with it.
TWICE = "2:"


def stems(words: set[str]) -> set[str]:
    """Beginnings of words from SHORTEST to LONGEST letters, those of two words also as an entry of that kind; a whole word ends with a space."""
    counts = Counter(w[:n] for word in words for w in [word + " "] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return {*counts, *(TWICE + s for s, n in counts.items() if n > 1)}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, rate: float = 1.0, floor: float = 0.0):
        self.weights, self.rate, self.floor = weights, rate, floor
        self.automaton = ahocorasick.Automaton()
        for stem in {k.removeprefix(TWICE) for k in weights}:
            self.automaton.add_word(" " + stem, (stem, len(stem) + 1))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (None, len(phrase) + 2))
        self.automaton.make_automaton()

    def evidence(self, text: str | None) -> float:
        """Summed weights of the words hit, each by its heaviest entry, and of the stems that two different words have, over the length."""
        folded = fold(text)
        hits: list[tuple[int, str]] = []
        spared: list[tuple[int, int]] = []
        for end, (stem, size) in self.automaton.iter(folded):
            start = end - size + 1
            if stem is None:
                spared.append((start, end))
            else:
                hits.append((start, stem))
        inside = {at for a, b in spared for at in range(a, b)}
        hits = [(at, s) for at, s in hits if at not in inside]
        if not hits:
            return 0.0
        single: dict[int, float] = {}
        words: dict[str, set[str]] = {}
        for at, stem in hits:
            if stem in self.weights:
                single[at] = max(self.weights[stem], single.get(at, self.weights[stem]))
            if TWICE + stem in self.weights:
                words.setdefault(stem, set()).add(folded[at + 1 : folded.index(" ", at + 1)])
        total = sum(single.values()) + sum(self.weights[TWICE + s] for s, w in words.items() if len(w) > 1)
        return total / (1 + math.log1p((folded.count(" ") - 1) / LENGTH))

    def score(self, evidence: float) -> float:
        return min(1.0, max(0.0, 1 - (1 - self.floor) * math.exp(-self.rate * evidence)))


def choose_entries(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """Weights of words and stems from the documents of either label that hold them.

    The shortest stems that tell are followed to longer ones as long as a few of those hold nearly all of their documents.
    Entries that need two words are chosen apart, in the same way.
    """
    if any(s.startswith(TWICE) for s in toxic):
        bare = [{s.removeprefix(TWICE): n for s, n in c.items() if s.startswith(TWICE)} for c in (toxic, other)]
        once = [{s: n for s, n in c.items() if not s.startswith(TWICE)} for c in (toxic, other)]
        return choose_entries(*once, n_toxic, n_other) | {TWICE + s: w for s, w in choose_entries(*bare, n_toxic, n_other).items()}
    need = max(LEAST_DOCS, LEAST_SHARE * n_toxic)

    def weight(stem: str) -> float:
        return math.log((toxic[stem] + 0.5) / (n_toxic + 1)) - math.log((other.get(stem, 0) + 0.5) / (n_other + 1))

    common = {s for s in toxic if toxic[s] >= need}
    longer: dict[str, list[str]] = {}
    for s in common:
        longer.setdefault(s[:-1], []).append(s)
    chosen: dict[str, float] = {}
    todo = sorted(s for s in common if len(s) == SHORTEST)
    while todo:
        stem = todo.pop()
        next_ones = longer.get(stem, [])
        if weight(stem) < math.log(LEAST_ODDS):
            todo += next_ones
        elif next_ones and len(next_ones) <= BRANCHES and sum(toxic[s] for s in next_ones) >= NEARLY * toxic[stem]:
            todo += next_ones
        else:
            chosen[stem] = weight(stem)
    return chosen


def covering(entries: dict[str, float], hits: list[list[str]]) -> dict[str, float]:
    """The entries that explain documents of their own, from the widest to the narrowest; hits has the entries in each document with the label."""
    of: dict[str, set[int]] = {e: set() for e in entries}
    for i, own in enumerate(hits):
        for e in own:
            of[e].add(i)
    kept, explained = {}, set()
    for e in sorted(entries, key=lambda e: (-len(of[e]), e)):
        if len(of[e] - explained) >= ALONE or len(of[e]) >= WIDE * len(hits):
            kept[e] = entries[e]
            explained |= of[e]
    return kept


def _count(known: set[str] | None):
    schema = pa.schema([("stem", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def told() -> pa.RecordBatch:
            flat = [(s, t, n) for t, c in counts.items() for s, n in c.items()]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = stems(set(fold(text).split()))
                counts[toxic].update(own if known is None else own & known)
                counts[toxic][""] += 1
            if sum(map(len, counts.values())) > 300_000:
                yield told()
        yield told()

    return rows


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic 0 or 1), whose number is brought down to about ``sample``.

    Rows with a null in a label's columns don't count. Without both labels the lexicon is empty and every score 0.
    """
    prepare(spark)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, labels.count()))
    drawn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))  # at most about ``sample`` rows of 16 bytes
    own = int_keyed(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic").dropDuplicates()

    def counted(frame: DataFrame, known: set[str] | None, least: int) -> DataFrame:
        return frame.select("text", "toxic").mapInArrow(_count(known), "stem string, toxic int, n long").groupBy("stem", "toxic").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("stem") == ""))

    toxic = {r["stem"]: r["n"] for r in counted(own.where("toxic = 1"), None, LEAST_DOCS).where("toxic = 1").collect()}
    n_toxic = toxic.pop("", 0)
    toxic = {s: n for s, n in toxic.items() if n >= LEAST_SHARE * n_toxic}
    other = {r["stem"]: r["n"] for r in counted(own.where("toxic = 0"), set(toxic), 1).where("toxic = 0").collect()}
    n_other = other.pop("", 0)
    if not n_toxic or not n_other:
        return Lexicon({})
    entries = choose_entries(toxic, other, n_toxic, n_other)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(stems(set(fold(t).split())) & entries.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["hits"])

    weights = covering(entries, [r["hits"] for r in own.where("toxic = 1").select("text").mapInArrow(hits, "hits array<string>").collect()])  # of the sample

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([own.evidence(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], names=["e", "toxic"])

    seen = own.mapInArrow(evidence, "e double, toxic int").collect()  # of the sample
    e, y = np.array([r["e"] for r in seen]), np.array([r["toxic"] for r in seen])
    floor = (y[e == 0].sum() + 0.5) / ((e == 0).sum() + 1)
    fits = []
    for rate in np.geomspace(0.02, 8, 40):
        p = np.clip(1 - (1 - floor) * np.exp(-rate * e), 1e-6, 1 - 1e-6)
        fits.append((float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), float(rate)))
    return Lexicon(weights, rate=max(fits)[1], floor=float(floor))


def score_texts(spark: SparkSession, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text); null and empty texts have the score of a text without hits.

    Texts are read whole, each row for itself, also with a null or repeated doc_id. An empty table gives no rows; further
    columns are ignored. With an empty lexicon every score is its floor.
    """
    prepare(spark)
    weights, rate, floor = lexicon.weights, lexicon.rate, lexicon.floor

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, rate=rate, floor=floor)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(own.evidence(t)) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return int_keyed(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns, whatever their names.

    Null and empty texts have no hits and stay; each row is judged by its text alone, so that repeated rows share their fate.
    """
    prepare(spark)
    weights, rate, floor = lexicon.weights, lexicon.rate, lexicon.floor

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, rate=rate, floor=floor)
        for batch in slices(batches):
            yield batch.filter(pa.array([own.score(own.evidence(t)) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
