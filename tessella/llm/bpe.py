"""Byte-level BPE that speculates and verifies, and its decoder.

Words are cut by greedy longest match in one Aho-Corasick pass. BPE gives exactly
those tokens if each of them encodes to itself and each adjacent pair is
compatible: no merge across their border can come before the merges that close the
border. All pairs are tested at once, in arrays. Only words with a failing pair are
merged rank by rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chunks import ChunkEncoder
from tessella.llm.common import int_keyed, mix64, prepare, slices
from tessella.llm.merging import NEVER, PairTable, byte_letters, merge_rounds

# The split pattern of byte-level BPE vocabularies of this kind, white space spelt out.
SPACE = r"[\t-\r \x85\xa0  -     　]"
SOLID = SPACE.replace("[", "[^", 1)
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r \x85\xa0  -     　\p{{L}}\p{{N}}]+|{SPACE}+(?!{SOLID})|{SPACE}+"

#: Slots that remember tested pairs.
PAIR_SLOTS = 1 << 20


class SpeculativeBPE:
    """Encoder and decoder from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        value = {c: bytes([b]) for b, c in enumerate(letters)}
        self.letter_of = {b: c for b, c in enumerate(letters)}
        count = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * count
        for token, i in vocab.items():
            self.token_bytes[i] = b"".join(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.left, self.right, self.rank = np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.pairs:
                self.pairs[x, y] = rank, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        self.merges = PairTable(self.pairs)
        self.first = np.zeros(512, np.int64)  # the token of each letter
        for c in letters:
            self.first[ord(c)] = vocab[c]
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if all(c in value for c in token) and self.exact(token) == [i]:  # others are never made by merging
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.slot_keys, self.slot_fine = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.pattern = regex.compile(PIECES)
        self.failed = self.pieces_seen = 0

    def exact(self, word: str) -> list[int]:
        """Merging by rank, leftmost first; word in letters."""
        ids = [self.vocab[c] for c in word]
        get = self.pairs.get
        while len(ids) > 1:
            rank, pair = min((get((a, b), (NEVER, 0))[0], (a, b)) for a, b in zip(ids, ids[1:]))
            if rank == NEVER:
                break
            made, out, i = self.pairs[pair][1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """``exact`` for many words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, bounds = merge_rounds(self.merges, self.first[np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)], sizes)
        listed, bounds = ids.tolist(), bounds.tolist()
        return [listed[a:b] for a, b in zip(bounds, bounds[1:])]

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart: undoes their merges from the last on and looks for an earlier merge across."""
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER - 1), np.full(len(a), NEVER - 1)
        while len(live):
            rank = self.merges.get(x, y)[0]
            across = (rank < until_x) & (rank <= until_y)  # of equal ranks the left pair merges first
            fine[live[across]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~across & ((rx >= 0) | (ry >= 0))
            live, x, y, until_x, until_y, rx, ry = (v[go] for v in (live, x, y, until_x, until_y, rx, ry))
            undo_x = rx > ry
            until_x, until_y = np.where(undo_x, rx, until_x), np.where(undo_x, until_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return fine

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_test`` with remembered results."""
        key = (a << 20) | b
        slot = (mix64(key.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        known = self.slot_keys[slot] == key
        fine = self.slot_fine[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            tested = self._test(new >> 20, new & ((1 << 20) - 1))
            fine[~known] = tested[back]
            at = (mix64(new.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
            order = np.unique(at, return_index=True)[1]
            self.slot_keys[at[order]], self.slot_fine[at[order]] = new[order], tested[order]
        return fine

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces, given in letters."""
        joined = "\n".join(pieces)  # a line feed has another letter, so it is in no token
        ids, ends = [], []
        for end, (i, _) in self.automaton.iter_long(joined):
            ids.append(i)
            ends.append(end)
        ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(sizes + 1) - 2  # of each piece
        owner = np.searchsorted(last, ends)
        first = np.searchsorted(owner, np.arange(len(pieces) + 1))
        starts_fine = np.ones(len(pieces), bool)
        if len(ids) > 1:
            inner = owner[1:] == owner[:-1]
            fine = self.compatible(ids[:-1][inner], ids[1:][inner])
            starts_fine[owner[1:][inner][~fine]] = False
        lengths = np.fromiter((len(self.token_bytes[i]) for i in ids.tolist()), np.int64, len(ids))
        starts_fine &= np.bincount(owner, lengths, len(pieces)).astype(np.int64) == sizes
        listed, bounds = ids.tolist(), first.tolist()
        self.pieces_seen += len(pieces)
        self.failed += int((~starts_fine).sum())
        wrong = np.flatnonzero(~starts_fine).tolist()
        merged = dict(zip(wrong, self.merge_words([pieces[p] for p in wrong]), strict=True))
        return [merged[p] if p in merged else listed[bounds[p] : bounds[p + 1]] for p in range(len(pieces))]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of text; the strings of special tokens give their ids."""
        special = {i for i, c in enumerate(chunks) if any(s in c for s in self.specials)} if any(s in "".join(chunks) for s in self.specials) else ()
        cut = list(map(self.pattern.findall, ["" if i in special else c for i, c in enumerate(chunks)] if special else chunks))
        distinct = list(set(chain.from_iterable(cut)))
        known = dict(zip(distinct, self.encode_pieces(self.in_letters(distinct)), strict=True)) if distinct else {}
        out = [known[c[0]] if len(c) == 1 else list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]
        for i in special:
            parts = [chunks[i]]
            for s in self.specials:
                parts = [q for p in parts for q in ([p] if p in self.specials else self._around(p, s))]
            out[i] = list(chain.from_iterable([self.specials[p]] if p in self.specials else self.encode_chunks([p])[0] for p in parts))
        return out

    def in_letters(self, pieces: list[str]) -> list[str]:
        """Pieces with a letter for each byte, made in one go and cut by their lengths in bytes."""
        raw = [p.encode() for p in pieces]
        told, ends = b"".join(raw).decode("latin-1").translate(self.letter_of), list(accumulate(map(len, raw)))
        return [told[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _around(text: str, special: str) -> list[str]:
        parts = text.split(special)
        return [x for i, p in enumerate(parts) for x in ([special] if i else []) + ([p] if p else [])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Decimals(dict):
    def __missing__(self, i: int) -> str:
        self[i] = told = str(i)
        return told


_decimal = _Decimals()
_codecs: dict[str, tuple[SpeculativeBPE, ChunkEncoder]] = {}


def codec(blob: str) -> tuple[SpeculativeBPE, ChunkEncoder]:
    """One for each worker and vocabulary."""
    name = hashlib.sha256(blob.encode()).hexdigest()
    if name not in _codecs:
        bpe = SpeculativeBPE(blob)
        _codecs[name] = bpe, ChunkEncoder(bpe.encode_chunks, tuple(bpe.specials), keeps_space=True)
    return _codecs[name]


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs (doc_id, text); tokenizer is the path of a byte-level BPE's JSON.

    ids are those of the tokenizers library without added special tokens; strings of special tokens in a text give their
    ids. Null texts are empty and have no ids. Each row stands for itself, also with a null or repeated doc_id. Texts may
    hold any characters and are taken whole, a long one in one piece. An empty table gives no rows; further columns are
    ignored.
    """
    return _coded(spark, docs, tokenizer, "doc_id long, ids array<int>, decoded string", lambda ids, decoded: [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())])


def encode_decode_digests(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``, without moving ids and texts."""

    def digests(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
        told = [",".join(map(_decimal.__getitem__, x)) for x in ids]
        return [pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in told], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]

    return _coded(spark, docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _coded(spark: SparkSession, docs: DataFrame, tokenizer: str, schema: str, tell) -> DataFrame:
    prepare(spark)
    with open(tokenizer, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())  # a vocabulary of a few MB
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = codec(blob.value)
        for batch in slices(batches, 2 << 20):
            ids = [x.tolist() for x in encoder.texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *tell(ids, [bpe.decode(x) for x in ids])], names=names)

    return int_keyed(docs, "doc_id", "text").mapInArrow(rows, schema)
