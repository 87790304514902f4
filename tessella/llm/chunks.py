"""Cutting texts into chunks that a tokenizer encodes independently, with the ids of chunks remembered."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from tessella.llm.merging import PairTable, byte_letters, merge_rounds

#: Chunks remembered by each Python worker; at most as many characters in one that is.
CHUNK_CACHE, LONGEST_KEPT = 600_000, 64

_gap, _odd_gap = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


# Texts of plain letters, which case folding maps one to one and composition leaves alone, and over such
# letters the split patterns of word-end BPE vocabularies and of byte-level ones of this kind.
PLAIN_TEXT = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*").fullmatch
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\n 0-9a-zß-öø-ÿ]+").findall
SPACED_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\n 0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[\n ]+(?![^\n ])|[\n ]+").findall


class PlainWords:
    """Ids of texts of plain letters by a byte-pair vocabulary; pieces are remembered with their ids.

    The vocabulary is a lower-case one with word ends, or a byte-level one without, whose pieces keep the space before them.
    """

    def __init__(self, spec: dict):
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.pieces, self.lowers = (PLAIN_PIECES, True) if end else (SPACED_PIECES, False)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merges = PairTable(pairs)
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[c + tail] for c in letters], np.int64) for tail in ("", end))
        self.known: dict[str, bytes] = {}
        self.spaced = None if end else SpacedWords(self.merges, self.inner)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        letters = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.inner[letters], np.cumsum(sizes) - 1
        ids[ends] = self.last[letters[ends]]
        ids, bounds = merge_rounds(self.merges, ids, sizes)
        listed, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return {p: listed[a:b] for p, a, b in zip(pieces, bounds, bounds[1:])}

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if self.spaced:
            return self.spaced.texts(texts)
        cut = [self.pieces(t.lower() if self.lowers else t) for t in texts]
        if len(self.known) > CHUNK_CACHE:
            self.known.clear()
        told = self._learn(list(set(chain.from_iterable(cut)).difference(self.known)))
        long = {p: ids for p, ids in told.items() if len(p) > LONGEST_KEPT}
        self.known.update(told)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<u4") for c in cut]
        for p in long:
            del self.known[p]
        return out


# Kinds of the bytes of plain texts in Latin-1 (0 between texts, 1 white space, 2 digits, 3 letters, 4 all else).
_KINDS = bytes(0 if b == 0 else 1 if b in (10, 32) else 2 if 48 <= b < 58 else 3 if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 and b not in (0xD7, 0xF7) else 4 for b in range(256))
#: Bytes of a piece that is remembered, at most; logarithm of the number of slots, of which half are filled.
KEY_BYTES, SLOT_BITS = 24, 21
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIXES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def spaced_starts(joined: bytes) -> np.ndarray:
    """Where the pieces of ``SPACED_PIECES`` begin in plain texts in Latin-1 with a zero byte after each; each such byte is a piece too."""
    raw, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    starts = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    before = (kind[:-1] == 1) & (kind[1:] > 1)  # the last of a run of white space, before a solid character
    starts[:-1] |= before
    starts[1:] &= ~(before & (raw[:-1] == 32))
    at = np.flatnonzero((raw[:-1] == 39) & starts[:-1] & (kind[1:] == 3))
    a, b = raw[at + 1], raw[at + 2]
    two = (b == 101) & ((a == 114) | (a == 118)) | (a == 108) & (b == 108)
    size = np.where((a == 115) | (a == 116) | (a == 109) | (a == 100), 1, np.where(two, 2, 0))
    at, size = at[size > 0], size[size > 0]
    starts[at + 1] = False
    starts[at + 1 + size] = True
    return starts


class SpacedWords:
    """``PlainWords`` of a byte-level vocabulary in arrays: texts are cut, looked up and put together all at once.

    A remembered piece has a row of its bytes, as three numbers, and of the place and number of its ids in a pool; pieces that
    are longer, or that come when the table is full, are merged anew in each batch. Bytes are compared whole.
    """

    def __init__(self, merges: PairTable, letters: np.ndarray):
        self.merges, self.letters = merges, letters
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.rows, self.pool = np.zeros((1 << 16, 4), np.uint64), np.zeros(1 << 18, np.uint32)
        self.count = self.used = 0

    def _merged(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of pieces of raw."""
        ends = np.cumsum(sizes)
        signs = raw[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1])]
        wide = signs >= 128
        letters = np.repeat(signs, 1 + wide)
        lead = (np.arange(len(signs)) + np.cumsum(wide) - wide)[wide]
        letters[lead], letters[lead + 1] = 0xC0 | signs[wide] >> 6, 0x80 | signs[wide] & 63
        return merge_rounds(self.merges, self.letters[letters], np.add.reduceat(1 + wide.astype(np.int64), ends - sizes))

    def _find(self, keys: list[np.ndarray], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each piece's ids, and which pieces aren't known."""
        place, open_, unknown = np.zeros(len(slot), np.int64), None, []
        while open_ is None or len(open_):
            entry = self.slots.take(slot)
            held = self.rows.take(np.maximum(entry, 0), axis=0)
            hit = (entry >= 0) & (held[:, 0] == keys[0]) & (held[:, 1] == keys[1]) & (held[:, 2] == keys[2])
            own = held[:, 3].astype(np.int64)
            if open_ is None:
                place, open_ = np.where(hit, own, 0), np.arange(len(slot))
            else:
                place[open_[hit]] = own[hit]
            unknown.append(open_[entry < 0])
            go = (entry >= 0) & ~hit
            open_, keys, slot = open_[go], [k[go] for k in keys], slot[go] + 1 & (1 << SLOT_BITS) - 1
        return place, np.concatenate(unknown)

    def _insert(self, slot: np.ndarray, first: int) -> None:
        entry, left = np.arange(first, first + len(slot), dtype=np.int32), np.arange(len(slot))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = entry[free]
            left = left[self.slots[slot[left]] != entry[left]]
            slot[left] = slot[left] + 1 & (1 << SLOT_BITS) - 1

    def _room(self, rows: int, ids: int) -> None:
        if rows > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(rows - len(self.rows), len(self.rows)), 4), np.uint64)])
        if ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(ids - len(self.pool), len(self.pool)), np.uint32)])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.count >= 1 << SLOT_BITS - 1:
            self._clear()
        joined = "\0".join(texts).encode("latin-1") + b"\0"
        at = np.flatnonzero(spaced_starts(joined))
        sizes = np.diff(at, append=len(joined))
        padded = joined + bytes(KEY_BYTES + 8)
        words = np.ndarray((len(joined) + KEY_BYTES,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        keys = [words[at + 8 * i].astype(np.uint64) & _MASKS[np.clip(sizes - 8 * i, 0, 8)] for i in range(3)]
        mixed = keys[0] * _MIXES[0] ^ keys[1] * _MIXES[1] ^ keys[2] * _MIXES[2]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _MIXES[3]
        short = sizes <= KEY_BYTES
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place, unknown = self._find(keys, slot)
        gap, long = keys[0] == 0, np.flatnonzero(~short)
        unknown = unknown[short[unknown] & ~gap[unknown]]
        if len(unknown) or len(long):
            self._learn(np.frombuffer(joined, np.uint8), at, sizes, keys, mixed, slot, place, unknown, long)
        place[gap] = 0
        lengths, begins = place & 0xFFFFFFFF, place >> 32
        ends = np.cumsum(lengths)
        ids = self.pool.take(np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1]))
        return np.split(ids, ends[gap][:-1])

    def _learn(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray], mixed: np.ndarray, slot: np.ndarray, place: np.ndarray, unknown: np.ndarray, long: np.ndarray) -> None:
        """Puts the ids of unknown and long pieces into the pool and their places into place."""
        order = unknown[np.argsort(mixed[unknown], kind="stable")]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        heads = order[new]
        kept = max(0, min(len(heads), (1 << SLOT_BITS - 1) - self.count))
        every = np.concatenate([heads, long])
        ids, bounds = self._merged(raw, at[every], sizes[every])
        self._room(self.count + kept, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        told = self.used + bounds[:-1] << 32 | np.diff(bounds)
        place[order], place[long] = told[: len(heads)][np.cumsum(new) - 1], told[len(heads) :]
        rows = self.rows[self.count : self.count + kept]
        for i, k in enumerate(keys):
            rows[:, i] = k[heads[:kept]]
        rows[:, 3] = told[:kept].astype(np.uint64)
        self._insert(slot[heads[:kept]], self.count)
        self.count += kept
        self.used += int(bounds[kept])


class ChunkEncoder:
    """Ids of texts, chunk by chunk.

    ``encode`` gives the ids of a list of unknown chunks. A text is cut at single spaces before a non-space character;
    for a byte-level BPE with the usual split pattern no token crosses these places, as a piece takes at most the last
    space of a run, and only before a character that is no space. Such a tokenizer (``keeps_space``) has that space at the
    head of a chunk; for one that drops white space it is left out. Texts with a special token's string go through whole.
    ``plain``, if given, cuts texts of plain letters into pieces and has their ids by itself.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], specials: Sequence[str], keeps_space: bool, plain: PlainWords | None = None):
        self.encode, self.specials, self.head, self.plain = encode, tuple(specials), " " * keeps_space, plain
        self.known: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.encode(chunks)] if chunks else []

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if self.plain:
            easy = [bool(t) and PLAIN_TEXT(t) is not None and not any(s in t for s in self.specials) for t in texts]
            own, rest = iter(self.plain.texts([t for t, e in zip(texts, easy, strict=True) if e])), iter(self._texts([t for t, e in zip(texts, easy, strict=True) if not e]))
            return [next(own if e else rest) for e in easy]
        return self._texts(texts)

    def _texts(self, texts: list[str | None]) -> list[np.ndarray]:
        cut: list[list[str]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif any(s in text for s in self.specials):
                cut.append([text])
            elif self.head and _odd_gap.search(text):
                cut.append(_gap.split(text))
            else:
                cut.append(text.split(" "))
        known, head = self.known, self.head
        if len(known) > CHUNK_CACHE:
            known.clear()
        unknown = list(set(chain.from_iterable(c[1:] if head else c for c in cut)).difference(known))
        firsts = list({c[0] for c in cut if c}) if head else []
        told = self._ids([head + c for c in unknown] + firsts)
        first, once = dict(zip(firsts, told[len(unknown) :], strict=True)), {}
        for chunk, ids in zip(unknown, told, strict=False):
            if len(chunk) <= LONGEST_KEPT:
                known[chunk] = ids
            else:
                once[chunk] = ids
        get = known.__getitem__ if not once else lambda c: known[c] if c in known else once[c]
        out = [first[c[0]] + b"".join(map(get, c[1:])) if head and c else b"".join(map(get, c)) for c in cut]
        return [np.frombuffer(x, "<u4") for x in out]


_encoders: dict[str, ChunkEncoder] = {}


def _takes_plain_words(spec: dict) -> bool:
    """Whether a tokenizer cuts, folds and merges as ``PlainWords`` does."""
    model = spec["model"]
    plain = not (model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"])
    before = spec["pre_tokenizer"]
    if before["type"] == "ByteLevel":
        return plain and not (spec["normalizer"] or before["add_prefix_space"] or model["end_of_word_suffix"]) and before.get("use_regex", True)
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = before.get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    split = bool(cuts) and cuts[0].get("pattern") == {"Regex": pattern} and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
    return plain and steps == ["NFC", "Replace", "Lowercase"] and split and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and bool(model["end_of_word_suffix"])


def library_encoder(blob: str, name: str) -> ChunkEncoder:
    """An encoder by the tokenizers library from a tokenizer's JSON; one for each worker and name."""
    if name not in _encoders:
        tokenizer = Tokenizer.from_str(blob)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(blob)
        drops_space = spec["pre_tokenizer"]["type"] != "ByteLevel"

        def encode(chunks: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        _encoders[name] = ChunkEncoder(encode, specials, not drops_space, PlainWords(spec) if _takes_plain_words(spec) else None)
    return _encoders[name]

