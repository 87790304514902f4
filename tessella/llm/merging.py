"""Byte-pair merging of many words at once, in arrays."""

from __future__ import annotations

import numpy as np

NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Rank and product of the merge of a pair, looked up in arrays: a table, and a second one without collisions for what collides in it.

    A slot holds the pair and its rank in one number; a pair whose slot of the first table is empty is in neither.
    """

    SLOTS = 1 << 20

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        #: The product of each rank.
        self.made = np.zeros(int(values[:, 0].max(initial=-1)) + 1, np.int64)
        self.made[values[:, 0]] = values[:, 1]
        if len(self.made) > 1 << 20:
            raise ValueError("more merges than ranks of 20 bits tell apart")
        self.tables = []
        factor = 0x9E3779B97F4A7C15
        while len(keys) or len(self.tables) < 2:
            factor = (factor * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
            slot = self._slot(keys, factor)
            _, kept = np.unique(slot, return_index=True)
            if self.tables and len(kept) < len(keys):
                continue
            held = np.full(self.SLOTS, -1, np.int64)
            held[slot[kept]] = keys[kept] << 20 | values[kept, 0]
            self.tables.append((factor, held))
            keys, values = np.delete(keys, kept), np.delete(values, kept, axis=0)

    def _slot(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(44)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER if it has none."""
        key = (a << 20) | b
        factor, held = self.tables[0]
        got = held.take(self._slot(key, factor))
        hit = got >> 20 == key
        rank = np.where(hit, got & 0xFFFFF, NEVER)
        left = np.flatnonzero((got >= 0) & ~hit)
        if len(left):
            factor, held = self.tables[1]
            got = held.take(self._slot(key[left], factor))
            hit = got >> 20 == key[left]
            rank[left[hit]] = got[hit] & 0xFFFFF
        return rank

    def get(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.rank(a, b)
        return rank, self.made.take(np.where(rank == NEVER, 0, rank), mode="clip") if len(self.made) else np.zeros(len(rank), np.int64)


def merge_rounds(merges: PairTable, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds of each word in them) after merging words of these sizes, whose letters' ids are given one after another.

    Each round merges the pair of the lowest rank in every word, of overlapping pairs the left ones.
    """
    words = len(sizes)
    owner = np.repeat(np.arange(words), sizes)
    done_ids, done_owner = [ids[:0]], [owner[:0]]

    def ranks(at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(ids) - 1)
        rank = merges.rank(ids[at], ids[after])
        rank[(owner[after] != owner[at]) | (after == at)] = NEVER
        return rank

    if len(ids):
        rank = ranks(np.arange(len(ids)))
    while len(ids):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lengths = np.diff(starts, append=len(ids))
        low = np.minimum.reduceat(rank, starts)
        more = np.repeat(low < NEVER, lengths)
        if not more.all():
            done_ids.append(ids[~more])
            done_owner.append(owner[~more])
            ids, owner, rank, lengths, low = ids[more], owner[more], rank[more], lengths[low < NEVER], low[low < NEVER]
            if not len(ids):
                break
        at = np.flatnonzero(rank == np.repeat(low, lengths))
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        if len(run) < len(at):
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
        ids[at] = merges.made[rank[at]]
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids, owner, rank = ids[stays], owner[stays], rank[stays]
        at -= np.arange(len(at))
        new = np.zeros(len(ids), bool)
        new[at] = new[np.maximum(at - 1, 0)] = True
        touched = np.flatnonzero(new)
        rank[touched] = ranks(touched)
    ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(words + 1))
