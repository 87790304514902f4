"""N-gram Jaccard join by universe-partition pigeonhole.

Sets of word shingles link when their Jaccard similarity is at least a given
percentage. Sizes fall into bands such that linked sets lie in one band or in
neighbouring ones; a bucket joins a band with itself and the next. In a bucket
two linked sets differ in at most H elements. The universe is hashed into
segments; a segment is compared exactly (one differing element spoils it) or
with its one-deletion neighbourhood (two are needed). A set whose usable
segments weigh more than H therefore shares a signature with every set that it
links to. The number of segments and of those with deletions comes from a cost
model for each bucket. Sets whose segments weigh too little (small sets, mostly)
also index their prefix in hash order, by which any two such sets meet.

A group of sets with the same signature has a hub, its smallest. First each member is verified against its hub. Then,
hub by hub, members that are not in the hub's component are compared with all its members, in tiles of bounded size, so
that no pairs travel. Any two sets that share a signature are thus compared, unless they are in one component already.

What is compared first are parity sketches: a bit for the parity of each bin of the hashed elements. Bins that differ are
no more than elements that differ, so a pair whose sketches differ in more bins than a link allows is none. Only for what
is left are the sets themselves fetched, and every link is verified on them. Shingles are 64-bit hashes; a set has a name
of 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Stash, Words, components, int_keyed, join_hot, mix64, prepare, rolling, slices

#: Elements that a segment needs for its signature, and those with which a deletion still has as many.
LEAST, LEAST_DELETED = 2, 3
#: Shingles on one side of a tile of sets, and 64-bit words on one of a tile of sketches.
TILE, SKETCH_TILE = 400_000, 500_000
#: Words of a sketch at most.
MOST_WORDS = 1024
#: What a signature of a segment with two elements costs besides its row, as such are shared more often.
SHORT_COST = 3.0


@lru_cache(maxsize=8)
def band_edges(percent: int) -> np.ndarray:
    """The smallest size of each band: a size and the smallest that can't link with it are in different bands."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def _tail(rate: float, least: int) -> float:
    """Of a Poisson variable being at least so much."""
    return 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(least))


@lru_cache(maxsize=4096)
def plan_bucket(percent: int, band: int) -> tuple[int, int, int]:
    """(H, segments, how many of them with deletions) for the sets of a band joined with its own and the next.

    Of all allocations by which a set of the band's smallest size weighs H + 1 with a margin, the one with the fewest rows.
    """
    edges = band_edges(percent)
    small, large = int(edges[band]), int(edges[band + 1]) - 1
    partner = min(int(edges[band + 2]) - 1, large * 100 // percent)
    differ = (large + partner) * (100 - percent) // (100 + percent)
    best: tuple[float, int, int] | None = None
    for with_deletions in (0, 1, 2, 4, 8):
        for segments in sorted({max(1, with_deletions, math.ceil((differ + 1) * f)) for f in (0.3, 0.5, 0.75, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.6)}):
            rate = small / segments
            good, deleted = _tail(rate, LEAST), _tail(rate, LEAST_DELETED)
            plain = segments - with_deletions
            weight = plain * good + 2 * with_deletions * deleted
            spread = math.sqrt(plain * good * (1 - good) + 4 * with_deletions * deleted * (1 - deleted))
            short = math.exp(-rate) * rate * rate / 2
            rows = plain * good + with_deletions * (1 + rate) + SHORT_COST * segments * short
            if weight - 1.5 * spread >= differ + 1 and (best is None or rows < best[0]):
                best = (rows, segments, with_deletions)
    return (differ, *best[1:]) if best else (differ, max(1, differ + 1), 0)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the k-word shingles; the whole sequence as one if there are fewer words; empty without words."""
    words = Words(texts, lower=True)
    runs, out = rolling(words.hashes, k), []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        own = np.sort(runs[a : b - k + 1] if b - a >= k else rolling(words.hashes[a:b], b - a) if b > a else runs[:0])
        out.append(own[np.flatnonzero(np.diff(own, prepend=~own[:1]))])
    return out


def name_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set: equal sets, and (but for about n * n / 2**129 of n sets) only they, have the same."""
    if not len(shingles):
        return 0, 0
    sums = [mix64(shingles + np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93)]
    mixed = mix64(np.array(sums, np.uint64) ^ mix64(np.array([len(shingles)], np.uint64))).view(np.int64)
    return int(mixed[0]), int(mixed[1])


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of the bins of the elements: at least two bins an element, up to MOST_WORDS words; a power of two of words."""
    words = 1
    while words < MOST_WORDS and 64 * words < 2 * len(shingles):
        words *= 2
    bins = np.bincount((mix64(shingles ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits(bins & 1, bitorder="little").view(np.int64)


def _keys(low: np.ndarray, high: np.ndarray, bucket: np.ndarray, segment: np.ndarray) -> np.ndarray:
    place = mix64((bucket.astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64) + np.uint64(1))
    return mix64(mix64(low.astype(np.uint64) + place) + high.astype(np.uint64))


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of every signature of non-empty sets."""
    edges = band_edges(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    members, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    mixed = mix64(members)
    where = mix64(members ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(20)
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
    bands = np.searchsorted(edges, sizes, "right") - 1
    out_set, out_key = [], []
    for role in (0, 1):
        used = np.flatnonzero(bands >= role)
        if not len(used):
            continue
        plans = np.zeros((len(sets), 3), np.int64)
        plans[used] = [plan_bucket(percent, int(b) - role) for b in bands[used]]
        bucket = bands - role
        base = np.concatenate([[0], np.cumsum(plans[:, 1])])
        keep = slice(None) if len(used) == len(sets) else np.isin(owner, used)
        o = owner[keep]
        segment = (where[keep] % np.maximum(plans[o, 1], 1).astype(np.uint64)).astype(np.int64)
        cell = base[o] + segment
        total = int(base[-1])
        count = np.bincount(cell, minlength=total)
        sum_low, sum_high = np.bincount(cell, low[keep], total), np.bincount(cell, high[keep], total)
        of = np.repeat(np.arange(len(sets)), plans[:, 1])
        index = np.arange(total) - base[of]
        deletes = index < plans[of, 2]
        weigh = np.where(deletes, 2 * (count >= LEAST_DELETED), count >= LEAST)
        weight = np.bincount(of, weigh, len(sets))
        good = np.flatnonzero(count >= LEAST)
        out_set.append(of[good])
        out_key.append(_keys(sum_low[good], sum_high[good], bucket[of[good]], index[good]))
        gone = np.flatnonzero(deletes[cell] & (count[cell] >= LEAST_DELETED))
        if len(gone):
            c = cell[gone]
            out_set.append(of[c])
            out_key.append(_keys(sum_low[c] - low[keep][gone], sum_high[c] - high[keep][gone], bucket[of[c]], index[c]))
        for i in used[weight[used] <= plans[used, 0]]:
            n = int(sizes[i])
            first = np.sort(mix64(sets[i]))[: n - -(-n * percent // 100) + 1]
            out_set.append(np.full(len(first), i))
            out_key.append(mix64(first ^ mix64(np.full(1, (int(bucket[i]) << 8) + 255, np.uint64))))
    return np.concatenate(out_set), np.concatenate(out_key)


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, kind)]).view(np.int64)))


def _set_rows(k: int, with_sets: bool):
    """Size, name and sketch of each text's set, or its name and elements."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            names = np.array([name_of(s) for s in sets], np.int64).reshape(-1, 2)
            own = [("node", pa.array(names[:, 0])), ("other", pa.array(names[:, 1]))]
            if with_sets:
                own.append(("shingles", _lists(sets, np.uint64)))
            else:
                own += [("doc_id", batch.column("doc_id")), ("h", batch.column("h")), ("n_shingles", pa.array([len(s) for s in sets], pa.int64())), ("sketch", _lists([sketch_of(s) for s in sets], np.int64))]
            yield pa.RecordBatch.from_arrays([c for _, c in own], names=[n for n, _ in own])

    return rows


def _signature_rows(k: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            sets = [s for s in shingle_sets(batch.column("text"), k) if len(s)]
            if not sets:
                continue
            nodes = np.array([name_of(s)[0] for s in sets], np.int64)
            owner, key = signatures(sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[owner])], names=["key", "node"])

    return rows


def _folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches (one a row) of half the bins."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _may_link(percent: int):
    """The rows of a tile (left or right) that have a partner on the other side, in another component, whose sketch and size allow a link."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        is_left, root, sizes = pdf["is_left"].to_numpy(), pdf["root"].to_numpy(), pdf["n_shingles"].to_numpy()
        sketches = pdf["sketch"].to_numpy()
        words = np.fromiter(map(len, sketches), np.int64, len(sketches))
        flagged = np.zeros(len(pdf), bool)
        rights = {int(w): (at := np.flatnonzero(~is_left & (words == w)), np.stack(sketches[at])) for w in np.unique(words[~is_left])}
        for w in np.unique(words[is_left]).tolist():
            own = np.flatnonzero(is_left & (words == w))
            mine = np.stack(sketches[own])
            for other in {w // 2, w, 2 * w} & rights.keys():
                at, theirs = rights[other]
                a, b = (_folded(mine) if other < w else mine), (_folded(theirs) if other > w else theirs)
                for i, sketch in zip(own.tolist(), a, strict=True):
                    apart = (root[at] != root[i]) & (100 * np.minimum(sizes[at], sizes[i]) >= percent * np.maximum(sizes[at], sizes[i]))
                    near = np.flatnonzero(apart)
                    differ = np.bitwise_count((b[near] ^ sketch).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    near = near[differ * (100 + percent) <= (sizes[at[near]] + sizes[i]) * (100 - percent)]
                    if len(near):
                        flagged[i] = flagged[at[near]] = True
        return pdf.loc[flagged, ["hub", "i", "j", "is_left", "id", "root"]]

    return rows


def _verify_tile(percent: int):
    """Pairs of components that a link between a left and a right set of the tile joins."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        is_left, root = pdf["is_left"].to_numpy(), pdf["root"].to_numpy()
        sets = pdf["shingles"].to_numpy()
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        sizes = np.array([len(sets[r]) for r in right], np.int64)
        elements, owner = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        found = set()
        for i in left:
            own = np.sort(sets[i])
            a, b = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
            n = b - a
            hits = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(right))
            linked = (100 * both >= percent * (len(own) + sizes - both)) & (root[right] != root[i])
            found |= {(int(root[i]), int(x)) for x in np.unique(root[right[linked]])}
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return rows


#: Pairs with one hub that are verified together.
SPREAD = 2000
#: SQL: the bins in which sketches a and b differ; of two sizes the larger is folded to the smaller.
_FOLD = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
_DIFFER = f"aggregate(zip_with({_FOLD.format('a', 'b')}, {_FOLD.format('b', 'a')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def similar_groups(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document of docs (doc_id, text).

    Words are lower-cased by A-Z only. A document with fewer than k words has its whole sequence as one shingle. Null
    and empty texts, and texts without a word, have an empty set, link with nothing and are their own component.
    component_id is the smallest doc_id reachable by links. Repeated rows each get a row; a null doc_id keeps its row
    and is never a component's name unless no other member has an id; where none has, component_id is null. Texts of any
    length are taken whole, a set lives in one row. Further columns of docs are ignored; an empty table gives no rows.
    """
    prepare(spark)
    docs = int_keyed(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = Stash(spark, docs.mapInArrow(_set_rows(k, False), "node long, other long, doc_id long, h long, n_shingles long, sketch array<long>"))
    full = rows.df.where("n_shingles > 0")
    signed = docs.select("text").mapInArrow(_signature_rows(k, percent), "key long, node long")
    group = Window.partitionBy("key")
    shared = signed.withColumns({"hub": F.min("node").over(group), "top": F.max("node").over(group)}).where("hub <> top")
    groups = Stash(spark, shared.select("hub", "node").distinct())

    involved = full.join(groups.df.select("node").distinct(), "node", "left_semi").groupBy("node", "other").agg(F.min("h").alias("h"), F.max("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    heads = Stash(spark, involved.withColumn("id", F.monotonically_increasing_id()))  # one row a set; the ids are fixed by writing them
    members = Stash(spark, groups.df.join(heads.df.select("node", "id"), "node").select("hub", "id"))
    sizes = members.df.groupBy("hub").agg(F.count("*").alias("members"))
    total = members.df.count()
    hubs = heads.df.join(sizes.withColumnRenamed("hub", "node"), "node").select(F.col("node").alias("hub"), F.col("id").alias("hub_id"), F.col("n_shingles").alias("na"), F.col("sketch").alias("a"), "members")

    def sets_of(ids: DataFrame) -> Stash:
        """(id, n_shingles, shingles) of these sets, from the texts that have them."""
        wanted = heads.df.join(ids.distinct(), "id", "left_semi").select("id", "node", "other", "h")
        texts = docs.join(wanted.select("h").distinct(), "h", "left_semi")
        found = texts.select("text").mapInArrow(_set_rows(k, True), "node long, other long, shingles array<long>").dropDuplicates(["node", "other"])
        return Stash(spark, found.join(wanted, ["node", "other"]).select("id", F.size("shingles").cast("long").alias("n_shingles"), "shingles"))

    theirs = heads.df.select("id", F.col("n_shingles").alias("nb"), F.col("sketch").alias("b"))
    stars = join_hot(members.df, hubs, ["hub"], "members", total).where("id <> hub_id").join(theirs, "id")
    near = Stash(spark, stars.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(f"{_DIFFER} * {100 + percent} <= (na + nb) * {100 - percent}").select("hub_id", "id").distinct())
    held = sets_of(near.df.select("id").unionByName(near.df.select(F.col("hub_id").alias("id"))))
    busy = near.df.groupBy("hub_id").agg((F.floor(F.count("*") / SPREAD) + 1).cast("int").alias("spread"))
    left = held.df.select("id", F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    right = busy.join(held.df.select(F.col("id").alias("hub_id"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa")), "hub_id")
    dealt = near.df.join(busy, "hub_id").select("hub_id", "id", F.pmod(F.xxhash64("id"), "spread").cast("int").alias("part"))
    both = dealt.join(left, "id").join(right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))), ["hub_id", "part"])
    linked = both.withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long")).where(f"100 * both >= {percent} * (na + nb - both)")
    roots = components(spark, linked.select(F.col("hub_id").alias("a"), F.col("id").alias("b")))
    near.drop()
    held.drop()

    root_of = roots.withColumnsRenamed({"node": "id"})
    rooted = heads.df.join(root_of, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n_shingles", F.size("sketch").alias("words"))
    homes = hubs.groupBy("hub").agg(F.min("hub_id").alias("id"), F.max("members").alias("members")).join(rooted.select("id", F.col("root").alias("own")), "id").select("hub", "own", "members")
    sized = Stash(spark, join_hot(members.df, homes, ["hub"], "members", total).join(rooted, "id").withColumn("apart", F.expr("root <> own")))

    def tiles(rows: DataFrame, amount: str, room: int) -> DataFrame:
        """The rows of each hub as a left side, those apart, and a right side, all, dealt to tiles of bounded size."""
        loads = rows.groupBy("hub").agg(*(F.ceil(F.sum(F.expr(f"if({cond}, {amount}, 0)")) / room).cast("int").alias(name) for name, cond in (("lefts", "apart"), ("rights", "true"))), F.count("*").alias("n")).where("lefts > 0")
        placed = join_hot(rows, loads, ["hub"], "n", total)
        deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        lefts = placed.where("apart").select("hub", deal("lefts", 1).alias("i"), span("rights").alias("j"), F.lit(True).alias("is_left"), "id", "root")
        return lefts.unionByName(placed.select("hub", span("lefts").alias("i"), deal("rights", 2).alias("j"), F.lit(False).alias("is_left"), "id", "root"))

    sketched = tiles(sized.df, "words", SKETCH_TILE).join(heads.df.select("id", "n_shingles", "sketch"), "id")
    flagged = Stash(spark, sketched.groupBy("hub", "i", "j").applyInPandas(_may_link(percent), "hub long, i int, j int, is_left boolean, id long, root long"))
    if not flagged.df.isEmpty():
        late = sets_of(flagged.df.select("id"))
        # a tile of flagged rows is dealt again, by the sizes of its sets; "hub" now names the sketches' tile
        again = flagged.df.select(F.xxhash64("hub", "i", "j").alias("tile"), "is_left", "id", "root").join(late.df.select("id", "n_shingles"), "id")
        loads = again.groupBy("tile").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.expr(f"if({cond}, n_shingles, 0)")) / TILE)).cast("int").alias(name) for name, cond in (("lefts", "is_left"), ("rights", "NOT is_left"))))
        placed = again.join(loads, "tile")
        mine, other = F.col("is_left"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        slot = lambda n, salt: F.array(F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int"))
        spread = placed.withColumn("x", F.explode(F.when(mine, slot("lefts", 3)).otherwise(other("lefts")))).withColumn("y", F.explode(F.when(mine, other("rights")).otherwise(slot("rights", 4))))
        links = spread.select("tile", "x", "y", "is_left", "id", "root").join(late.df.select("id", "shingles"), "id").groupBy("tile", "x", "y").applyInPandas(_verify_tile(percent), "a long, b long").distinct()
        more = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
        roots = components(spark, more)
        late.drop()
    for used in (groups, members, sized, flagged):
        used.drop()

    names = full.groupBy("node", "other").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    rooted = roots.select(F.col("node").alias("id"), "root").join(heads.df.select("id", "node", "other"), "id").select("node", "other", "root")
    smallest = names.join(rooted, ["node", "other"]).groupBy("root").agg(F.min("doc").alias("least"))
    told = names.join(rooted.join(smallest, "root").drop("root"), ["node", "other"], "left")
    table = told.select("node", "other", F.coalesce("least", "doc").alias("component_id"), "copies")
    joined = join_hot(full.select("node", "other", "doc_id", "n_shingles"), table, ["node", "other"], "copies", full.count())
    return joined.select("doc_id", "n_shingles", "component_id").unionByName(rows.df.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_similar(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose component has a smaller doc_id.

    Of rows that repeat a doc_id one stays, the one with the smallest hash of its text; rows with a null doc_id all stay.
    Texts without words are groups of their own. All columns of docs are returned, whatever their names; an empty table
    gives an empty one.
    """
    kept = Stash(spark, similar_groups(spark, docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()).df
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeats = Stash(spark, repeats.join(kept, "doc_id", "left_semi")).df
    once = docs.join(kept.join(repeats, "doc_id", "left_anti"), "doc_id", "left_semi").select(docs.columns)
    stays = once.unionByName(docs.where("doc_id IS NULL"))
    if repeats.isEmpty():
        return stays
    row = F.struct(*docs.columns)
    chosen = docs.join(repeats, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("row"))
    return stays.unionByName(chosen.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
