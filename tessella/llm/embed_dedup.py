"""Embedding near-dedup by subspace pigeonhole.

Unit vectors with cosine >= t are at a squared distance of at most 2 - 2t. After a
rotation the dimensions are split into blocks; some block then holds at most its
share of that distance, shares being in proportion to the blocks' variance. Each
block is range-joined under its budget: a k-d tree, fitted on a bounded sample,
cuts the block's space into leaves; a vector lives in one leaf and visits every
later leaf whose box is within its range. How many blocks and leaves come from a
cost model on the sample. Leaves are joined in tiles of bounded size, first on the
block's own dimensions. Only vectors that have a candidate there travel whole; their
pairs are verified exactly, and a pair counts in the first block that lets it through,
so that no union of pairs needs to be built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Stash, components, int_keyed, join_hot, prepare, slices

#: Blocks and leaves of a block that the cost model chooses from.
BLOCKS, LEAVES = (4, 8, 16), tuple(4**i for i in range(9))
#: Rows of a tile's side; rows of the sample that rotation and trees are fitted on, at least, at most and as a share of all; those of it that a leaf needs.
TILE, LEAST_SAMPLE, MOST_SAMPLE, SAMPLE_SHARE, LEAF_SAMPLE = 16_384, 8192, 65_536, 128, 16
#: The cost model's nanoseconds: of a row that visits a leaf, of a pair that is compared, and of one of its dimensions.
ROW_COST, PAIR_COST, DIMENSION_COST = 4000.0, 1.0, 0.06
#: Sampled vectors whose visits the cost model counts.
PROBES = 512
#: Room for rounding in distances, of doubles and of the 32-bit parts that tiles compare first.
SLACK, SHORT_SLACK = 1e-9, 1e-5


def usable(dims: int) -> Column:
    """Whether a row has an id and a vector of the right length without null or non-finite components and not all zero."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(x) == dims) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Space:
    """Rotation, blocks with their budgets, and a tree of cuts for each block."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, blocks: int, leaves: int):
        dims = sample.shape[1]
        blocks = min(blocks, dims)
        unit = units(sample) if len(sample) else np.empty((0, dims))
        _, axes = np.linalg.eigh(unit.T @ unit + np.eye(dims) * 1e-12)
        order = np.argsort(np.arange(dims) % blocks, kind="stable")  # leading directions are spread over the blocks
        self.rotation = axes[:, ::-1][:, order]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(np.arange(dims) % blocks, minlength=blocks))])
        turned = unit @ self.rotation
        spread = np.array([turned[:, a:b].var(axis=0).sum() + 1e-6 for a, b in self.sides()]) if len(unit) else np.ones(blocks)
        self.cosine = cosine
        self.budgets = (2 - 2 * cosine) * spread / spread.sum() + SLACK
        self.trees = [self._tree(turned[:, a:b], leaves) for a, b in self.sides()]
        probes = turned[:PROBES]
        self.cost = 0.0
        for block, (a, b) in enumerate(self.sides() if len(probes) else ()):
            visits = len(self.visits(block, probes[:, a:b])[0]) / len(probes)
            self.cost += total * visits * (ROW_COST + total / self.counts[block] * (PAIR_COST + DIMENSION_COST * (b - a)))

    def sides(self) -> list[tuple[int, int]]:
        return list(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True))

    def _tree(self, points: np.ndarray, leaves: int) -> list:
        """[axis, cut, left, right], or the number of a leaf."""
        self._next = 0

        def leaf() -> int:
            self._next += 1
            return self._next - 1

        def grow(own: np.ndarray, want: int):
            if want < 2 or len(own) < 4:
                return leaf()
            axis = int(own.var(axis=0).argmax())
            cut = float(np.median(own[:, axis]))
            low = own[:, axis] < cut
            if not low.any() or low.all():
                return leaf()
            return [axis, cut, grow(own[low], want // 2), grow(own[~low], want - want // 2)]

        tree = grow(points, leaves)
        self.counts = [*getattr(self, "counts", []), self._next]
        return tree

    def visits(self, block: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it lives there) for each point's own leaf and each later one whose box is within its range.

        Of two points within range of each other in different leaves, the one in the earlier leaf thus visits the other's.
        """
        budget = float(self.budgets[block]) + SLACK
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        low, high = np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf)

        def walk(node, rows: np.ndarray, far: np.ndarray, home: np.ndarray) -> None:
            """far: squared distances of the rows to the node's box; home: whether they are in it."""
            if not len(rows):
                return
            if isinstance(node, int):
                out.append((rows, node, home))
                return
            axis, cut, left, right = node
            at = points[rows, axis]
            before = np.maximum(np.maximum(low[axis] - at, at - high[axis]), 0.0) ** 2
            over = far - before + np.maximum(np.maximum(low[axis] - at, at - cut), 0.0) ** 2
            goes = (over <= budget) & (home <= (at < cut))  # a later leaf's point doesn't come back
            held, high[axis] = high[axis], cut
            walk(left, rows[goes], over[goes], (home & (at < cut))[goes])
            high[axis] = held
            over = far - before + np.maximum(np.maximum(cut - at, at - high[axis]), 0.0) ** 2
            goes = over <= budget
            held, low[axis] = low[axis], cut
            walk(right, rows[goes], over[goes], (home & (at >= cut))[goes])
            low[axis] = held

        walk(self.trees[block], np.arange(len(points)), np.zeros(len(points)), np.ones(len(points), bool))
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), n) for r, n, _ in out]), np.concatenate([h for *_, h in out])

    def block_distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.add.reduceat((a - b) ** 2, self.edges[:-1], axis=1)


def best_space(sample: np.ndarray, total: int, cosine: float) -> Space:
    """Of the blocks and leaves to choose from, those that cost least."""
    most = max(1, min(len(sample) // LEAF_SAMPLE, total // 1024))
    return min((Space(sample, total, cosine, blocks, leaves) for blocks in BLOCKS for leaves in LEAVES if leaves <= most), key=lambda s: s.cost)


def _visit_rows(space: Space):
    """Each vector's visits with its part in the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            turned = units(_matrix(batch.column("x"))) @ space.rotation
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for block, (a, b) in enumerate(space.sides()):
                row, leaf, home = space.visits(block, turned[:, a:b])
                parts = turned[:, a:b].astype(np.float32)[row]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * (b - a)), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(home), pa.array(ids[row]), lists], names=["block", "leaf", "home", "vec_id", "part"])

    return rows


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 1))


def _near(left: np.ndarray, right: np.ndarray, budget: float, ids: np.ndarray, at_left: np.ndarray, at_right: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left row, right row) of the pairs within budget, a few hundred left rows at a time; of two rows that live in the leaf the one with the smaller id is left."""
    n_right = (right * right).sum(1)
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        near = own @ right.T
        near *= -2
        near += n_right
        i, j = np.nonzero(near <= (budget - (own * own).sum(1))[:, None])
        x, y = at_left[at + i], at_right[j]
        good = ~home[y] | (ids[x] < ids[y])
        yield x[good], y[good]


def _candidates(space: Space):
    """For a tile (rows that live in a leaf by these and its visitors): the rows that have a partner within the block's budget."""

    def rows(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, is_left, home = (table.column(c).to_numpy() for c in ("vec_id", "is_left", "home"))
        parts = _matrix(table.column("part").combine_chunks())
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        flagged = np.zeros(len(ids), bool)
        for x, y in _near(parts[left], parts[right], float(space.budgets[block]) + SHORT_SLACK, ids, left, right, home):
            flagged[x] = flagged[y] = True
        return table.drop_columns(["part"]).filter(pa.array(flagged))

    return rows


def _join_tile(space: Space):
    """For a tile of whole vectors: links of each vector and its smallest partner's group in this tile."""

    def rows(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        side = slice(*space.sides()[block])
        ids, is_left, home, weight = (table.column(c).to_numpy() for c in ("vec_id", "is_left", "home", "copies"))
        unit = units(_matrix(table.column("x").combine_chunks()))
        turned = unit @ space.rotation
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        counts, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in _near(turned[left, side], turned[right, side], space.budgets[block] + 2 * SLACK, ids, left, right, home):
            for part in range(0, len(i), 65_536):
                x, y = i[part : part + 65_536], j[part : part + 65_536]
                good = np.einsum("ij,ij->i", unit[x], unit[y]) >= space.cosine
                x, y = x[good], y[good]
                if not len(x):
                    continue
                within = space.block_distances(turned[x], turned[y]) <= space.budgets + SLACK
                mine = within.argmax(axis=1) == block
                x, y = x[mine], y[mine]
                counts += np.bincount(x, weight[y], len(ids)).astype(np.int64) + np.bincount(y, weight[x], len(ids)).astype(np.int64)
                pairs = np.unique(np.stack([parent[x], parent[y]]), axis=1)
                for u, v in pairs.T:
                    if (u := find(u)) != (v := find(v)):
                        parent[max(u, v)] = min(u, v)
                for u in np.unique(np.concatenate([x, y])):
                    parent[u] = find(u)
        found = np.flatnonzero(counts)
        names = np.array([ids[find(i)] for i in found], np.int64)
        return pa.table({"vec_id": ids[found], "links": counts[found], "mate": names})

    return rows


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Two vectors link when their cosine in double precision is at least ``cosine`` (over 0). Vectors that are null, zero,
    of another length than most, or hold null or non-finite components link with nothing. Equal vectors are joined once
    and link with each other. Rows that repeat a vec_id count as copies of their own; a null vec_id keeps its row,
    without links. component_id is the smallest vec_id reachable by links. An empty table gives no rows; further columns
    are ignored.
    """
    prepare(spark)
    vectors = int_keyed(vectors, "vec_id", "embedding")
    dims = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = vectors.where(usable(dims["d"])).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    distinct = Stash(spark, good.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    total, rows = distinct.df.agg(F.count("*"), F.sum("copies")).first()
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, total // SAMPLE_SHARE))
    drawn = distinct.df.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(size).toArrow()
    space = best_space(_matrix(drawn.column("x").combine_chunks()).reshape(-1, dims["d"]), total, cosine)

    visits = Stash(spark, distinct.df.select("vec_id", "x").mapInArrow(_visit_rows(space), "block int, leaf int, home boolean, vec_id long, part array<float>"))
    # numbers of a few thousand leaves a block at most, as the sample bounds them
    loads = visits.df.groupBy("block", "leaf").agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("lefts"), F.ceil(F.count("*") / TILE).cast("int").alias("rights")).where("lefts > 0")
    known = visits.df.join(F.broadcast(loads), ["block", "leaf"])
    deal = lambda n, salt: F.array(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sides = F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    placed = known.withColumn("is_left", sides).withColumn("i", F.explode(F.when(F.col("is_left"), deal("lefts", 1)).otherwise(span("lefts"))))
    tiles = placed.withColumn("j", F.explode(F.when(F.col("is_left"), span("rights")).otherwise(deal("rights", 2)))).select("block", "leaf", "i", "j", "is_left", "home", "vec_id", "part")
    key = ["block", "leaf", "i", "j"]
    flagged = Stash(spark, tiles.groupBy(*key).applyInArrow(_candidates(space), "block int, leaf int, i int, j int, is_left boolean, home boolean, vec_id long"))
    whole = flagged.df.join(distinct.df, "vec_id")
    found = Stash(spark, whole.groupBy(*key).applyInArrow(_join_tile(space), "vec_id long, links long, mate long"))

    sums = found.df.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(spark, found.df.select(F.col("vec_id").alias("a"), F.col("mate").alias("b")))
    reps = distinct.df.join(sums, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    told = reps.select("x", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    linked = join_hot(good, told, ["x"], "copies", rows).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~usable(dims["d"])).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for used in (visits, flagged):
        used.drop()
    return linked.unionByName(rest).withColumn("kept", F.expr("vec_id <=> component_id"))
