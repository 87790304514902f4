"""Exact top-k search by MaxScore over sharded postings.

Vectors are integer impacts: component t of a vector is its posting in list t. Vectors are dealt to
shards; in a shard each list is kept in the order of its impacts and cut into segments. For a query, a
segment's bound is the largest contribution that a posting in it can make. The segments with the lower
bounds of each list, chosen so that a vector which is in no other segment can't reach the query's
threshold, are non-essential. The essential segments are traversed; the vectors found there are
probed in the lists, some lists at a time from those that can change a score the most, as long as they
compete. Thresholds start from an exact search of a sample of the vectors, which all shards share, and
rise with what a shard finds. The best of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import Stash, int_keyed, prepare

#: Vectors of a shard, queries of a block, and vectors of the sample that thresholds start from, about.
SHARD, QUERY_BLOCK, SEED = 8192, 1024, 2048
#: Segments of a list, lists probed at a time, and steps in which the cut between the segments is sought.
SEGMENTS, GROUP, STEPS = 8, 8, 12
#: Below this all sums of products are exact in doubles; scores are longs.
EXACT, LONGEST = 1 << 53, 1 << 63


class Postings:
    """The lists of a shard: vectors in the order of each component, and the components at the ends of segments."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.rising = np.argsort(x, axis=0, kind="stable")
        self.cuts = np.linspace(0, n, SEGMENTS + 1).astype(np.int64)
        ordered = np.take_along_axis(x, self.rising, axis=0)
        last = np.maximum(self.cuts[1:], 1) - 1
        self.most = ordered[last][::-1].T  # of each list and segment from the top: its largest component
        self.least = ordered[np.minimum(self.cuts[:-1], n - 1)].T  # and from the bottom: its smallest
        self.high, self.low = x.max(axis=0), x.min(axis=0)

    def essential(self, weights: np.ndarray, threshold: float) -> np.ndarray | None:
        """The vectors in essential segments for a threshold, or None if these are not fewer than all."""
        bounds = np.where((weights >= 0)[:, None], weights[:, None] * self.most, weights[:, None] * self.least)
        gains = np.minimum.accumulate(bounds[:, :-1] - bounds[:, 1:], axis=1)
        lists = np.arange(len(weights))
        low, high = 0.0, float(gains.max(initial=0.0)) + 1.0
        taken = np.full(len(weights), SEGMENTS - 1)
        if bounds[lists, taken].sum() >= threshold:
            return None
        for _ in range(STEPS):  # the fewest segments, those with the largest gains, that leave less than the threshold
            middle = (low + high) / 2
            now = (gains >= middle).sum(axis=1)
            if bounds[lists, now].sum() < threshold:
                low, taken = middle, now
            else:
                high = middle
        if (1 - taken / SEGMENTS).prod() < 0.5:  # of lists that know nothing of each other
            return None
        found = np.zeros(len(self.x), bool)
        for t in np.flatnonzero(taken).tolist():
            found[self.rising[self.cuts[SEGMENTS - taken[t]] :, t] if weights[t] >= 0 else self.rising[: self.cuts[taken[t]], t]] = True
        return np.flatnonzero(found)


def exact_products(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Inner products of integers of any size; a score that is no long is an error."""
    scores = [sum(int(a) * int(b) for a, b in zip(row, weights, strict=True)) for row in x]
    if any(abs(s) >= LONGEST for s in scores):
        raise OverflowError("a score does not fit in a long")
    return scores


def search_shard(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, places in the shard, scores): the k best of the shard for each query, ties to smaller ids, its own row left out.

    floors: scores that the k best reach at least, or minus infinity; what is below may be missing. Sums that could
    exceed 2**53 are computed in integers.
    """
    order = np.lexsort((rows, ids))
    ids, rows, x = ids[order], rows[order], x[order]
    if float(np.abs(x).max()) * float(np.abs(q).max(initial=0)) * x.shape[1] >= EXACT:
        for row, weights in zip(query_rows, q, strict=True):
            scores = np.array([LONGEST if r == row else -s for r, s in zip(rows, exact_products(x, weights), strict=True)], object)
            best = np.argsort(scores, kind="stable")[: k + 1]
            best = best[rows[best] != row][:k]
            yield int(row), order[best], np.array([-s for s in scores[best]], np.int64)
        return
    x, q = x.astype(np.float64), q.astype(np.float64)
    postings = Postings(x)
    for row, weights, floor in zip(query_rows, q, floors, strict=True):
        alive = postings.essential(weights, floor)
        alive = np.flatnonzero(rows != row) if alive is None else alive[rows[alive] != row]
        bounds = np.maximum(weights * postings.high, weights * postings.low)
        swing = bounds - np.minimum(weights * postings.high, weights * postings.low)
        lists = np.argsort(-swing, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[lists][::-1])[::-1], [0.0]])  # what lists from here on can add at most
        least = np.concatenate([np.cumsum((bounds - swing)[lists][::-1])[::-1], [0.0]])
        scores, at, threshold = np.zeros(len(alive)), 0, float(floor)
        while at < len(lists):
            part = lists[at : at + GROUP]
            scores = scores + x[np.ix_(alive, part)] @ weights[part] if len(alive) < len(ids) // 2 else scores + (x[:, part] @ weights[part])[alive]
            at += len(part)
            if len(alive) > k:
                threshold = max(threshold, np.partition(scores, len(scores) - k)[len(scores) - k] + least[at])
            stays = scores + rest[at] >= threshold
            if not stays.all():
                alive, scores = alive[stays], scores[stays]
        best = np.lexsort((alive, -scores))[:k]
        yield int(row), order[alive[best]], scores[best].astype(np.int64)


def _search_rows(k: int):
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out = [pd.DataFrame({"query": [], "row": [], "vec_id": [], "score": []}).astype("int64")]
        if asks.any() and not asks.all():
            values = np.stack(pdf["impacts"].to_numpy())
            ids, own, floors = pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), pdf["floor"].fillna(-np.inf).to_numpy(np.float64)
            held = np.flatnonzero(~asks)
            for query, at, scores in search_shard(ids[held], own[held], values[held], own[asks], values[asks], floors[asks], k):
                out.append(pd.DataFrame({"query": query, "row": own[held[at]], "vec_id": ids[held[at]], "score": scores}))
        return pd.concat(out)

    return rows


def impacts(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, impacts): floor(scale * x) of each component in doubles; rows with a null id, null vectors and null or non-finite components are left out.

    A component whose impact is beyond what doubles hold exactly is an error.
    """
    scaled = lambda v: v.cast("double") * scale
    whole = lambda v: F.when(F.abs(scaled(v)) < EXACT, F.floor(scaled(v)).cast("long")).otherwise(F.raise_error(F.lit("an impact is beyond 2**53")).cast("long"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    good = F.when(fine, F.col("embedding"))
    return vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", F.transform(good, whole).alias("impacts")).where("impacts IS NOT NULL")


def top_vectors(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k candidates with the highest integer inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates every row but the query's own. Rows that
    repeat a vec_id are queries and candidates of their own. Vectors of another length than most take no part. No usable
    row gives no result; fewer than k candidates are all returned; further columns are ignored.
    """
    prepare(spark)
    whole = impacts(int_keyed(vectors, "vec_id", "embedding"))
    dims = whole.groupBy(F.size("impacts").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = dims["count"] if dims else 0
    rows = whole.where(F.size("impacts") == (dims["d"] if dims else 0))
    repeats = not rows.groupBy("vec_id").count().where("count > 1").isEmpty()
    rows = Stash(spark, rows.withColumn("row", F.monotonically_increasing_id())).df if repeats else rows.withColumn("row", F.col("vec_id"))
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * block)))
    deal = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where(F.col("vec_id") % every == 0)
    columns = ("asks", "vec_id", "row", "impacts", "floor")

    def searched(held: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
        left = held.withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("double")}).select(deal(parts, 1).alias("shard"), span(blocks).alias("block"), *columns)
        right = asked.withColumn("asks", F.lit(True)).select(span(parts).alias("shard"), deal(blocks, 2).alias("block"), *columns)
        return left.unionByName(right).groupBy("shard", "block").applyInPandas(_search_rows(k), "query long, row long, vec_id long, score long")

    sample = rows.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(max(1, n // SEED))) == 0)
    seeds = searched(sample, queries.withColumn("floor", F.lit(None).cast("double")), 1)
    floors = seeds.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k)
    asked = queries.join(floors.select(F.col("query").alias("row"), "floor"), "row", "left")
    found = searched(rows, asked, shards)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
