"""Writes on versioned snapshots: a new version is a directory, and a marker file makes it complete.

Operators turn frames into frames; ``Snapshots`` publishes their results. One writer, readers pin a version.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _ranked(rows, keys, order)


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _ranked(rows, keys, order)


def _ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], overwrite: Iterable[str] = (), keep_if_null: Iterable[str] = (), backfill: Iterable[str] = ()) -> DataFrame:
    """Upsert of source (one row a key) into target, with ``action`` inserted, updated or kept.

    overwrite: the source's value, also NULL; keep_if_null: the source's unless NULL; backfill: the target's unless NULL; all else stays.
    """
    overwrite, keep_if_null, backfill = set(overwrite), set(keep_if_null), set(backfill)
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_t"))
    s = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("_s"))
    both = t.join(s, list(keys), "full_outer")
    new, old = F.col("_t").isNull(), F.col("_s").isNull()

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"_t.{c}")
        ours, theirs = F.col(f"_t.{c}"), F.col(f"_s.{c}")
        if c in overwrite:
            kept = F.when(old, ours).otherwise(theirs)
        elif c in keep_if_null:
            kept = F.coalesce(theirs, ours)
        elif c in backfill:
            kept = F.coalesce(ours, theirs)
        else:
            kept = ours
        return F.when(new, theirs).otherwise(kept)

    columns = [c for c in target.columns if c not in keys]
    return both.select(*keys, *[value(c).alias(c) for c in columns], F.when(new, "inserted").when(old, "kept").otherwise("updated").alias("action"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, root: str, cascade: dict[str, tuple[str, str]], set_null: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The tables without root's rows in ``gone`` (id); cascade and set_null map a table to its parent and column.

    Tables are given parents first; a cascading table's own deletions reach its children.
    """
    dead = {root: gone.select("id")}
    out = {root: tables[root].join(dead[root], "id", "left_anti")}
    for name, (parent, column) in cascade.items():
        lost = tables[name].join(dead[parent].withColumnRenamed("id", column), column, "left_semi")
        dead[name] = lost.select("id")
        out[name] = tables[name].join(dead[parent].withColumnRenamed("id", column), column, "left_anti")
    for name, (parent, column) in set_null.items():
        marked = dead[parent].select(F.col("id").alias("_dead"))
        current = out.get(name, tables[name])
        out[name] = current.join(marked, F.col(column) == F.col("_dead"), "left").withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).drop("_dead")
    return out


def allocate_ids(rows: DataFrame, last: int) -> DataFrame:
    """Ids after ``last``, without gaps, in the order of rows' partitions: counts of these give each its first id."""
    tagged = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    before = sizes.select("_part", "_low", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))  # one row a partition
    first = F.lit(last + 1) + F.col("_before") + F.col("_row") - F.col("_low")
    return tagged.join(F.broadcast(before), "_part").withColumn("id", first.cast("long")).drop("_part", "_row", "_low", "_before")


def partial_update(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the values that changes (one row a key) give; a NULL there leaves the value as it is, keys that rows lack do nothing."""
    given = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in given))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns))


class Snapshots:
    """Versions of named tables in one folder of any file system that Spark reaches.

    A version is a folder, complete once its marker file is there; the current one is the largest complete one. One
    writer at a time; a folder that a crash left without its marker is never written into again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, pattern: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/{pattern}"))
        return [int(f.getPath().getName().lstrip("v").removesuffix(".complete")) for f in found or ()]

    def version(self) -> int:
        return max(self._numbers("*.complete"), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version or self.version()}/{table}")

    def commit(self, tables: dict[str, DataFrame], clustered: dict[str, Sequence[str]] | None = None) -> int:
        """Writes all tables of the next version, then its marker. clustered: columns to range-partition and sort a table by, so that filters on them skip files."""
        new = max([self.version(), *self._numbers("v*")]) + 1
        for name, df in tables.items():
            by = (clustered or {}).get(name)
            (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.mode("error").parquet(f"{self.folder}/v{new}/{name}")
        self._fs.create(self._path(f"{self.folder}/{new}.complete"), False).close()
        return new
