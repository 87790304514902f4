"""Upkeep of a store: schemas compared and completed, identities filled in, migrations run in order, problems listed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.operators import relational as R
from tessella.operators.store import Snapshots


def schema_diff(have: StructType, want: StructType) -> list[tuple[str, str]]:
    """(change, column): lost where a column is missing, new where one is there besides, type where it differs."""
    own, due = {f.name: f.dataType for f in have}, {f.name: f.dataType for f in want}
    lost = [("lost", n) for n in due if n not in own]
    return lost + [("new", n) for n in own if n not in due] + [("type", n) for n in due if n in own and own[n] != due[n]]


def completed(rows: DataFrame, want: StructType) -> DataFrame:
    """rows with the columns that they lack, empty; nothing that is there changes."""
    own = set(rows.columns)
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in want if f.name not in own))


def backfill_identity(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (id, identity_key, file_size, ...) without an identity get the key and size found (id, key, size); a key that is taken or found more than once stays out."""
    missing = rows.where("identity_key IS NULL").select("id").join(found, "id")
    several = missing.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    taken = rows.where("identity_key IS NOT NULL").select(F.col("identity_key").alias("key")).distinct()
    free = missing.join(several, "key", "left_anti").join(taken, "key", "left_anti").select("id", "key")
    sized = missing.select("id", "size")
    told = rows.join(free, "id", "left").join(sized, "id", "left")
    own = {"identity_key": F.coalesce("identity_key", "key"), "file_size": F.coalesce("size", "file_size")}
    return told.select(*(own.get(c, F.col(c)).alias(c) for c in rows.columns))


Migration = Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]


def migrate(store: Snapshots, names: list[str], steps: Mapping[int, Migration], version: int) -> int:
    """Runs the steps above a version in their order, each on what the one before it left, and publishes one new snapshot; the version reached.

    Without a step to run nothing is written. A step that fails leaves the store as it was.
    """
    due = sorted(v for v in steps if v > version)
    if not due:
        return version
    tables: dict[str, DataFrame] = {n: store.read(n) for n in names}
    for v in due:
        tables |= steps[v](tables)
    store.commit(tables)
    return due[-1]


def doctor(tables: Mapping[str, DataFrame], references: Mapping[tuple[str, str], str]) -> DataFrame:
    """(check, n) of a store: rows of each table, and references (table, column) to another table's id that lead nowhere."""
    counts = [df.agg(F.lit(f"rows {n}").alias("check"), F.count("*").alias("n")) for n, df in tables.items()]
    lost = [R.dangling(tables[t], c, tables[to]).agg(F.lit(f"dangling {t}.{c}").alias("check"), F.count("*").alias("n")) for (t, c), to in references.items()]
    out = counts[0]
    for df in counts[1:] + lost:
        out = out.unionByName(df)
    return out


def ingest(spark, folder: str, suffixes: tuple[str, ...] = (".svs", ".tif", ".tiff", ".png", ".jpg", ".jpeg", ".dcm", ".ndpi", ".mrxs"), recursive: bool = True) -> DataFrame:
    """(path, name, size, modified) of the image files below a folder, in the order of their paths; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)))
    return found.where(suffix.isin(*suffixes)).select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")
