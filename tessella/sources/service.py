"""Pages of a file service's search as rows, and catalogues that are built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import strings

_SAMPLE = "sample_id:STRING,submitter_id:STRING,sample_type:STRING,tissue_type:STRING"
_PROJECT = "project_id:STRING,name:STRING,disease_type:STRING,primary_site:STRING,program:STRING"
_CASE = f"submitter_id:STRING,case_id:STRING,primary_site:STRING,project:STRUCT<{_PROJECT}>,samples:ARRAY<STRUCT<{_SAMPLE}>>"
HIT = f"id STRING, file_id STRING, file_name STRING, file_size BIGINT, md5sum STRING, cases ARRAY<STRUCT<{_CASE}>>"


def hits(pages: DataFrame, text: str = "text") -> DataFrame:
    """(page, place, hit) of response documents."""
    page = F.from_json(text, f"data STRUCT<hits: ARRAY<STRUCT<{HIT.replace(' STRING', ':STRING').replace(' BIGINT', ':BIGINT').replace('cases ARRAY', 'cases:ARRAY')}>>>")
    return pages.select("page", F.posexplode(page["data"]["hits"]).alias("place", "hit"))


def _text(x: str) -> Column:
    return F.nullif(F.col(x), F.lit(""))


def file_rows(found: DataFrame) -> DataFrame:
    """A flat row a file: its first case and first sample, what these lack from the barcode in its name.

    A program comes as a name or as an object with one.
    """
    case, name = F.try_element_at("hit.cases", F.lit(1)), F.coalesce("hit.file_name", F.lit(""))
    told = found.select("page", "place", "hit", case.alias("c"), F.try_element_at(case["samples"], F.lit(1)).alias("s"), strings.barcode(name).alias("b"), name.alias("file_name"))
    program = F.col("c.project.program")
    known = F.when(program.startswith("{"), F.get_json_object(program, "$.name")).otherwise(F.coalesce(F.nullif(program, F.lit("")), F.col("b.program")))
    return told.select(
        "page",
        "place",
        F.coalesce(_text("hit.file_id"), _text("hit.id"), F.lit("")).alias("file_id"),
        "file_name",
        F.coalesce("hit.file_size", F.lit(0)).cast("long").alias("file_size"),
        F.col("hit.md5sum").alias("md5sum"),
        F.col("c.project.project_id").alias("project_id"),
        F.col("c.project.name").alias("project_name"),
        F.col("c.project.disease_type").alias("disease_type"),
        F.coalesce(_text("c.project.primary_site"), "c.primary_site").alias("primary_site"),
        known.alias("program"),
        F.coalesce(_text("c.submitter_id"), "b.case_id").alias("case_submitter_id"),
        F.col("c.case_id").alias("case_uuid"),
        F.col("s.sample_id").alias("sample_id"),
        F.coalesce(_text("s.submitter_id"), "b.sample").alias("sample_submitter_id"),
        F.coalesce(_text("s.sample_type"), "b.sample_type").alias("sample_type"),
        F.col("s.tissue_type").alias("tissue_type"),
    )


def search(rows: DataFrame, size: int = 25, offset: int = 0, **equal: str | None) -> tuple[DataFrame, int]:
    """A page of the rows that equal what is given, in the order of their files, and how many there are in all."""
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy("file_id").offset(offset).limit(size), rows.count()


def _first(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key in the order of the pages; rows without one are left out."""
    order = Window.partitionBy(key).orderBy("page", "place")
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def levels(rows: DataFrame) -> dict[str, DataFrame]:
    """The four levels that rows of files bring: each key once, as its first row has it; rows without a file's id bring nothing."""
    rows = rows.where("file_id <> ''")
    md5 = rows.where("coalesce(md5sum, '') <> ''").groupBy("file_id").agg(F.min_by("md5sum", F.struct("page", "place")).alias("first_md5"))
    files = _first(rows, "file_id").join(md5, "file_id", "left").withColumn("md5sum", F.coalesce(_text("md5sum"), "first_md5"))
    return {
        "projects": _first(rows, "project_id").select("project_id", "program", F.col("project_name").alias("name"), "disease_type", "primary_site"),
        "cases": _first(rows, "case_submitter_id").select(F.col("case_submitter_id").alias("submitter_id"), "case_uuid", "project_id"),
        "samples": _first(rows, "sample_id").select("sample_id", F.col("sample_submitter_id").alias("submitter_id"), "case_submitter_id", "sample_type", "tissue_type"),
        "files": files.select("file_id", "file_name", "file_size", "md5sum", "sample_id", "case_submitter_id", "project_id"),
    }


KEYS = {"projects": "project_id", "cases": "submitter_id", "samples": "sample_id", "files": "file_id"}


def upsert(held: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The four levels with what rows add: keys that are held stay as they are, but for a file's missing checksum."""
    new = levels(rows)
    out = {}
    for name, key in KEYS.items():
        own = held[name]
        if name == "files":
            sums = new[name].select(key, F.col("md5sum").alias("_md5"))
            own = own.join(sums, key, "left").withColumn("md5sum", F.coalesce(_text("md5sum"), "_md5")).select(*own.columns)
        fresh = new[name].join(held[name].select(key), key, "left_anti")
        out[name] = own.unionByName(fresh, allowMissingColumns=True)
    return out


def mark_downloaded(files: DataFrame, done: DataFrame, always: bool = False) -> DataFrame:
    """files with the paths of done (file_id, local_path, downloaded_at); the time moves only where the path changes, or always. Unknown files do nothing."""
    new = done.select("file_id", F.col("local_path").alias("_path"), F.col("downloaded_at").alias("_at"))
    joined = files.join(new, "file_id", "left")
    moves = F.col("_path").isNotNull() & (F.lit(always) | ~F.col("_path").eqNullSafe(F.col("local_path")))
    own = {"local_path": F.coalesce("_path", "local_path"), "downloaded_at": F.when(moves, F.col("_at")).otherwise(F.col("downloaded_at"))}
    return joined.select(*(own.get(c, F.col(c)).alias(c) for c in files.columns))


def link(files: DataFrame, slides: DataFrame) -> DataFrame:
    """(file_id, slide_id, dangling) of files with a path: the slide they name if there is one, else the one with their content, else the one at their path.

    files (file_id, local_path, slide_id, content_key), slides (id, path, identity_key); of several slides with a content or path the smallest id.
    """
    by_id = slides.select(F.col("id").alias("slide_id"), F.lit(True).alias("known"))
    by_content = slides.where("identity_key IS NOT NULL").groupBy(F.col("identity_key").alias("content_key")).agg(F.min("id").alias("of_content"))
    by_path = slides.groupBy(F.col("path").alias("norm")).agg(F.min("id").alias("of_path"))
    own = files.where("local_path IS NOT NULL").withColumn("norm", strings.normal_path(F.col("local_path")))
    told = own.join(by_id, "slide_id", "left").join(by_content, "content_key", "left").join(by_path, "norm", "left")
    known = F.coalesce("known", F.lit(False))
    return told.select("file_id", F.when(known, F.col("slide_id")).otherwise(F.coalesce("of_content", "of_path")).alias("slide_id"), (F.col("slide_id").isNotNull() & ~known).alias("dangling"))


def verified(parts: DataFrame) -> DataFrame:
    """Downloads (name, content, size, md5) that have the size and checksum they should, where these are known."""
    same = (F.col("size").isNull() | (F.length("content") == F.col("size"))) & (F.col("md5").isNull() | (F.md5("content") == F.lower("md5")))
    return parts.where(same)
