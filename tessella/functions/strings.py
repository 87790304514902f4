"""Barcodes, storage paths, sizes and stamps as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the sample types that barcodes carry as codes, and the form of a barcode.
SAMPLE_TYPES = {
    "01": "Primary Tumor",
    "02": "Recurrent Tumor",
    "03": "Primary Blood Derived Cancer - Peripheral Blood",
    "06": "Metastatic",
    "07": "Additional Metastatic",
    "10": "Blood Derived Normal",
    "11": "Solid Tissue Normal",
    "12": "Buccal Cell Normal",
}
CASE = r"(?i)^((TCGA|TARGET|CPTAC|HCM)-[A-Z0-9]{2,4}-[A-Z0-9]{4,6})"
BARCODE = CASE + r"(?:-([0-9]{2})([A-Z])?)?(?:-[0-9]{2}[A-Z]?)?(?:-([A-Z0-9]{3,4}))?"


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_part(text: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.substring_index(F.translate(text, "\\", "/"), "/", -1)


def barcode(text: Column) -> Column:
    """struct(program, case_id, sample, code, sample_type, slide) of a barcode at the head of a file's name; NULL fields from where it ends."""
    name = last_part(text)
    case, code = F.upper(_part(name, BARCODE, 1)), _part(name, BARCODE, 3)
    names = F.create_map(*[F.lit(x) for pair in SAMPLE_TYPES.items() for x in pair])
    sample = F.when(code.isNotNull(), F.concat(case, F.lit("-"), code, F.upper(F.regexp_extract(name, BARCODE, 4))))
    return F.struct(F.upper(_part(name, BARCODE, 2)).alias("program"), case.alias("case_id"), sample.alias("sample"), code.alias("code"), F.try_element_at(names, code).alias("sample_type"), F.upper(_part(name, BARCODE, 5)).alias("slide"))


def safe_component(text: Column, fallback: str | Column) -> Column:
    """One path component: the last part of a path or a prefixed id, each odd character replaced, no dots or underscores at its ends."""
    last = last_part(F.substring_index(F.trim(F.coalesce(text, F.lit(""))), ":", -1))
    clean = F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback) if isinstance(fallback, str) else fallback)


def storage_path(project: Column, case: Column, file_id: Column, name: Column) -> Column:
    """project/case/name; the case comes from the name's barcode where it isn't given, the name from the id."""
    known = F.coalesce(F.nullif(case, F.lit("")), barcode(name)["case_id"])
    return F.concat_ws("/", safe_component(project, "unknown-project"), safe_component(known, "unknown-case"), safe_component(name, F.concat(safe_component(file_id, "slide"), F.lit(".svs"))))


def contained_name(name: Column) -> Column:
    """A bare file name: the last part after slashes and colons, without blanks and dots at its ends; NULL when nothing is left."""
    bare = F.substring_index(last_part(name), ":", -1)
    return F.nullif(F.regexp_replace(F.trim(bare), r"^\.+|\.+$", ""), F.lit(""))


def safe_file_id(file_id: Column) -> Column:
    return F.coalesce(contained_name(file_id), F.lit("unknown_file_id"))


def header_file_name(disposition: Column) -> Column:
    """The contained file name that a Content-Disposition header gives."""
    return contained_name(F.trim(_part(disposition, r"filename\*?=(?:UTF-8'')?\"?([^\";]+)")))


def stated_mpp(description: Column) -> Column:
    """The resolution that a scanner's description states."""
    return _part(description, r"MPP\s*=\s*([0-9]*\.?[0-9]+)").try_cast("double")


def percent(done: Column, total: Column) -> Column:
    """0 to 100, half to even; NULL without a total."""
    return F.when(total != 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * done / total).cast("int"))))


def one_decimal(x: Column, places: int = 1) -> Column:
    """x as text with so many decimals, by its exact binary value; Spark's own rounding goes by the shortest decimal instead, so this is a vectorised UDF."""

    @F.pandas_udf("string")
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{places}f}", na_action="ignore")

    return told(x.cast("double"))


def human_size(n: Column) -> Column:
    """A size in MB with one decimal or, from 1000 MB on, in GB with two."""
    mb = n / 1e6
    told = F.when(mb >= 1000, F.concat(one_decimal(mb / 1000, 2), F.lit(" GB"))).otherwise(F.concat(one_decimal(mb), F.lit(" MB")))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 MB").otherwise(told)


def measurement_text(width: Column, height: Column, width_um: Column, height_um: Column, diagonal_um: Column) -> Column:
    """A measured box in pixels and, where known, in micrometres."""
    px = F.concat(one_decimal(width), F.lit(" x "), one_decimal(height), F.lit(" px"))
    um = F.concat(px, F.lit(" = "), one_decimal(width_um), F.lit(" x "), one_decimal(height_um), F.lit(" um (diag "), one_decimal(diagonal_um), F.lit(" um)"))
    return F.when(width_um.isNull() | height_um.isNull() | diagonal_um.isNull(), px).otherwise(um)


def flag(x: Column) -> Column:
    return F.when(x, "yes").otherwise("no")


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without empty and single-dot parts; a double-dot part removes the one before it."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(F.translate(path, "\\", "/").startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def split_ranges(total: Column, workers: Column) -> Column:
    """array<struct<first,last>>: 0 to total - 1 in one inclusive range a worker (1 to 16, no more than bytes), extra bytes to the leading ranges; empty without a positive total."""
    total = total.cast("long")
    n = F.greatest(F.lit(1).cast("long"), F.least(F.lit(16), workers, total))
    base, extra = F.call_function("div", total, n), total % n
    first = lambda i: i * base + F.least(i, extra)
    ranges = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(first(i).alias("first"), (first(i + 1) - 1).alias("last")))
    return F.when(total > 0, ranges).otherwise(F.slice(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))), 1, 0))


def iso(stamp: Column) -> Column:
    """ISO 8601 in UTC, with microseconds where there are any."""
    part = F.date_format(stamp, "SSSSSS")
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def utc(text: Column) -> Column:
    """The moment that a text gives, as UTC without a zone; a text without a zone is UTC already, an unreadable one NULL."""
    zoned = text.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())).otherwise(F.try_to_timestamp(text)).cast("timestamp_ntz")


def compact_stamp(stamp: Column) -> Column:
    """Date, T, time and microseconds in digits only."""
    return F.date_format(stamp, "yyyyMMdd'T'HHmmssSSSSSS")


def content_key(size: Column, content: Column) -> Column:
    """sha256 of the size, the first MiB and, of longer contents, the last one."""
    mib = 1 << 20
    return F.sha2(F.concat(F.encode(size.cast("string"), "UTF-8"), F.substring(content, 1, mib), F.when(size > mib, F.substring(content, -mib, mib)).otherwise(F.encode(F.lit(""), "UTF-8"))), 256)
