"""Queries of service pages, catalogues, downloads and the store's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.operators import store as S
from tessella.plans.registry import Tables, query
from tessella.sources import service

# Files as a service would tell of them: every fourth without cases, every fifth case with its program as an object.
_CASE = """named_struct('submitter_id', if(file_id % 6 = 1, NULL, concat('TCGA-AB-', lpad(cast(case_id AS string), 5, '0'))), 'case_id', concat('c', case_id), 'primary_site', 'Breast',
    'project', named_struct('project_id', concat('P-', project_id), 'name', concat('Project ', project_id), 'disease_type', NULL, 'primary_site', if(file_id % 2 = 0, 'Lung', NULL)),
    'samples', if(file_id % 7 = 0, array(), array(named_struct('sample_id', concat('s', sample_id), 'submitter_id', concat('sub', sample_id), 'sample_type', if(file_id % 3 = 0, NULL, 'Primary Tumor'), 'tissue_type', 'Tumor'))))"""
_HIT = f"named_struct('file_id', if(file_id % 9 = 0, NULL, concat('f', file_id)), 'id', concat('i', file_id), 'file_name', concat('TCGA-XY-', lpad(cast(case_id AS string), 5, '0'), '-11A-01-TS1.svs'), 'file_size', file_size, 'md5sum', md5sum, 'cases', if(file_id % 4 = 0, NULL, array({_CASE})))"


def _pages(t: Tables) -> DataFrame:
    """A page for every hundred files."""
    told = t("files").select(F.floor(F.col("file_id") / 100).alias("page"), "file_id", F.expr(_HIT).alias("hit"))
    listed = told.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "hit"))), lambda x: x["hit"]).alias("hits"))
    return listed.select("page", F.to_json(F.struct(F.struct("hits").alias("data"))).alias("text"))


_CASED = "file_id % 4 <> 0"
_SAMPLED = f"{_CASED} AND file_id % 7 <> 0"
_ROWS = f"""SELECT file_id AS number, CASE WHEN file_id % 9 = 0 THEN concat('i', file_id) ELSE concat('f', file_id) END AS file_id, concat('TCGA-XY-', lpad(CAST(case_id AS VARCHAR), 5, '0'), '-11A-01-TS1.svs') AS file_name, file_size, md5sum, CASE WHEN {_CASED} AND project_id IS NOT NULL THEN concat('P-', project_id) END AS project_id,
    CASE WHEN {_CASED} AND project_id IS NOT NULL THEN concat('Project ', project_id) END AS project_name, CASE WHEN {_CASED} THEN CASE WHEN file_id % 2 = 0 THEN 'Lung' ELSE 'Breast' END END AS primary_site, 'TCGA' AS program, CASE WHEN {_CASED} AND file_id % 6 <> 1 THEN concat('TCGA-AB-', lpad(CAST(case_id AS VARCHAR), 5, '0')) ELSE concat('TCGA-XY-', lpad(CAST(case_id AS VARCHAR), 5, '0')) END AS case_submitter_id,
    CASE WHEN {_CASED} THEN concat('c', case_id) END AS case_uuid, CASE WHEN {_SAMPLED} AND sample_id IS NOT NULL THEN concat('s', sample_id) END AS sample_id, CASE WHEN {_SAMPLED} AND sample_id IS NOT NULL THEN concat('sub', sample_id) ELSE concat('TCGA-XY-', lpad(CAST(case_id AS VARCHAR), 5, '0'), '-11A') END AS sample_submitter_id,
    CASE WHEN {_SAMPLED} AND file_id % 3 <> 0 THEN 'Primary Tumor' ELSE 'Solid Tissue Normal' END AS sample_type, CASE WHEN {_SAMPLED} THEN 'Tumor' END AS tissue_type FROM files"""


def _rows(t: Tables) -> DataFrame:
    return service.file_rows(service.hits(_pages(t)))


@query(f"SELECT * EXCLUDE (number) FROM ({_ROWS}) x")
def service_rows(t: Tables) -> DataFrame:
    """Flat rows of all hits of all pages."""
    return _rows(t).drop("page", "place", "disease_type")


@query(f"SELECT file_id, file_name, total FROM (SELECT *, count(*) OVER () AS total FROM ({_ROWS}) x WHERE project_id = 'P-3' AND sample_type = 'Primary Tumor') y ORDER BY file_id LIMIT 10 OFFSET 5")
def service_search(t: Tables) -> DataFrame:
    """A page of a search, and how many rows there are in all."""
    found, total = service.search(_rows(t), 10, 5, project_id="P-3", sample_type="Primary Tumor", program=None)
    return found.select("file_id", "file_name", F.lit(total).cast("long").alias("total"))


@query(f"""WITH r AS ({_ROWS}), p AS (SELECT 'projects' AS name, project_id AS k, min(number) AS of FROM r WHERE project_id IS NOT NULL GROUP BY project_id UNION ALL SELECT 'cases', case_submitter_id, min(number) FROM r GROUP BY 2 UNION ALL SELECT 'samples', sample_id, min(number) FROM r WHERE sample_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'files', file_id, min(number) FROM r GROUP BY 2)
    SELECT p.name, p.k, CASE p.name WHEN 'projects' THEN r.project_name WHEN 'cases' THEN r.case_uuid WHEN 'samples' THEN r.sample_type ELSE r.md5sum END AS told FROM p JOIN r ON p.of = r.number""")
def service_levels(t: Tables) -> DataFrame:
    """The four levels that the pages bring into empty catalogues."""
    rows = _rows(t)
    held = {n: df.where("false") for n, df in service.levels(rows).items()}
    got = service.upsert(held, rows)
    tell = {"projects": "name", "cases": "case_uuid", "samples": "sample_type", "files": "md5sum"}
    parts = [got[n].select(F.lit(n).alias("name"), F.col(k).alias("k"), F.col(tell[n]).alias("told")) for n, k in service.KEYS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_KNOWN = "SELECT concat('f', file_id) AS file_id, CASE WHEN file_id % 2 = 0 THEN NULL ELSE 'kept' END AS md5sum, 'old' AS file_name FROM files WHERE file_id % 3 = 0"


@query(f"""WITH r AS ({_ROWS}), k AS ({_KNOWN}) SELECT coalesce(k.file_id, r.file_id) AS file_id, CASE WHEN k.file_id IS NULL THEN r.md5sum ELSE coalesce(k.md5sum, r.md5sum) END AS md5sum, CASE WHEN k.file_id IS NULL THEN r.file_name ELSE 'old' END AS file_name FROM k FULL OUTER JOIN r ON k.file_id = r.file_id""")
def catalog_refresh(t: Tables) -> DataFrame:
    """Search results into a catalogue that holds some of them: only missing checksums are filled in."""
    rows = _rows(t)
    held = service.levels(rows)
    own = held["files"].where("false").select("file_id", "file_name", "md5sum")
    known = t("files").where("file_id % 3 = 0").selectExpr("concat('f', file_id) AS file_id", "'old' AS file_name", "if(file_id % 2 = 0, NULL, 'kept') AS md5sum")
    got = service.upsert({**{n: df.where("false") for n, df in held.items()}, "files": own.unionByName(known)}, rows)
    return got["files"].select("file_id", "md5sum", "file_name")


_DONE = "CASE file_id % 5 WHEN 0 THEN concat('/new/', file_id) WHEN 1 THEN local_path END"


@query(f"""SELECT file_id, coalesce({_DONE}, local_path) AS local_path, CASE WHEN {_DONE} IS NOT NULL AND {_DONE} IS DISTINCT FROM local_path THEN 'now' ELSE 'then' END AS moved, CASE WHEN {_DONE} IS NOT NULL THEN 'now' ELSE 'then' END AS always FROM files""")
def downloads_marked(t: Tables) -> DataFrame:
    """Downloads recorded in both kinds of catalogue: the time moves with the path in one, always in the other; unknown files are ignored."""
    files = t("files").select("file_id", "local_path", F.lit("then").alias("downloaded_at"))
    done = t("files").select("file_id", F.expr(_DONE).alias("local_path"), F.lit("now").alias("downloaded_at")).where("local_path IS NOT NULL").unionByName(files.limit(1).selectExpr("-1L AS file_id", "'/x' AS local_path", "'now' AS downloaded_at"))
    one = service.mark_downloaded(files, done).withColumnRenamed("downloaded_at", "moved")
    return one.join(service.mark_downloaded(files, done, always=True).select("file_id", F.col("downloaded_at").alias("always")), "file_id")


@query("""WITH s AS (SELECT id, path, identity_key FROM slide_files), f AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN concat('/d/', file_id) ELSE concat('/x/', file_id) END AS local_path, CASE WHEN file_id % 4 = 0 THEN file_id WHEN file_id % 4 = 1 THEN file_id + 100000000 END AS slide_id, file_id % 1000 AS of FROM files),
    c AS (SELECT f.*, s.identity_key AS content_key FROM f LEFT JOIN s ON f.of = s.id AND f.file_id % 2 = 1), i AS (SELECT identity_key, min(id) AS id FROM s GROUP BY identity_key)
    SELECT c.file_id, CASE WHEN a.id IS NOT NULL THEN a.id ELSE coalesce(i.id, p.id) END AS slide_id, c.slide_id IS NOT NULL AND a.id IS NULL AS dangling FROM c LEFT JOIN s a ON c.slide_id = a.id LEFT JOIN i ON c.content_key = i.identity_key LEFT JOIN s p ON p.path = c.local_path""")
def file_links(t: Tables) -> DataFrame:
    """Files linked to slides by id, by content, or by path, in this order; links that lead nowhere are told."""
    slides = t("slide_files").select("id", "path", "identity_key")
    files = t("files").selectExpr("file_id", "if(file_id % 3 = 0, concat('/d/./', file_id), concat('/x/', file_id)) AS local_path", "CASE WHEN file_id % 4 = 0 THEN file_id WHEN file_id % 4 = 1 THEN file_id + 100000000 END AS slide_id", "file_id % 1000 AS of")
    keyed = files.join(slides.select(F.col("id").alias("of"), F.col("identity_key").alias("content_key")), "of", "left").withColumn("content_key", F.when(F.col("file_id") % 2 == 1, F.col("content_key")))
    return service.link(keyed, slides)


@query("SELECT i.id, CASE WHEN r.id IS NULL THEN NULL ELSE i.roi_id END AS roi_id FROM interactions i LEFT JOIN rois r ON i.roi_id = r.id")
def dangling_cleared(t: Tables) -> DataFrame:
    """References that lead nowhere set to NULL."""
    known = t("rois").select(F.col("id").alias("roi_id"), F.lit(True).alias("known"))
    return t("interactions").select("id", "roi_id").join(known, "roi_id", "left").select("id", F.when(F.col("known"), F.col("roi_id")).alias("roi_id"))


@query("SELECT r.id FROM rois r WHERE r.slide_id IN (SELECT id FROM slides WHERE mpp IS NOT NULL)")
def rois_of_known_slides(t: Tables) -> DataFrame:
    return t("rois").join(t("slides").where("mpp IS NOT NULL").select(F.col("id").alias("slide_id")), "slide_id", "left_semi").select("id")


@query("""SELECT s.id, count(DISTINCT r.id) AS n_rois, count(m.line) AS n_measurements FROM slides s LEFT JOIN rois r ON r.slide_id = s.id LEFT JOIN measurements m ON m.annotation_id = r.id GROUP BY s.id""")
def slide_navigation(t: Tables) -> DataFrame:
    """What hangs on each slide: its regions and their measurements, counted before they are joined."""
    measured = t("measurements").groupBy(F.col("annotation_id").alias("id")).agg(F.count("*").alias("n"))
    per = t("rois").select("id", "slide_id").join(measured, "id", "left").groupBy(F.col("slide_id").alias("id")).agg(F.count("*").alias("n_rois"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_measurements"))
    return t("slides").select("id").join(per, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rois", "n_measurements")))


@query("""SELECT file_id, arg_max(local_path, seq) AS local_path FROM (SELECT file_id % 1000 AS file_id, local_path, file_id AS seq FROM files WHERE local_path IS NOT NULL) x GROUP BY file_id""")
def latest_paths(t: Tables) -> DataFrame:
    """Of several records of a file the last one with a path."""
    own = t("files").where("local_path IS NOT NULL").select((F.col("file_id") % 1000).alias("file_id"), "local_path", F.col("file_id").alias("seq"))
    return own.groupBy("file_id").agg(F.max_by("local_path", "seq").alias("local_path"))


@query("""SELECT c_nationkey AS project_id, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey""")
def first_names(t: Tables) -> DataFrame:
    """Of several records of a key the first."""
    from pyspark.sql.functions import col

    rows = t("customer").select(col("c_nationkey").alias("project_id"), col("c_name").alias("name"), col("c_custkey").alias("seq"))
    return S.first_wins(rows, ["project_id"], [col("seq")]).select("project_id", "name")


@query("""SELECT l_orderkey AS annotation_id, l_linenumber % 2 AS layer, arg_max(l_discount, l_linenumber) AS value FROM lineitem GROUP BY 1, 2""")
def resolutions_recorded(t: Tables) -> DataFrame:
    """An upsert on a composite key: of several rows the last one counts, and of equally late ones the first in the table.

    Rows without a line or a value count only if their key has no others; its value is NULL then.
    """
    rows = t("lineitem_placed").selectExpr("l_orderkey AS annotation_id", "l_linenumber % 2 AS layer", "l_linenumber AS line", "l_discount AS value", "file_path", "row_index")
    counts = F.col("line").isNotNull() & F.col("value").isNotNull()
    last = S.latest_wins(rows, ["annotation_id", "layer"], [counts.desc(), F.desc("line"), F.col("file_path"), F.col("row_index")])
    return last.select("annotation_id", "layer", F.when(counts, F.col("value")).alias("value"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN first_seen ELSE 'now' END AS first_seen_at, CASE WHEN id % 2 = 0 OR id % 3 <> 0 THEN NULL ELSE 'gone' END AS missing_since FROM (SELECT id, 'then' AS first_seen FROM slide_files) x WHERE id % 2 = 0 OR id % 3 = 0""")
def files_touched(t: Tables) -> DataFrame:
    """Places seen again keep when they were first seen and are no longer missing."""
    held = t("slide_files").where("id % 3 = 0").select("id", F.lit("then").alias("first_seen_at"), F.lit("gone").alias("missing_since"))
    seen = t("slide_files").where("id % 2 = 0").select("id", F.lit("now").alias("first_seen_at"), F.lit(None).cast("string").alias("missing_since"))
    return S.merge(held, seen, ["id"], overwrite=["missing_since"], backfill=["first_seen_at"]).drop("action")


@query("""SELECT count(*) AS n, min(id) AS low, max(id) AS high, count(DISTINCT id) AS n_ids FROM (SELECT 1000 + row_number() OVER () AS id FROM rois) x""")
def ids_allocated(t: Tables) -> DataFrame:
    """New ids after the last one, without gaps."""
    return S.allocate_ids(t("rois").select("kind"), 1000).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n_ids"))


@query("""SELECT (SELECT count(*) FROM (SELECT slide_id, kind, floor(x0 / 30000) AS c FROM rois GROUP BY 1, 2, 3 HAVING count(*) > 1) x) AS groups, (SELECT sum(n) FROM (SELECT count(*) AS n FROM rois GROUP BY slide_id, kind, floor(x0 / 30000) HAVING count(*) > 1) x) AS members, (SELECT count(*) FROM files WHERE local_path IS NOT NULL AND md5sum IS NULL) AS unverified, (SELECT count(DISTINCT project_id) FROM files) AS projects""")
def migration_preview(t: Tables) -> DataFrame:
    """What the later migrations would do: groups of equal shapes, files to link, projects."""
    cells = R.duplicates(t("rois").select("id", "slide_id", "kind", F.floor(F.col("x0") / 30000).alias("c")), ["slide_id", "kind", "c"])
    one = cells.agg(F.count("*").alias("groups"), F.sum("n").alias("members"))
    two = t("files").agg(F.count_if(F.col("local_path").isNotNull() & F.col("md5sum").isNull()).alias("unverified"), F.count_distinct("project_id").alias("projects"))
    return one.crossJoin(two)  # one row each


@query("""WITH k AS (SELECT id, min(id) OVER (PARTITION BY identity_key) AS keeper FROM slide_files), r AS (SELECT r.id, k.keeper AS slide_id FROM rois r JOIN k ON k.id = r.id % 100) SELECT 'files' AS name, k.keeper AS slide_id, count(*) AS n FROM k GROUP BY k.keeper UNION ALL SELECT 'rois', slide_id, count(*) FROM r GROUP BY slide_id""")
def duplicates_merged(t: Tables) -> DataFrame:
    """Duplicate slides merged: what belonged to them belongs to their keeper, and they are gone."""
    kept = R.remap_to_keeper(t("slide_files").select("id", "identity_key"), ["identity_key"]).select("id", "keeper")
    rois = t("rois").select((F.col("id") % 100).alias("id")).join(kept, "id")
    count = lambda df, name: df.groupBy(F.col("keeper").alias("slide_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "slide_id", "n")
    return count(kept, "files").unionByName(count(rois, "rois"))


@query("""SELECT 'lost' AS change, 'label' AS name UNION ALL SELECT 'new', 'notes' UNION ALL SELECT 'type', 'x0'""")
def schema_changes(t: Tables) -> DataFrame:
    """What a table lacks, has besides, or has in another type than it should."""
    from tessella.operators.maintenance import schema_diff

    want = t("rois").schema
    have = t("rois").drop("label").withColumns({"notes": F.lit(""), "x0": F.col("x0").cast("long")}).schema
    return t("region").sparkSession.createDataFrame(schema_diff(have, want), "change string, name string")


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN identity_key ELSE concat('old', id) END AS identity_key, CASE WHEN id % 4 = 0 THEN file_size END AS file_size FROM slide_files WHERE id % 4 <> 0 OR identity_key NOT IN (SELECT identity_key FROM slide_files WHERE id % 4 = 0 GROUP BY identity_key HAVING count(*) > 1) UNION ALL SELECT id, NULL, file_size FROM slide_files WHERE id % 4 = 0 AND identity_key IN (SELECT identity_key FROM slide_files WHERE id % 4 = 0 GROUP BY identity_key HAVING count(*) > 1)""")
def identities_filled(t: Tables) -> DataFrame:
    """Missing identities filled in from the content; contents that several rows share are left without one."""
    from tessella.operators.maintenance import backfill_identity

    own = t("slide_files").selectExpr("id", "if(id % 4 = 0, NULL, concat('old', id)) AS identity_key", "cast(NULL AS int) AS file_size")
    found = t("slide_files").where("id % 4 = 0").select("id", F.col("identity_key").alias("key"), F.col("file_size").alias("size"))
    return backfill_identity(own, found).select("id", "identity_key", "file_size")
