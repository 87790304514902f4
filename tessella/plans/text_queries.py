"""Queries of names, paths, sizes, stamps and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import strings
from tessella.operators import relational as R
from tessella.operators import store as S
from tessella.plans.registry import Tables, query

_CODES = ", ".join(f"('{c}', '{n}')" for c, n in strings.SAMPLE_TYPES.items())
_BARCODE = """concat(CASE file_id % 5 WHEN 0 THEN 'dir/TCGA' WHEN 1 THEN 'target' WHEN 2 THEN 'CPTAC' WHEN 3 THEN 'HCM' ELSE 'XXXX' END, '-', substr('ABCDEFG', 1, CAST(2 + file_id % 3 AS INTEGER)), '-', lpad(CAST(file_id % 10000 AS VARCHAR(8)), CAST(4 + file_id % 4 AS INTEGER), 'a'),
    CASE WHEN file_id % 4 = 0 THEN '.svs' ELSE concat('-', lpad(CAST(1 + file_id % 13 AS VARCHAR(8)), 2, '0'), CASE WHEN file_id % 2 = 1 THEN 'b' ELSE '' END, CASE WHEN file_id % 3 = 0 THEN '' ELSE '-01A-ts1.x.svs' END) END)"""
_FORM = "^((TCGA|TARGET|CPTAC|HCM)-[A-Z0-9]{2,4}-[A-Z0-9]{4,6})(-([0-9]{2})([A-Z])?)?(-[0-9]{2}[A-Z]?)?(-([A-Z0-9]{3,4}))?"


@query(f"""WITH b AS (SELECT file_id, string_split({_BARCODE}, '/')[-1] AS b FROM files), p AS (SELECT file_id, nullif(upper(regexp_extract(b, '{_FORM}', 2, 'i')), '') AS program, nullif(upper(regexp_extract(b, '{_FORM}', 1, 'i')), '') AS case_id, nullif(regexp_extract(b, '{_FORM}', 4, 'i'), '') AS code,
    upper(regexp_extract(b, '{_FORM}', 5, 'i')) AS vial, nullif(upper(regexp_extract(b, '{_FORM}', 8, 'i')), '') AS slide FROM b)
    SELECT p.file_id, program, case_id, CASE WHEN p.code IS NOT NULL THEN concat(case_id, '-', p.code, vial) END AS sample, p.code, n.name AS sample_type, slide FROM p LEFT JOIN (VALUES {_CODES}) n(code, name) ON p.code = n.code""")
def barcode_parts(t: Tables) -> DataFrame:
    return t("files").selectExpr("file_id", f"{_BARCODE} AS b").select("file_id", strings.barcode(F.col("b")).alias("p")).select("file_id", "p.*")


@query("""SELECT file_id, concat(CASE WHEN project_id IS NULL THEN 'unknown-project' ELSE concat('p_', project_id) END, '/', CASE file_id % 3 WHEN 0 THEN concat('C__', file_id) WHEN 1 THEN 'TCGA-AB-CDEF' ELSE 'unknown-case' END, '/', CASE file_id % 3 WHEN 1 THEN 'tcga-ab-cdef.svs' WHEN 0 THEN concat('x_y', file_id) ELSE concat('f', file_id, '.svs') END) AS relpath,
    CASE file_id % 3 WHEN 1 THEN 'tcga-ab-cdef.svs' WHEN 0 THEN concat('x y', file_id, '_') END AS contained, concat('f', file_id) AS safe_id FROM files""")
def storage_paths(t: Tables) -> DataFrame:
    """Where files belong: each level falls back where it isn't known, and no name leaves its folder."""
    project = F.when(F.col("project_id").isNotNull(), F.concat(F.lit("../p "), F.col("project_id")))
    case = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("a:C  "), F.col("file_id")))
    name = F.expr("CASE file_id % 3 WHEN 1 THEN 'd/tcga-ab-cdef.svs' WHEN 0 THEN concat('C:\\\\a\\\\x y', file_id, '_') ELSE ' ..' END")
    file_id = F.concat(F.lit("gdc:../f"), F.col("file_id"))
    return t("files").select("file_id", strings.storage_path(project, case, file_id, name).alias("relpath"), strings.contained_name(name).alias("contained"), strings.safe_file_id(file_id).alias("safe_id"))


@query("""SELECT file_id, CASE WHEN file_size = 0 THEN '0 MB' WHEN file_size * 4000 / 1e6 >= 1000 THEN format('{:.2f} GB', file_size * 4000 / 1e6 / 1000) ELSE format('{:.1f} MB', file_size * 4000 / 1e6) END AS size, CAST(CASE WHEN file_id % 4 = 0 THEN NULL ELSE least(100, round_even(100 * CAST(file_id AS DOUBLE) / (file_id % 4 * 1000), 0)) END AS INTEGER) AS percent,
    CASE WHEN local_path IS NULL THEN 'no' ELSE 'yes' END AS downloaded, coalesce(CAST(project_id AS VARCHAR), '') AS project FROM files""")
def record_rows(t: Tables) -> DataFrame:
    """Catalogue records as a table shows them."""
    total = F.col("file_id") % 4 * 1000
    return t("files").select("file_id", strings.human_size(F.col("file_size") * 4000).alias("size"), strings.percent(F.col("file_id"), total).alias("percent"), strings.flag(F.col("local_path").isNotNull()).alias("downloaded"), F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project"))


@query("""SELECT r.id, CASE WHEN s.mpp IS NULL THEN format('{:.1f} x {:.1f} px', w / 8, h / 8) ELSE format('{:.1f} x {:.1f} px = {:.1f} x {:.1f} um (diag {:.1f} um)', w / 8, h / 8, w / 8 * s.mpp, h / 8 * s.mpp, sqrt(w / 8 * w / 8 + h / 8 * h / 8) * s.mpp) END AS told FROM (SELECT id, slide_id, x1 - x0 AS w, y1 - y0 AS h FROM rois) r LEFT JOIN slides s ON r.slide_id = s.id""")
def measurement_texts(t: Tables) -> DataFrame:
    own = t("rois").join(t("slides").select(F.col("id").alias("slide_id"), "mpp"), "slide_id", "left")
    w, h, mpp = (F.col("x1") - F.col("x0")) / 8, (F.col("y1") - F.col("y0")) / 8, F.col("mpp")
    return own.select("id", strings.measurement_text(w, h, w * mpp, h * mpp, F.sqrt(w * w + h * h) * mpp).alias("told"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN concat('/a/c', id, '.svs') WHEN 1 THEN concat('/slides/', id) WHEN 2 THEN 'x/y' WHEN 3 THEN 'C:/data/s' ELSE '/' END AS path, concat(substr(sha256(CAST(id AS VARCHAR)), 1, 12), '-', name) AS upload FROM slides""")
def normal_paths(t: Tables) -> DataFrame:
    """Paths without detours, and the content-derived names of uploads."""
    raw = F.expr("CASE id % 5 WHEN 0 THEN concat('/a//b/../c', id, '.svs') WHEN 1 THEN concat('/slides/./', id, '/') WHEN 2 THEN './x/y' WHEN 3 THEN 'C:\\\\data\\\\s' ELSE '/../..' END")
    return t("slides").select("id", strings.normal_path(raw).alias("path"), F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), F.lit("-"), F.col("name")).alias("upload"))


@query("""SELECT file_id, CASE file_id % 4 WHEN 0 THEN concat('a', file_id, '.svs') WHEN 1 THEN 'b c.svs' WHEN 2 THEN 'evil.svs' END AS name FROM files""")
def header_names(t: Tables) -> DataFrame:
    """File names that response headers give."""
    header = F.expr("""CASE file_id % 4 WHEN 0 THEN concat('attachment; filename="a', file_id, '.svs"; size=3') WHEN 1 THEN "attachment; filename*=UTF-8''b c.svs" WHEN 2 THEN 'filename=../../x/evil.svs' ELSE 'inline' END""")
    return t("files").select("file_id", strings.header_file_name(header).alias("name"))


@query("""SELECT id, concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), CASE WHEN microsecond(created_at) % 1000000 = 0 THEN '' ELSE strftime(created_at, '.%f') END, '+00:00') AS iso, strftime(created_at, '%Y%m%dT%H%M%S%f') AS compact, CASE id % 4 WHEN 0 THEN created_at WHEN 1 THEN created_at - INTERVAL 2 HOUR WHEN 2 THEN created_at END AS moment FROM interactions""")
def stamps(t: Tables) -> DataFrame:
    """Stamps rendered, and read back from texts with and without a zone; what can't be read is NULL."""
    text = F.expr("CASE id % 4 WHEN 0 THEN date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") WHEN 1 THEN concat(date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+02:00') WHEN 2 THEN concat(date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z') ELSE 'yesterday' END")
    return t("interactions").select("id", strings.iso(F.col("created_at")).alias("iso"), strings.compact_stamp(F.col("created_at")).alias("compact"), strings.utc(text).alias("moment"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(CAST(id % 97 AS DOUBLE) / 100 AS DOUBLE) END AS mpp FROM slides""")
def stated_resolutions(t: Tables) -> DataFrame:
    """Resolutions that scanners' descriptions state."""
    text = F.expr("CASE WHEN id % 3 = 0 THEN 'Scanner 4|AppMag = 20' ELSE concat('Scanner 4|MPP = 0.', lpad(cast(id % 97 AS string), 2, '0'), '|x') END")
    return t("slides").select("id", strings.stated_mpp(text).alias("mpp"))


@query("""SELECT i, CASE WHEN i % 2 = 0 THEN 0.5 * 2 ** i ELSE greatest(0.5 * 2 ** i, 3.0) END AS wait FROM (SELECT CAST(range AS INTEGER) AS i FROM range(4)) r""")
def retry_waits(t: Tables) -> DataFrame:
    """Seconds before each further attempt; a server's numeric wish raises them."""
    told = t("region").sparkSession.range(4).selectExpr("cast(id AS int) AS i", "if(id % 2 = 0, 'soon', '3') AS wish")
    return told.select("i", F.greatest(F.lit(0.5) * F.pow(F.lit(2.0), F.col("i")), F.coalesce(F.col("wish").try_cast("double"), F.lit(0.0))).alias("wait"))


@query("""SELECT annotation_id, part_id, line, value FROM (SELECT annotation_id, part_id, line, value FROM measurements) m WHERE annotation_id = 32 AND part_id IN (SELECT min(part_id) FROM measurements WHERE annotation_id = 32) AND line = (SELECT min(line) FROM measurements WHERE annotation_id = 32 AND part_id = (SELECT min(part_id) FROM measurements WHERE annotation_id = 32))""")
def composite_lookup(t: Tables) -> DataFrame:
    """A row by its key of three columns."""
    key = t("measurements").where("annotation_id = 32").orderBy("part_id", "line").select("annotation_id", "part_id", "line").limit(1)
    return t("measurements").join(F.broadcast(key), ["annotation_id", "part_id", "line"]).select("annotation_id", "part_id", "line", "value")


@query("SELECT file_id, file_name, file_size, local_path FROM files WHERE file_id = 33")
def catalog_lookup(t: Tables) -> DataFrame:
    return t("files").where("file_id = 33").select("file_id", "file_name", "file_size", "local_path")


@query("SELECT label FROM (SELECT DISTINCT label FROM rois) x WHERE label NOT IN (SELECT label FROM rois WHERE id % 4 <> 0 AND label <> 'O')")
def labels_lost(t: Tables) -> DataFrame:
    """Labels that no training row is left of."""
    return t("rois").select("label").distinct().join(t("rois").where("id % 4 <> 0 AND label <> 'O'").select("label"), "label", "left_anti")


_CELL = "CAST(floor(x0 / 30000) AS BIGINT)"
_ROW = "CAST(floor(y0 / 30000) AS BIGINT)"


@query(f"""SELECT slide_id, sha256(concat('["', kind, '",[[', {_CELL}, ',', {_ROW}, ']]]')) AS geom_key, count(*) AS n, min(id) AS keeper FROM rois GROUP BY slide_id, 2 HAVING count(*) > 1""")
def duplicate_geometry(t: Tables) -> DataFrame:
    """Regions of a slide with the same shape, of points rounded to coarse cells, so that there are some."""
    from tessella.functions import geometry

    points = F.array(F.struct(F.floor(F.col("x0") / 30000).cast("double").alias("x"), F.floor(F.col("y0") / 30000).cast("double").alias("y")))
    return R.duplicates(t("rois").select("id", "slide_id", geometry.geometry_key(F.col("kind"), points).alias("geom_key")), ["slide_id", "geom_key"])


@query("""SELECT id, CASE WHEN id % 6 = 0 THEN 'checked' ELSE label END AS label, CASE WHEN id % 10 = 0 THEN concat('note ', id) ELSE kind END AS kind FROM rois""")
def annotate_rois(t: Tables) -> DataFrame:
    """A partial update: fields that aren't given stay, unknown ids do nothing."""
    own = t("rois").select("id", "label", "kind")
    changes = own.where("id % 6 = 0 OR id % 10 = 0").selectExpr("id", "if(id % 6 = 0, 'checked', NULL) AS label", "if(id % 10 = 0, concat('note ', id), NULL) AS kind")
    return S.partial_update(own, changes.unionByName(changes.limit(1).selectExpr("-1L AS id", "'x' AS label", "'x' AS kind")))


@query("""SELECT label, count(*) AS n FROM rois WHERE trim(label) <> '' GROUP BY label UNION ALL SELECT '(least)', min(n) FROM (SELECT count(*) AS n FROM rois WHERE trim(label) <> '' GROUP BY label) x""")
def class_counts(t: Tables) -> DataFrame:
    """Rows of each label and the least of them, on which training depends."""
    counts = t("rois").where("trim(label) <> ''").groupBy("label").agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.lit("(least)").alias("label"), F.min("n").alias("n")))


@query("SELECT coalesce(max(version), 0) AS version FROM (SELECT r_regionkey AS version FROM region WHERE r_regionkey > 100) x")
def schema_version(t: Tables) -> DataFrame:
    """The newest migration that ran, 0 before any."""
    return t("region").where("r_regionkey > 100").agg(F.coalesce(F.max("r_regionkey"), F.lit(0)).alias("version"))


@query("""SELECT problem, n FROM (SELECT concat(CASE id % 6 WHEN 0 THEN 'Point has no area' WHEN 1 THEN 'degenerate polygon' ELSE 'Dot has no area' END) AS problem, count(*) AS n FROM rois WHERE id % 6 < 3 GROUP BY 1) x""")
def skip_tally(t: Tables) -> DataFrame:
    """What an import left out, by reason."""
    from tessella.sources.annotations import skip_counts

    reasons = t("rois").where("id % 6 < 3").selectExpr("CASE id % 6 WHEN 0 THEN 'Point has no area' WHEN 1 THEN 'degenerate polygon' ELSE 'Dot has no area' END AS reason")
    return skip_counts(reasons).select(F.col("reason").alias("problem"), "n")


@query("""SELECT id, position FROM (SELECT id, CAST(row_number() OVER (ORDER BY origin, id) - 1 AS INTEGER) AS position FROM (SELECT id, 0 AS origin FROM rois WHERE slide_id = 2 AND id % 2 = 0 UNION ALL SELECT id, 1 FROM rois WHERE slide_id = 2) x) y""")
def highlight_positions(t: Tables) -> DataFrame:
    """Where rows stand in the list of session regions and then saved ones; one slide's list, as a viewer shows it."""
    from pyspark.sql.window import Window

    own = t("rois").where("slide_id = 2").select("id")
    both = own.where("id % 2 = 0").withColumn("origin", F.lit(0)).unionByName(own.withColumn("origin", F.lit(1)))
    return both.withColumn("position", F.row_number().over(Window.orderBy("origin", "id")) - 1).select("id", "position")


@query("""SELECT slide_id, gx, gy, CAST(gy * 4 + gx + 1 AS INTEGER) AS done, CAST(16 AS INTEGER) AS total, CASE WHEN (slide_id + gx) % 5 = 0 THEN NULL ELSE CAST((slide_id * 3 + gx * 7 + gy) % 11 AS DOUBLE) / 10 END AS value FROM (SELECT s.id AS slide_id, CAST(a.gx AS INTEGER) AS gx, CAST(b.gy AS INTEGER) AS gy FROM slides s, range(4) a(gx), range(4) b(gy)) x""")
def metric_grid(t: Tables) -> DataFrame:
    """A metric over every cell of a slide's grid, with the progress; a cell whose metric fails has none, and the error."""
    cells = t("slides").select(F.col("id").alias("slide_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gy")).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    value = F.when((F.col("slide_id") + F.col("gx")) % 5 != 0, ((F.col("slide_id") * 3 + F.col("gx") * 7 + F.col("gy")) % 11).cast("double") / 10)
    return cells.select("slide_id", "gx", "gy", (F.col("gy") * 4 + F.col("gx") + 1).alias("done"), F.lit(16).alias("total"), value.alias("value"))


@query("""SELECT slide_id, count(*) AS cells, count(value) AS valid, count(*) - count(value) AS failed, min(value) AS low, max(value) AS high FROM (SELECT s.id AS slide_id, CASE WHEN (s.id + a.gx) % 5 = 0 THEN NULL ELSE CAST((s.id * 3 + a.gx * 7 + b.gy) % 11 AS DOUBLE) / 10 END AS value FROM slides s, range(4) a(gx), range(4) b(gy)) x GROUP BY slide_id""")
def grid_tally(t: Tables) -> DataFrame:
    return metric_grid(t).groupBy("slide_id").agg(F.count("*").alias("cells"), F.count("value").alias("valid"), (F.count("*") - F.count("value")).alias("failed"), F.min("value").alias("low"), F.max("value").alias("high"))


_PROBABILITIES = "SELECT vec_id, l.i AS i, CAST(abs(embedding[l.i + 1]) AS DOUBLE) AS p FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(5)) l"


@query(f"SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS INTEGER) AS place, concat('class ', i) AS label, p FROM ({_PROBABILITIES}) x")
def sorted_probabilities(t: Tables) -> DataFrame:
    """Labels by falling probability; of equal ones in the order of the classes."""
    told = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((-F.abs(F.element_at("embedding", i + 1).cast("double"))).alias("minus"), i.alias("i")))
    listed = t("embeddings").select("vec_id", F.posexplode(F.array_sort(told)).alias("place", "x"))
    return listed.select("vec_id", (F.col("place") + 1).alias("place"), F.concat(F.lit("class "), F.col("x.i")).alias("label"), (-F.col("x.minus")).alias("p"))
