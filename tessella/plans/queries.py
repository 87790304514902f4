"""The engine's registered queries over the store's views, each with its twin in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import geometry, strings
from tessella.operators import relational as R
from tessella.operators import store as S
from tessella.plans.registry import ORACLES, QUERIES, Tables, query

def _rois_with_stats(t: Tables) -> DataFrame:
    """Regions with their statistics as JSON text: absent for some, malformed for others."""
    stats = t("roi_stats").select("id", "slide_id", "parses", "tissue", "hema", "eosin", "r", "g", "b")
    doc = F.to_json(F.struct(F.lit(128).alias("width_px"), F.lit(128).alias("height_px"), F.array("r", "g", "b").alias("mean_rgb"), F.struct(F.col("hema").alias("hematoxylin_mean"), F.col("eosin").alias("eosin_mean")).alias("he_deconvolution"), F.col("tissue").alias("tissue_fraction")))
    text = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 97 == 0, F.lit("{not json")).otherwise(doc)
    return t("rois").join(stats.select("id", "slide_id", text.alias("stats_json")), ["id", "slide_id"])  # so that a filter on the slide reaches both sides


_FLAT = """SELECT r.id, r.slide_id, r.label, (r.x1 - r.x0) * s.mpp AS width_um, (r.y1 - r.y0) * s.mpp AS height_um, (r.x1 - r.x0) * s.mpp * ((r.y1 - r.y0) * s.mpp) / 1e6 AS area_mm2,
    CASE WHEN parses = 1 THEN t.r END AS mean_r, CASE WHEN parses = 1 THEN t.g END AS mean_g, CASE WHEN parses = 1 THEN t.b END AS mean_b,
    CASE WHEN parses = 1 THEN hema END AS hema, CASE WHEN parses = 1 THEN eosin END AS eosin, CASE WHEN parses = 1 THEN tissue END AS tissue, parses = 1 AS has_stats
    FROM rois r JOIN roi_stats t ON r.id = t.id LEFT JOIN slides s ON r.slide_id = s.id"""
_SUMMED = ("width_um", "height_um", "area_mm2", "mean_r", "mean_g", "mean_b", "hema", "eosin", "tissue")


@query(_FLAT)
def roi_stats_rows(t: Tables) -> DataFrame:
    return R.stats_rows(_rois_with_stats(t), t("slides"))


@query(f"WITH flat AS ({_FLAT}) SELECT label, count(*) AS n, " + ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(CASE WHEN count({c}) >= 2 THEN stddev_pop({c}) END, 9) AS {c}_sd" for c in _SUMMED) + " FROM flat WHERE slide_id = 7 GROUP BY label")
def label_summary(t: Tables) -> DataFrame:
    told = R.label_summary(R.stats_rows(_rois_with_stats(t).where("slide_id = 7"), t("slides")), _SUMMED)
    return told.select("label", "n", *(F.round(f"{c}_{x}", 9).alias(f"{c}_{x}") for c in _SUMMED for x in ("mean", "sd"))).orderBy("label")  # as other engines add up in another order


@query("SELECT id, x0, y0, x1, y1 FROM rois WHERE slide_id = 3 AND has_bbox = 1 AND x0 <= 60000 AND x1 >= 10000 AND y0 <= 60000 AND y1 >= 10000 ORDER BY id LIMIT 2000")
def rois_in_viewport(t: Tables) -> DataFrame:
    return R.in_viewport(t("rois"), 3, (10000, 10000, 60000, 60000)).select("id", "x0", "y0", "x1", "y1")


@query("SELECT id, kind, label FROM rois WHERE slide_id = 5 ORDER BY id LIMIT 20 OFFSET 10")
def rois_for_slide_page(t: Tables) -> DataFrame:
    return R.page(t("rois").where("slide_id = 5").select("id", "kind", "label"), ["id"], 10, 20)


@query("SELECT id, slide_id FROM rois WHERE label = '' AND slide_id = 11")
def roi_search_unlabelled(t: Tables) -> DataFrame:
    return t("rois").where("label = '' AND slide_id = 11").select("id", "slide_id")


@query("SELECT id, kind, label, created_at FROM rois WHERE id = 4")
def roi_lookup(t: Tables) -> DataFrame:
    return t("rois").where("id = 4").select("id", "kind", "label", "created_at")


@query("SELECT r.id, s.name AS slide_name, r.kind, r.label, concat('[', CAST(CAST(r.x0 AS BIGINT) AS VARCHAR), ',', CAST(CAST(r.y0 AS BIGINT) AS VARCHAR), ',', CAST(CAST(r.x1 AS BIGINT) AS VARCHAR), ',', CAST(CAST(r.y1 AS BIGINT) AS VARCHAR), ']') AS bbox_json FROM rois r JOIN slides s ON r.slide_id = s.id")
def export_rois(t: Tables) -> DataFrame:
    box = F.to_json(F.array(*[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")]))
    return t("rois").join(t("slides").select(F.col("id").alias("slide_id"), F.col("name").alias("slide_name")), "slide_id").select("id", "slide_name", "kind", "label", box.alias("bbox_json"))


@query("SELECT r.label, m.name, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value) - min(value), 6) AS spread FROM measurements m JOIN rois r ON m.annotation_id = r.id WHERE m.mpp_effective BETWEEN 0.3 AND 0.6 GROUP BY r.label, m.name")
def measurements_comparable(t: Tables) -> DataFrame:
    own = t("measurements").where(F.col("mpp_effective").between(0.3, 0.6)).join(t("rois").select(F.col("id").alias("annotation_id"), "label"), "annotation_id")
    return own.groupBy("label", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


_HISTORY = "created_at DESC, line DESC, part_id DESC, supp_id DESC, price DESC, quantity DESC, value DESC, mpp_effective DESC"


@query(f"SELECT annotation_id, name, value, created_at FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id, name ORDER BY {_HISTORY}) AS k FROM measurements) x WHERE k = 1")
def measurement_latest(t: Tables) -> DataFrame:
    order = [c.split()[0] for c in _HISTORY.split(", ")]
    return R.latest(t("measurements"), ["annotation_id", "name"], order).select("annotation_id", "name", "value", "created_at")


@query(f"SELECT annotation_id, name, CAST(k AS INTEGER) AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id, name ORDER BY {_HISTORY.replace('DESC', 'ASC')}) AS k FROM measurements) x")
def measurement_history(t: Tables) -> DataFrame:
    """Every version of every annotation's measurements; measurement_history is a slice of it."""
    w = Window.partitionBy("annotation_id", "name").orderBy(*[c.split()[0] for c in _HISTORY.split(", ")])
    return t("measurements").select("annotation_id", "name", F.row_number().over(w).alias("version"), "value")


@query("SELECT id, kind, slide_id, created_at FROM interactions ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_interactions(t: Tables) -> DataFrame:
    return R.recent(t("interactions")).select("id", "kind", "slide_id", "created_at")


@query("SELECT id, kind FROM interactions WHERE slide_id = 2 ORDER BY id LIMIT 200")
def interactions_for_slide(t: Tables) -> DataFrame:
    return t("interactions").where("slide_id = 2").orderBy("id").limit(200).select("id", "kind")


@query("SELECT id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM interactions")
def interaction_payload(t: Tables) -> DataFrame:
    return t("interactions").select("id", F.get_json_object("payload", "$.k").try_cast("long").alias("k"))


@query("SELECT id, tool, output_text FROM runs ORDER BY id DESC LIMIT 50")
def recent_runs(t: Tables) -> DataFrame:
    return t("runs").orderBy(F.desc("id")).limit(50).select("id", "tool", "output_text")


@query("SELECT f.file_id, f.file_name, s.sample_type, p.name AS project_name FROM files f LEFT JOIN samples s ON f.sample_id = s.sample_id LEFT JOIN projects p ON f.project_id = p.project_id ORDER BY f.file_id LIMIT 500")
def catalog_files(t: Tables) -> DataFrame:
    joined = t("files").join(t("samples").select("sample_id", "sample_type"), "sample_id", "left").join(t("projects").select("project_id", F.col("name").alias("project_name")), "project_id", "left")
    return joined.orderBy("file_id").limit(500).select("file_id", "file_name", "sample_type", "project_name")


@query("SELECT f.file_id, s.sample_type FROM files f LEFT JOIN samples s ON f.sample_id = s.sample_id WHERE s.sample_type = 'BUILDING' AND f.local_path IS NOT NULL")
def catalog_files_by_sample_type(t: Tables) -> DataFrame:
    joined = t("files").join(t("samples").select("sample_id", "sample_type"), "sample_id", "left")
    return R.where_given(joined, sample_type="BUILDING", project_id=None).where("local_path IS NOT NULL").select("file_id", "sample_type")


@query("SELECT 'projects' AS level, count(*) AS n FROM projects UNION ALL SELECT 'cases', count(*) FROM cases UNION ALL SELECT 'samples', count(*) FROM samples UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'downloaded', count(*) FROM files WHERE local_path IS NOT NULL")
def catalog_stats_levels(t: Tables) -> DataFrame:
    counts = [t(n).agg(F.lit(n).alias("level"), F.count("*").alias("n")) for n in ("projects", "cases", "samples")]
    both = t("files").agg(F.count("*").alias("files"), F.count("local_path").alias("downloaded")).unpivot([], ["files", "downloaded"], "level", "n")
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(both)


@query("SELECT coalesce(CAST(project_id AS VARCHAR), 'unknown') AS project, n, downloaded FROM (SELECT project_id, count(*) AS n, count(local_path) AS downloaded FROM files GROUP BY project_id) x")
def catalog_stats_projects(t: Tables) -> DataFrame:
    return t("files").groupBy("project_id").agg(F.count("*").alias("n"), F.count("local_path").alias("downloaded")).select(F.coalesce(F.col("project_id").cast("string"), F.lit("unknown")).alias("project"), "n", "downloaded")


@query("SELECT file_id, project_id, file_name, CAST(row_number() OVER (ORDER BY project_id NULLS FIRST, file_name) AS INTEGER) AS place FROM files WHERE local_path IS NOT NULL AND sample_id IS NOT NULL ORDER BY place LIMIT 300")
def catalog_search(t: Tables) -> DataFrame:
    own = t("files").where("local_path IS NOT NULL AND sample_id IS NOT NULL").orderBy("project_id", "file_name").limit(300)
    return own.select("file_id", "project_id", "file_name", F.row_number().over(Window.orderBy("project_id", "file_name")).alias("place"))


@query("SELECT r.file_id, coalesce(f.local_path, CASE WHEN r.file_id % 2 = 0 THEN '/new' END) AS local_path FROM (SELECT file_id FROM files) r LEFT JOIN (SELECT file_id, local_path FROM files WHERE local_path IS NOT NULL) f ON r.file_id = f.file_id")
def merge_download_state(t: Tables) -> DataFrame:
    records = t("files").select("file_id", F.when(F.col("file_id") % 2 == 0, "/new").alias("own"))
    known = t("files").where("local_path IS NOT NULL").select("file_id", "local_path")
    return records.join(known, "file_id", "left").select("file_id", F.coalesce("local_path", "own").alias("local_path"))


@query("""SELECT p.program, p.name AS project, sa.sample_type, count(*) AS n, count(DISTINCT r.slide_id) AS n_slides, round(avg(m.value), 6) AS mean_value FROM measurements m JOIN rois r ON m.annotation_id = r.id JOIN slides s ON r.slide_id = s.id
    JOIN files f ON f.file_id = r.id JOIN samples sa ON f.sample_id = sa.sample_id JOIN cases c ON sa.case_id = c.case_id JOIN projects p ON c.project_id = p.project_id GROUP BY p.program, p.name, sa.sample_type""")
def provenance_chain(t: Tables) -> DataFrame:
    m = t("measurements").select(F.col("annotation_id").alias("id"), "value")
    r = t("rois").select("id", "slide_id").join(t("slides").select(F.col("id").alias("slide_id")), "slide_id")
    f = t("files").select(F.col("file_id").alias("id"), "sample_id").where("sample_id IS NOT NULL")
    chain = m.join(r, "id").join(f, "id").join(t("samples"), "sample_id").join(t("cases").select("case_id", "project_id"), "case_id").join(t("projects"), "project_id")
    return chain.groupBy("program", F.col("name").alias("project"), "sample_type").agg(F.count("*").alias("n"), F.count_distinct("slide_id").alias("n_slides"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT 'interactions.roi_id' AS problem, count(*) AS n FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM rois r WHERE r.id = i.roi_id) UNION ALL SELECT 'rois.slide_id', count(*) FROM rois r WHERE NOT EXISTS (SELECT 1 FROM slides s WHERE s.id = r.slide_id)")
def doctor_dangling(t: Tables) -> DataFrame:
    one = R.dangling(t("interactions"), "roi_id", t("rois")).agg(F.lit("interactions.roi_id").alias("problem"), F.count("*").alias("n"))
    return one.unionByName(R.dangling(t("rois"), "slide_id", t("slides")).agg(F.lit("rois.slide_id").alias("problem"), F.count("*").alias("n")))


_COUNTED = ("slides", "rois", "measurements", "interactions", "files", "slide_files")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _COUNTED))
def doctor_counts(t: Tables) -> DataFrame:
    out = None
    for n in _COUNTED:
        own = t(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT identity_key, count(*) AS n, min(id) AS keeper FROM slide_files GROUP BY identity_key HAVING count(*) > 1")
def identity_conflicts(t: Tables) -> DataFrame:
    return R.duplicates(t("slide_files"), ["identity_key"])


@query("SELECT id, min(id) OVER (PARTITION BY identity_key) AS keeper FROM slide_files")
def dedupe_plan(t: Tables) -> DataFrame:
    return R.remap_to_keeper(t("slide_files").select("id", "identity_key"), ["identity_key"]).select("id", "keeper")


@query("WITH k AS (SELECT id, min(id) OVER (PARTITION BY identity_key) AS keeper FROM slide_files) SELECT k.keeper AS slide_id, count(*) AS n_rois FROM (SELECT id % (SELECT count(*) FROM slide_files) AS file_id FROM rois) r JOIN k ON k.id = r.file_id GROUP BY k.keeper")
def dedupe_apply(t: Tables) -> DataFrame:
    files = t("slide_files").select("id", "identity_key")
    kept = R.remap_to_keeper(files, ["identity_key"]).select(F.col("id").alias("file_id"), "keeper")
    owned = t("rois").crossJoin(F.broadcast(files.agg(F.count("*").alias("n")))).select((F.col("id") % F.col("n")).alias("file_id"))
    return owned.join(kept, "file_id").groupBy(F.col("keeper").alias("slide_id")).agg(F.count("*").alias("n_rois"))


_KEY = "sha256(concat('[\"', kind, '\",[[', CAST(CAST(round_even(x0 / 64, 0) AS BIGINT) AS VARCHAR), ',', CAST(CAST(round_even(y0 / 64, 0) AS BIGINT) AS VARCHAR), ']]]'))"


@query("""WITH old AS (SELECT id, name, mpp, path FROM slides WHERE id % 3 <> 0), new AS (SELECT id, concat(name, '-2') AS name, CASE WHEN id % 2 = 0 THEN NULL ELSE mpp END AS mpp, CASE WHEN id % 4 = 0 THEN NULL ELSE '/moved' END AS path FROM slides WHERE id % 2 = 0 OR id % 5 = 0)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.mpp ELSE n.mpp END AS mpp, CASE WHEN o.id IS NULL THEN n.path ELSE coalesce(n.path, o.path) END AS path,
    CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old o FULL OUTER JOIN new n ON o.id = n.id""")
def slide_upsert(t: Tables) -> DataFrame:
    old = t("slides").where("id % 3 <> 0").select("id", "name", "mpp", "path")
    new = t("slides").where("id % 2 = 0 OR id % 5 = 0").selectExpr("id", "concat(name, '-2') AS name", "if(id % 2 = 0, NULL, mpp) AS mpp", "if(id % 4 = 0, NULL, '/moved') AS path")
    return S.merge(old, new, ["id"], overwrite=["name", "mpp"], keep_if_null=["path"])


@query("""WITH old AS (SELECT file_id, file_name, md5sum FROM files WHERE file_id % 4 <> 1), new AS (SELECT file_id, concat(file_name, '.new') AS file_name, md5(file_name) AS md5sum FROM files WHERE file_id % 2 = 1)
    SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.file_name, n.file_name) AS file_name, coalesce(o.md5sum, n.md5sum) AS md5sum, CASE WHEN o.file_id IS NULL THEN 'inserted' WHEN n.file_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old o FULL OUTER JOIN new n ON o.file_id = n.file_id""")
def catalog_upsert(t: Tables) -> DataFrame:
    old = t("files").where("file_id % 4 <> 1").select("file_id", "file_name", "md5sum")
    new = t("files").where("file_id % 2 = 1").select("file_id", F.concat("file_name", F.lit(".new")).alias("file_name"), F.md5("file_name").alias("md5sum"))
    return S.merge(old, new, ["file_id"], backfill=["md5sum"])


@query("SELECT file_id, CASE WHEN file_id % 6 = 0 THEN '/moved' ELSE local_path END AS local_path, CASE WHEN file_id % 6 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE first_seen_at END AS downloaded_at FROM files")
def mark_downloaded_flat(t: Tables) -> DataFrame:
    hit = F.col("file_id") % 6 == 0
    return t("files").select("file_id", F.when(hit, "/moved").otherwise(F.col("local_path")).alias("local_path"), F.when(hit, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("first_seen_at")).alias("downloaded_at"))


@query("SELECT file_id, CASE WHEN file_id % 6 = 0 THEN '/data/6.svs' ELSE local_path END AS local_path, CASE WHEN file_id % 6 = 0 AND local_path IS DISTINCT FROM '/data/6.svs' THEN TIMESTAMP '2024-01-01 00:00:00' ELSE first_seen_at END AS downloaded_at FROM files")
def mark_downloaded_hierarchical(t: Tables) -> DataFrame:
    hit, path = F.col("file_id") % 6 == 0, F.lit("/data/6.svs")
    moved = hit & ~F.col("local_path").eqNullSafe(path)
    return t("files").select("file_id", F.when(hit, path).otherwise(F.col("local_path")).alias("local_path"), F.when(moved, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("first_seen_at")).alias("downloaded_at"))


@query("""SELECT 'slides' AS name, count(*) AS n FROM slides WHERE id % 10 <> 0 UNION ALL SELECT 'rois', count(*) FROM rois WHERE slide_id % 10 <> 0
    UNION ALL SELECT 'measurements', count(*) FROM measurements m WHERE NOT EXISTS (SELECT 1 FROM rois r WHERE r.id = m.annotation_id AND r.slide_id % 10 = 0) UNION ALL SELECT 'interactions with slide', count(*) FROM interactions WHERE slide_id % 10 <> 0""")
def delete_slide_cascade(t: Tables) -> DataFrame:
    m = t("measurements").select("annotation_id", F.monotonically_increasing_id().alias("id"))
    tables = {"slides": t("slides"), "rois": t("rois"), "measurements": m, "interactions": t("interactions")}
    left = S.delete_cascade(tables, t("slides").where("id % 10 = 0"), "slides", {"rois": ("slides", "slide_id"), "measurements": ("rois", "annotation_id")}, {"interactions": ("slides", "slide_id")})
    out = [left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("slides", "rois", "measurements")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(left["interactions"].agg(F.lit("interactions with slide").alias("name"), F.count("slide_id").alias("n")))


@query("SELECT (SELECT count(*) FROM rois WHERE has_bbox = 0) AS without_bbox, (SELECT count(DISTINCT identity_key) FROM slide_files) AS identities, (SELECT count(*) FROM slide_files) AS files, (SELECT count(*) FROM files WHERE md5sum IS NULL) AS without_md5")
def migration_plan(t: Tables) -> DataFrame:
    a = t("rois").agg(F.count_if(F.col("has_bbox") == 0).alias("without_bbox"))
    b = t("slide_files").agg(F.count_distinct("identity_key").alias("identities"), F.count("*").alias("files"))
    return a.crossJoin(b).crossJoin(t("files").agg(F.count_if(F.col("md5sum").isNull()).alias("without_md5")))  # one row each


@query("""SELECT r.id, w AS width_px, h AS height_px, w * s.mpp AS width_um, h * s.mpp AS height_um, sqrt(w * w + h * h) AS diagonal_px, sqrt(w * w + h * h) * s.mpp AS diagonal_um,
    s.mpp * greatest(w / 256, h / 256) AS patch_mpp, 20.0 / (s.mpp * 4) AS magnification FROM (SELECT id, slide_id, abs(x1 - x0) AS w, abs(y1 - y0) AS h FROM rois) r LEFT JOIN slides s ON r.slide_id = s.id""")
def measure_box(t: Tables) -> DataFrame:
    """The measurement of every region; pixels only where its slide or the slide's resolution is unknown."""
    own = t("rois").join(t("slides").select(F.col("id").alias("slide_id"), "mpp"), "slide_id", "left")
    w, h, mpp = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.col("mpp")
    side, diagonal = F.lit(256), F.hypot(w, h)
    return own.select("id", w.alias("width_px"), h.alias("height_px"), (w * mpp).alias("width_um"), (h * mpp).alias("height_um"), diagonal.alias("diagonal_px"), (diagonal * mpp).alias("diagonal_um"), geometry.patch_mpp(mpp, w, h, side, side).alias("patch_mpp"), geometry.magnification(mpp, F.lit(4)).alias("magnification"))


@query("SELECT id, CAST(ceil(width / 4096.0) AS BIGINT) AS cols, CAST(ceil(height / 4096.0) AS BIGINT) AS n_rows, ceil(width / 4096.0) * 4096.0 / width AS cover_x FROM slides")
def grid_shape(t: Tables) -> DataFrame:
    cols, rows = geometry.grid_shape(F.col("width"), F.col("height"), 256, 16)
    return t("slides").select("id", cols.alias("cols"), rows.alias("n_rows"), (cols * 4096.0 / F.col("width")).alias("cover_x"))


@query("""SELECT slide_id, gx, gy, x0, y0, place FROM (SELECT s.id AS slide_id, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(gx * 25000 AS BIGINT) AS x0, CAST(gy * 25000 AS BIGINT) AS y0, CAST(row_number() OVER (PARTITION BY s.id ORDER BY gy, gx) AS INTEGER) AS place
    FROM slides s, range(4) a(gx), range(4) b(gy) WHERE (s.id * 7 + gx * 3 + gy * 5) % 4 <> 0) x WHERE place <= 10""")
def grid_cells(t: Tables) -> DataFrame:
    cells = t("slides").select(F.col("id").alias("slide_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gy")).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    tissue = cells.where("(slide_id * 7 + gx * 3 + gy * 5) % 4 <> 0")  # the tissue test comes before the cap
    place = F.row_number().over(Window.partitionBy("slide_id").orderBy("gy", "gx"))
    return tissue.withColumn("place", place).where("place <= 10").select("slide_id", "gx", "gy", (F.col("gx") * 25000).cast("long").alias("x0"), (F.col("gy") * 25000).cast("long").alias("y0"), "place")


@query("SELECT s.id, CAST(l AS INTEGER) AS level, CAST(ceil(s.width / CAST(2 ** (17 - l) AS DOUBLE)) AS BIGINT) AS w, CAST(ceil(ceil(s.width / CAST(2 ** (17 - l) AS DOUBLE)) / 254.0) AS BIGINT) AS cols FROM slides s, range(18) t(l)")
def dzi_levels(t: Tables) -> DataFrame:
    levels = t("slides").withColumn("top", geometry.max_level(F.col("width"), F.col("height"))).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    w = F.ceil(F.col("width") / F.pow(F.lit(2.0), F.col("top") - F.col("level")))
    return levels.select("id", "level", w.cast("long").alias("w"), F.ceil(w / 254.0).cast("long").alias("cols"))


@query("SELECT a.id AS a_id, b.id AS b_id FROM rois a JOIN rois b ON a.slide_id = b.slide_id AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 WHERE a.has_bbox = 1 AND b.has_bbox = 1")
def roi_overlaps(t: Tables) -> DataFrame:
    own = t("rois").where("has_bbox = 1").select("id", "slide_id", "x0", "y0", "x1", "y1")
    return R.overlaps(own, own, 2048).where("a_id < b_id").select("a_id", "b_id")


_LUM = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


@query(f"SELECT CAST(floor(px / 16) AS BIGINT) AS gx, CAST(floor(py / 16) AS BIGINT) AS gy, round(avg(CASE WHEN {_LUM} < 229.5 THEN 1.0 ELSE 0.0 END), 6) AS tissue, round(avg(-ln((r + 1) / 256.0)), 6) AS od_r, CAST(max(r) - min(r) AS BIGINT) AS range_r FROM pixels GROUP BY 1, 2")
def heatmap_grid(t: Tables) -> DataFrame:
    lum = F.expr("0.2126D * r + 0.7152D * g + 0.0722D * b")
    return t("pixels").groupBy(F.floor(F.col("px") / 16).alias("gx"), F.floor(F.col("py") / 16).alias("gy")).agg(F.round(F.avg(F.when(lum < 229.5, 1.0).otherwise(0.0)), 6).alias("tissue"), F.round(F.avg(-F.log((F.col("r") + 1) / 256.0)), 6).alias("od_r"), (F.max("r") - F.min("r")).alias("range_r"))


@query("SELECT b.bin AS bin, CAST(count(p.r) AS BIGINT) AS n FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(8)) b LEFT JOIN pixels p ON floor(p.r / 32) = b.bin GROUP BY b.bin")
def pixel_histogram(t: Tables) -> DataFrame:
    p = t("pixels")
    bins = p.sparkSession.range(8).withColumnRenamed("id", "bin")
    return bins.join(p.groupBy(F.floor(F.col("r") / 32).alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS sd_r, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90 FROM pixels")
def channel_stats(t: Tables) -> DataFrame:
    return t("pixels").agg(F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.stddev_pop("r"), 6).alias("sd_r"), *[F.round(F.percentile("r", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


@query("SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 5) AS mean_v, round(stddev_pop(v), 5) AS sd_v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) x GROUP BY label, dim")
def feature_stats_by_label(t: Tables) -> DataFrame:
    return t("embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.avg("v"), 5).alias("mean_v"), F.round(F.stddev_pop("v"), 5).alias("sd_v"))


@query("""SELECT session_id, count(*) AS n, count_if(old_ds IS NULL OR width <> old_width OR height <> old_height OR sqrt((cx - old_cx) * (cx - old_cx) + (cy - old_cy) * (cy - old_cy)) / ds >= 0.5 OR abs(ds / old_ds - 1.0) >= 0.01) AS changes
    FROM (SELECT *, lag(cx) OVER w AS old_cx, lag(cy) OVER w AS old_cy, lag(ds) OVER w AS old_ds, lag(width) OVER w AS old_width, lag(height) OVER w AS old_height FROM viewports WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)) x GROUP BY session_id""")
def viewport_changes(t: Tables) -> DataFrame:
    marked = R.viewport_changed(t("viewports"), "session_id", ["created_at", "id"])
    return marked.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("changed").alias("changes"))


@query("SELECT time_bucket(INTERVAL '1 hour', created_at) AS hour, kind, count(*) AS n FROM interactions GROUP BY 1, 2")
def interactions_by_hour(t: Tables) -> DataFrame:
    return t("interactions").groupBy(F.window("created_at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")


@query("SELECT label, count(*) AS n, CAST(count_if(id % 4 = 0) AS BIGINT) AS missing FROM rois WHERE trim(label) <> '' GROUP BY label")
def training_rows(t: Tables) -> DataFrame:
    return t("rois").where("trim(label) <> ''").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 4 == 0).alias("missing"))


@query("SELECT id, 'saved' AS origin FROM rois WHERE slide_id = 1 UNION ALL SELECT id, 'session' FROM rois WHERE slide_id = 1 AND id % 2 = 0")
def overlay_union(t: Tables) -> DataFrame:
    own = t("rois").where("slide_id = 1").select("id", F.lit("saved").alias("origin"))
    return own.unionByName(own.where("id % 2 = 0").withColumn("origin", F.lit("session")))


_WORKERS = 8


@query(f"""SELECT file_id, i, i * base + least(i, extra) AS first, i * base + least(i, extra) + base + CASE WHEN i < extra THEN 1 ELSE 0 END - 1 AS last FROM (SELECT file_id, n, file_size // n AS base, file_size % n AS extra FROM
    (SELECT file_id, file_size, least({_WORKERS}, file_size) AS n FROM files WHERE file_size > 0) s) f JOIN (SELECT CAST(range AS BIGINT) AS i FROM range({_WORKERS})) r ON i < n""")
def byte_ranges(t: Tables) -> DataFrame:
    """Every file's own size split among the workers."""
    return t("files").select("file_id", F.posexplode(strings.split_ranges(F.col("file_size"), F.lit(_WORKERS))).alias("i", "r")).select("file_id", F.col("i").cast("long").alias("i"), "r.first", "r.last")


@query("SELECT slide_id, count(*) AS annotation_count, round(sum((x1 - x0) * (y1 - y0)), 3) AS area_px, max(created_at) AS newest FROM rois GROUP BY slide_id")
def rois_per_slide(t: Tables) -> DataFrame:
    return t("rois").groupBy("slide_id").agg(F.count("*").alias("annotation_count"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 3).alias("area_px"), F.max("created_at").alias("newest"))


from tessella.plans import catalog_queries, geometry_queries, interop_queries, pixel_queries, text_queries  # noqa: E402,F401 they register theirs

__all__ = ["ORACLES", "QUERIES"]
