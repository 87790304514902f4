"""The store's tables, derived from the driver's tables.

The same text runs on Spark and on DuckDB, so that every relational query can be held against another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
#: Tables whose rows can be told apart by their place, as ``<table>_placed`` with their file and their number in it; Spark only.
PLACED = ("lineitem",)

VIEWS = {
    "slides": """
        SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'dicom' ELSE 'gdc' END AS source_kind, s_name AS name,
               concat('/slides/', s_name, '.svs') AS path, 100000 AS width, 100000 AS height,
               CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE CAST(0.25 AS DOUBLE) * (1 + s_suppkey % 3) END AS mpp
        FROM supplier""",
    "rois": """
        SELECT id, slide_id, kind, x0, y0, x0 + w AS x1, y0 + h AS y1, label, created_at, CASE WHEN id % 101 = 0 THEN 0 ELSE 1 END AS has_bbox
        FROM (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS slide_id,
                     CASE o_orderkey % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'polygon' ELSE 'circle' END AS kind,
                     CAST((o_orderkey * 137) % 100000 AS DOUBLE) AS x0, CAST((o_orderkey * 251) % 100000 AS DOUBLE) AS y0,
                     CAST(50 + o_custkey % 450 AS DOUBLE) AS w, CAST(50 + o_orderkey % 300 AS DOUBLE) AS h,
                     CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS label, o_orderdate AS created_at FROM orders) t""",
    "roi_stats": """
        SELECT id, slide_id, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 97 = 0 THEN 0 ELSE 1 END AS parses,
               CAST(id % 100 AS DOUBLE) / 100 AS tissue, CAST(id % 37 AS DOUBLE) / 50 AS hema, CAST(id % 29 AS DOUBLE) / 50 AS eosin,
               CAST(id % 256 AS DOUBLE) AS r, CAST((id * 7) % 256 AS DOUBLE) AS g, CAST((id * 13) % 256 AS DOUBLE) AS b FROM rois""",
    "measurements": """
        SELECT l_orderkey AS annotation_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id, l_returnflag AS name, l_discount AS value, CAST(0.25 AS DOUBLE) + 9 * l_tax AS mpp_effective,
               l_extendedprice AS price, l_quantity AS quantity, l_shipdate AS created_at FROM lineitem""",
    "interactions": """
        SELECT event_id AS id, event_type AS kind, user_id % (SELECT count(*) FROM supplier) AS slide_id, event_id * 2 AS roi_id, user_id AS session_id, props AS payload, ts AS created_at, value FROM events""",
    "viewports": """
        SELECT event_id AS id, user_id AS session_id, ts AS created_at, CAST(1000 + 40 * floor(event_id / 1000) + 0.25 * (event_id % 4) AS DOUBLE) AS cx, CAST(800 + 0.5 * (event_id % 3) AS DOUBLE) AS cy,
               CAST(2 + 0.0078125 * (event_id % 5) + 0.5 * (CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS ds, 400 + (CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS width, 300 AS height FROM events""",
    "files": """
        SELECT o_orderkey AS file_id, concat('TCGA-', CAST(o_orderkey AS VARCHAR(20)), '.svs') AS file_name, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
               CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS sample_id, o_custkey AS case_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_nationkey END AS project_id, CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE concat('/data/', CAST(o_orderkey AS VARCHAR(20)), '.svs') END AS local_path,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE md5(CAST(o_orderkey AS VARCHAR(20))) END AS md5sum, o_orderdate AS first_seen_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "samples": "SELECT c_custkey AS sample_id, c_mktsegment AS sample_type, c_custkey AS case_id FROM customer",
    "cases": "SELECT c_custkey AS case_id, c_name AS submitter_id, c_nationkey AS project_id FROM customer",
    "projects": "SELECT n_nationkey AS project_id, n_name AS name, r_name AS program FROM nation JOIN region ON n_regionkey = r_regionkey",
    "slide_files": "SELECT doc_id AS id, concat('/d/', CAST(doc_id AS VARCHAR(20))) AS path, md5(text) AS identity_key, length(text) AS file_size, source AS source_kind FROM documents",
    "runs": "SELECT conv_id, turn, role AS tool, text AS output_text, conv_id * 1000 + turn AS id FROM conversations",
    "pixels": "SELECT id AS x, id % 64 AS px, CAST(floor(id / 64) AS BIGINT) AS py, (id * 7) % 256 AS r, (id * 13 + 31) % 256 AS g, (id * 29 + 97) % 256 AS b FROM (SELECT p_partkey AS id FROM part) t",
}


_current: dict[int, tuple[str, SparkSession]] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views over the driver's tables and the store's, made anew when a session turns to another folder."""
    held = _current.get(id(spark))
    if held and held[0] == sf_dir and held[1] is spark:
        return
    _current[id(spark)] = sf_dir, spark
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for table in PLACED:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").select("*", "_metadata.file_path", "_metadata.row_index").createOrReplaceTempView(f"{table}_placed")
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def duck(sql: str) -> str:
    """The query with the views in front that it needs, for DuckDB."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(?i)\b(?:FROM|JOIN)\s+{name}\b", text):
                add(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
