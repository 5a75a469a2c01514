"""Views over the driver tables that stand in for street, river, terrain and result tables.

The statements run unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_nodes": """
SELECT CAST(p_partkey AS STRING) AS id,
       CAST(p_partkey % 100 AS DOUBLE) * 50 AS x,
       CAST(floor(p_partkey / 100) AS DOUBLE) * 50 AS y,
       p_retailprice / 10 AS surface_elevation,
       CAST(p_size AS DOUBLE) AS contributing_area
FROM part""",
    "fx_edges": """
SELECT CAST(u AS STRING) AS u, CAST(v AS STRING) AS v,
       CAST(row_number() OVER (PARTITION BY u, v ORDER BY ok, ln, sk, px) - 1 AS INT) AS key,
       len AS length, highway, lanes, network_type, bridge, 'street' AS edge_type
FROM (SELECT l_partkey AS u,
             lead(l_partkey) OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v,
             l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk, l_extendedprice AS px,
             l_quantity AS len,
             CASE l_returnflag WHEN 'A' THEN 'motorway' WHEN 'R' THEN 'primary' ELSE 'residential' END AS highway,
             CASE WHEN l_linenumber % 3 = 0 THEN '2;1' ELSE CAST(l_linenumber AS STRING) END AS lanes,
             CASE l_linestatus WHEN 'O' THEN 'drive' ELSE 'walk' END AS network_type,
             CASE WHEN l_discount > 0.08 THEN 'yes' END AS bridge
      FROM lineitem) t
WHERE v IS NOT NULL AND u <> v""",
    "fx_forest": """
SELECT CAST(p_partkey AS STRING) AS u, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS v,
       0 AS key, CAST(p_size AS DOUBLE) + 20 AS length, p_retailprice / 1000 AS diameter
FROM part WHERE floor(p_partkey / 2) >= 1""",
    "fx_results": """
SELECT CAST(user_id AS STRING) AS id, event_type AS variable,
       date_trunc('hour', ts) AS date, value,
       CASE WHEN event_id % 2 = 0 THEN 'syn' ELSE 'real' END AS part
FROM events""",
    "fx_river": """
SELECT CAST(concat('river', CAST(s_suppkey AS STRING)) AS STRING) AS id,
       CAST(s_suppkey % 100 AS DOUBLE) * 40 + 13 AS x,
       CAST(floor(s_suppkey / 100) AS DOUBLE) * 40 + 17 AS y
FROM supplier""",
    "fx_boxes": """
SELECT CAST(s_suppkey AS STRING) AS sub_id,
       CAST(s_suppkey % 100 AS DOUBLE) * 50 - 60 AS xmin, CAST(floor(s_suppkey / 100) AS DOUBLE) * 50 - 60 AS ymin,
       CAST(s_suppkey % 100 AS DOUBLE) * 50 + 60 AS xmax, CAST(floor(s_suppkey / 100) AS DOUBLE) * 50 + 60 AS ymax
FROM supplier""",
    "fx_cells": """
SELECT CAST(floor(p_partkey / 50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, p_retailprice AS z
FROM part""",
    "fx_lonlat": """
SELECT o_orderkey AS id, CAST(o_custkey % 6000 AS DOUBLE) / 1000 - 6 AS lon,
       CAST(o_orderkey % 120 AS DOUBLE) - 60 AS lat
FROM orders""",
}

TABLES = {
    "fx_nodes": ["part"],
    "fx_edges": ["lineitem"],
    "fx_forest": ["part"],
    "fx_results": ["events"],
    "fx_river": ["supplier"],
    "fx_boxes": ["supplier"],
    "fx_cells": ["part"],
    "fx_lonlat": ["orders"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; its tables are read from ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the views for DuckDB; queries continue it with a comma or a SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
