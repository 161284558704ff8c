"""Series-shaped views over the driver's tables: the same text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WELL_LOG = """
SELECT well_id, row_seq, event_type AS formation,
       CAST(row_seq * 10 AS DOUBLE) AS md,
       CAST(row_seq * 3 + event_id % 7 AS DOUBLE) AS x,
       CAST(well_id * 5 + event_id % 11 AS DOUBLE) AS y,
       CAST(-1000 AS DOUBLE) - CAST(event_id % 23 AS DOUBLE) AS z,
       CASE WHEN event_id % 19 = 0 OR (well_id % 5 = 0 AND row_seq BETWEEN 20 AND 28) THEN NULL ELSE value END AS gr,
       CAST(100 AS DOUBLE) + CAST(row_seq AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(event_id % 13 AS DOUBLE) / CAST(10 AS DOUBLE) AS tvt,
       CASE WHEN row_seq * 10 <= n * 7 AND event_id % 17 <> 0 THEN
         CAST(100 AS DOUBLE) + CAST(row_seq AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(event_id % 13 AS DOUBLE) / CAST(10 AS DOUBLE) END AS tvt_input
FROM (SELECT user_id AS well_id, event_id, value, event_type,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS row_seq,
             CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n
      FROM events) AS e"""

WELL_LOG_LONG = """
SELECT l_suppkey AS well_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS row_seq,
       l_quantity * CAST(3 AS DOUBLE) AS gr, l_extendedprice AS z
FROM lineitem"""

TOPS = """
SELECT l_suppkey AS well_id, p_type AS formation,
       CAST(sum(CAST(l_quantity AS BIGINT)) % 997 AS DOUBLE) AS depth,
       CAST(sum(CAST(l_quantity AS BIGINT)) % 997 AS DOUBLE) + max(l_quantity) AS base_depth,
       CAST(l_suppkey % 37 AS DOUBLE) AS x, CAST(l_suppkey % 53 AS DOUBLE) AS y
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_suppkey, p_type"""

VIEWS = {"well_log": (WELL_LOG, ("events",)), "well_log_long": (WELL_LOG_LONG, ("lineitem",)), "tops": (TOPS, ("lineitem", "part"))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = VIEWS[name]
    return spark.sql(text.replace("FROM events", "FROM {events}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part ", "JOIN {part} "), **{t: table(spark, sf_dir, t) for t in tables})


def with_views(select: str, *names: str) -> str:
    """DuckDB text: the select over the named views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in names) + " " + select
