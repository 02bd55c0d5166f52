"""Registered queries: lineage edges, column mappings and walks over the key relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import lineage
from gaugeworks.plans.standins import table, tagged
from gaugeworks.session import settle


def line_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line makes its order a product of a part and a supplier.

    Returned lines count as copies and views; the others name no type.
    """
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        tagged("order", "l_orderkey").alias("downstream"),
        F.array(tagged("part", "l_partkey"), tagged("supplier", "l_suppkey")).alias("inputs"),
        F.when(flag == "A", lineage.COPY).when(flag == "R", lineage.VIEW).alias("type"),
        tagged("job", "l_linenumber").alias("job"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("actor_"), "l_linestatus").alias("actor"),
    )


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, supplier -> order -> customer -> nation -> region."""
    lines = line_inputs(spark, sf_dir).select(F.explode("inputs").alias("upstream"), "downstream")
    orders = table(spark, sf_dir, "orders").select(
        tagged("order", "o_orderkey").alias("upstream"),
        tagged("customer", "o_custkey").alias("downstream"),
    )
    customers = table(spark, sf_dir, "customer").select(
        tagged("customer", "c_custkey").alias("upstream"),
        tagged("nation", "c_nationkey").alias("downstream"),
    )
    nations = table(spark, sf_dir, "nation").select(
        tagged("nation", "n_nationkey").alias("upstream"),
        tagged("region", "n_regionkey").alias("downstream"),
    )
    return lines.unionByName(orders).unionByName(customers).unionByName(nations)


def q_lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_edges(line_inputs(spark, sf_dir))


def q_job_io_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        tagged("order", "o_orderkey").alias("job"),
        F.array(tagged("customer", "o_custkey"), tagged("priority", "o_orderpriority"))
        .alias("input_datasets"),
        F.array(tagged("status", "o_orderstatus")).alias("output_datasets"),
        F.when(F.col("o_orderstatus") == "F", F.array(tagged("job", "o_custkey")))
        .otherwise(F.array().cast("array<string>"))
        .alias("input_jobs"),
    )
    return lineage.job_io_edges(orders)


def q_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    mappings = lines.select(
        tagged("part", "l_partkey").alias("upstream"),
        tagged("order", "l_orderkey").alias("downstream"),
        F.array(F.lit("p_retailprice"), F.lit("p_size")).alias("upstream_fields"),
        F.array(F.lit("o_totalprice")).alias("downstream_fields"),
        F.col("l_returnflag").alias("operation"),
    )
    edges = lines.where("l_linestatus = 'F'").select(
        tagged("part", "l_partkey").alias("upstream"), tagged("order", "l_orderkey").alias("downstream")
    )
    return lineage.column_lineage(mappings, edges)


def q_lineage_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settle(key_edges(spark, sf_dir))  # two walks do not pay for sorting them
    up = lineage.lineage_walk(edges, "region:0", "upstream")
    down = lineage.lineage_walk(edges, "part:1", "downstream")
    return up.withColumn("walk", F.lit("upstream of region:0")).unionByName(
        down.withColumn("walk", F.lit("downstream of part:1"))
    )


QUERIES = {
    "lineage_edges": q_lineage_edges,
    "job_io_edges": q_job_io_edges,
    "column_lineage": q_column_lineage,
    "lineage_walk": q_lineage_walk,
}

KEY_EDGES_SQL = """edges AS (
  SELECT 'part:' || CAST(l_partkey AS VARCHAR) AS upstream,
         'order:' || CAST(l_orderkey AS VARCHAR) AS downstream FROM lineitem
  UNION ALL SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR),
                   'order:' || CAST(l_orderkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'order:' || CAST(o_orderkey AS VARCHAR),
                   'customer:' || CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR),
                   'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR),
                   'region:' || CAST(n_regionkey AS VARCHAR) FROM nation)"""

ORACLE = {
    "lineage_edges": """SELECT UNNEST(['part:' || CAST(l_partkey AS VARCHAR),
               'supplier:' || CAST(l_suppkey AS VARCHAR)]) AS upstream,
       'order:' || CAST(l_orderkey AS VARCHAR) AS downstream,
       CASE l_returnflag WHEN 'A' THEN 'COPY' WHEN 'R' THEN 'VIEW' ELSE 'TRANSFORMED' END AS type,
       'job:' || CAST(l_linenumber AS VARCHAR) AS job,
       'line ' || CAST(l_linenumber AS VARCHAR) AS description, l_shipdate AS ts, 'actor_' || l_linestatus AS actor
FROM lineitem""",
    "job_io_edges": """WITH j AS (
  SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS job, * FROM orders)
SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS upstream, job AS downstream,
       'consumes' AS type FROM j
UNION ALL SELECT 'priority:' || o_orderpriority, job, 'consumes' FROM j
UNION ALL SELECT job, 'status:' || o_orderstatus, 'produces' FROM j
UNION ALL SELECT 'job:' || CAST(o_custkey AS VARCHAR), job, 'after' FROM j
          WHERE o_orderstatus = 'F'""",
    "column_lineage": """SELECT 'part:' || CAST(l_partkey AS VARCHAR) AS upstream,
       UNNEST(['p_retailprice', 'p_size']) AS upstream_column,
       'order:' || CAST(l_orderkey AS VARCHAR) AS downstream,
       'o_totalprice' AS downstream_column, l_returnflag AS operation
FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM lineitem e WHERE e.l_linestatus = 'F' AND e.l_partkey = l.l_partkey
    AND e.l_orderkey = l.l_orderkey)""",
    "lineage_walk": f"""WITH RECURSIVE {KEY_EDGES_SQL},
up(entity, hops) AS (
  SELECT 'region:0', 0
  UNION SELECT upstream, hops + 1 FROM up JOIN edges ON downstream = entity),
down(entity, hops) AS (
  SELECT 'part:1', 0
  UNION SELECT downstream, hops + 1 FROM down JOIN edges ON upstream = entity)
SELECT entity, CAST(MIN(hops) AS INTEGER) AS hops, 'upstream of region:0' AS walk
FROM up WHERE hops > 0 GROUP BY entity
UNION ALL
SELECT entity, CAST(MIN(hops) AS INTEGER), 'downstream of part:1'
FROM down WHERE hops > 0 GROUP BY entity""",
}
