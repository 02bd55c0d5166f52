"""Registered queries: latest values, version history, pages and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import keys
from gaugeworks.operators import latest
from gaugeworks.operators.keyed_table import KeyedTable
from gaugeworks.operators.stored_versions import VersionHistory
from gaugeworks.plans.standins import CHANGE_LOG_SQL, change_log, table
from gaugeworks.session import scratch_path

PROPS = T.StructType([T.StructField("k", T.IntegerType())])


def q_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    later = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return latest.upsert_latest(log.where(~later), log.where(later), ["urn", "aspect"])


def q_aspect_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.aspect_versions(change_log(spark, sf_dir)).drop("actor")


def q_upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest values of `upsert_latest`, written to a bucketed table in three turns."""
    log = change_log(spark, sf_dir)
    kept = KeyedTable(scratch_path(spark, "keyed"), ("urn", "aspect"), log.schema, buckets=64)
    days = [F.lit(day).cast("timestamp_ntz") for day in ("2024-01-16", "2024-01-29")]
    kept.upsert(log.where(F.col("ts") < days[1]))
    kept.upsert(log.where(F.col("ts") >= days[1]))
    kept.upsert(log.where(F.col("ts") >= days[0]))  # again in part: changes nothing
    return kept.read(spark)


def q_version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of `aspect_versions`, from batches that come in order but for the last."""
    log = change_log(spark, sf_dir)
    history = VersionHistory(scratch_path(spark, "versions"), log.schema)
    day = F.lit("2024-01-16").cast("timestamp_ntz")
    late = F.col("seq") % 500 == 7
    history.append(log.where((F.col("ts") < day) & ~late), 1)
    history.append(log.where((F.col("ts") >= day) & ~late), 2)
    history.append(log.where(late), 3)
    return history.read(spark).drop("actor")


def q_entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of whatever aspects there are, as text."""
    page = latest.entity_page(change_log(spark, sf_dir))
    lines = F.transform(F.map_entries("aspects"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return page.select("urn", F.array_join(lines, "; ").alias("aspects"))


def q_editorial_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("urn"),
        F.col("c_mktsegment").alias("description"),
        F.col("c_name").alias("owner"),
    )
    order = F.col("o_orderkey").cast("string")
    edits = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("urn"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("urgent "), order))
        .alias("description"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("clerk "), order)).alias("owner"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )
    return latest.editorial_overlay(ingested, edits, "urn", ["description", "owner"])


def q_aspect_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    record = keys.aspect_encode(
        F.lit("corpuser"), F.col("urn"), F.col("aspect"), F.from_json("value", PROPS)
    )
    decoded = keys.aspect_decode(log.select("seq", record.alias("record")), "record", PROPS)
    return decoded.select("*", "aspect.k").drop("aspect")


QUERIES = {
    "upsert_latest": q_upsert_latest,
    "aspect_versions": q_aspect_versions,
    "upsert_buckets": q_upsert_buckets,
    "version_history": q_version_history,
    "entity_page": q_entity_page,
    "editorial_overlay": q_editorial_overlay,
    "aspect_encode": q_aspect_encode,
}

LATEST_SQL = f"""WITH {CHANGE_LOG_SQL}
SELECT urn, aspect, value, ts, seq, actor FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY urn, aspect ORDER BY ts DESC, seq DESC) AS n FROM log)
WHERE n = 1"""

ORACLE = {
    "upsert_latest": LATEST_SQL,
    "aspect_versions": f"""WITH {CHANGE_LOG_SQL}
SELECT urn, aspect, value, ts, seq,
       ROW_NUMBER() OVER (PARTITION BY urn, aspect ORDER BY ts DESC, seq DESC) - 1 AS version
FROM log""",
    "entity_page": f"""WITH {CHANGE_LOG_SQL}, newest AS (
  SELECT urn, aspect, value FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY urn, aspect ORDER BY ts DESC, seq DESC) AS n FROM log)
  WHERE n = 1)
SELECT urn, string_agg(concat_ws('=', aspect, value), '; ' ORDER BY aspect) AS aspects
FROM newest GROUP BY urn""",
    "editorial_overlay": """WITH edits AS (
  SELECT o_custkey AS urn, o_orderdate AS ts, o_orderkey AS seq,
    CASE WHEN o_orderpriority = '1-URGENT'
         THEN 'urgent ' || CAST(o_orderkey AS VARCHAR) END AS description,
    CASE WHEN o_orderstatus = 'P' THEN 'clerk ' || CAST(o_orderkey AS VARCHAR) END AS owner
  FROM orders),
d AS (SELECT urn, description, ROW_NUMBER() OVER (PARTITION BY urn ORDER BY ts DESC, seq DESC) AS n
      FROM edits WHERE description IS NOT NULL),
o AS (SELECT urn, owner, ROW_NUMBER() OVER (PARTITION BY urn ORDER BY ts DESC, seq DESC) AS n
      FROM edits WHERE owner IS NOT NULL)
SELECT c_custkey AS urn, COALESCE(d.description, c_mktsegment) AS description,
       COALESCE(o.owner, c_name) AS owner
FROM customer LEFT JOIN d ON d.urn = c_custkey AND d.n = 1
              LEFT JOIN o ON o.urn = c_custkey AND o.n = 1""",
    "aspect_encode": """SELECT event_id AS seq, 'corpuser' AS entity_type,
       'urn:li:corpuser:' || CAST(user_id AS VARCHAR) AS urn, event_type AS aspect_name,
       'UPSERT' AS change_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""",
}
ORACLE |= {"upsert_buckets": LATEST_SQL, "version_history": ORACLE["aspect_versions"]}
