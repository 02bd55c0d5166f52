"""Registered queries: data-quality rules, results and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import profiling, quality
from gaugeworks.operators.quality import BETWEEN, EQUAL_TO, FAILED, NOT_NULL, SUCCESS, DqRule
from gaugeworks.operators.sensors import sensor_profiles
from gaugeworks.operators.stored_profile import merged_profile, profile_batch
from gaugeworks.plans.standins import PROFILES_SQL, READINGS_SQL, readings, table
from gaugeworks.session import scratch_path

VALUE_LIMIT = 150.0
CHECKED_AT = "2024-02-01 00:00:00"

LINE_RULES = [
    DqRule("order_present", "l_orderkey", NOT_NULL, suite="lines"),
    DqRule("quantity_range", "l_quantity", BETWEEN, 1, 50, suite="lines"),
    DqRule("discount_range", "l_discount", BETWEEN, 0, 0.05, suite="lines"),
    DqRule("price_range", "l_extendedprice", BETWEEN, 0, 1000000, suite="lines"),
    DqRule("not_returned", "l_returnflag", EQUAL_TO, value="N", suite="lines"),
]

PROFILED = ["lineitem", "orders", "customer", "events", "documents"]


def checked_at() -> Column:
    """Time put on profiles and checks; without zone, so that all engines show it alike."""
    return F.lit(CHECKED_AT).cast("timestamp_ntz")


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily outcome of one test per user and event type: no value above the limit."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type", F.window("ts", "1 day"))
        .agg(F.max("event_id").alias("run_id"), F.max("value").alias("top"))
    )
    return daily.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("_"), "event_type")
        .alias("test"),
        "run_id",
        F.col("window.start").alias("ts"),
        F.when(F.col("top") > VALUE_LIMIT, FAILED).otherwise(SUCCESS).alias("status"),
        F.format_string("largest value %.2f", "top").alias("message"),
    )


RESULTS_SQL = """results AS (
  SELECT 'user:' || CAST(user_id AS VARCHAR) AS entity,
         'user_' || CAST(user_id AS VARCHAR) || '_' || event_type AS test,
         MAX(event_id) AS run_id, DATE_TRUNC('day', ts) AS ts,
         CASE WHEN MAX(value) > 150 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         printf('largest value %.2f', MAX(value)) AS message
  FROM events GROUP BY user_id, event_type, DATE_TRUNC('day', ts))"""


def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of another producer: one check per order, with a score of its own."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("entity"),
        F.lit("order_closed").alias("test"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", SUCCESS).otherwise(FAILED).alias("status"),
        F.col("o_totalprice").alias("score"),
    )


def q_dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dq_not_null(readings(spark, sf_dir), "sensor_id", "readings")


def q_dq_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = sensor_profiles(readings(spark, sf_dir))
    return quality.dq_between(profiles, "confidence", 0, 1, "sensor_profiles")


def q_dq_equal_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dq_equal_to(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "orders")


def q_dq_suite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return quality.dq_suite_run(lines, LINE_RULES, "lineitem", checked_at())


def q_table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [
        profiling.table_profile(
            table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet", name, checked_at()
        )
        for name in PROFILED
    ]
    # Stored bytes are unknown to the checking engine, so only their presence is compared.
    return reduce(DataFrame.unionByName, profiles).select(
        "table", "ts", "row_count", "column_count", (F.col("size_in_bytes") > 0).alias("has_size")
    )


def profiled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn(
        "closed_price", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    )


def q_profile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact figures of `column_profile`, merged from the profiles of three batches."""
    orders, path = profiled_orders(spark, sf_dir), scratch_path(spark, "profiles")
    day = F.col("o_orderdate").cast("date")
    cuts = [F.lit(text).cast("date") for text in ("1994-01-01", "1997-01-01")]
    parts = {"old": day < cuts[0], "middle": (day >= cuts[0]) & (day < cuts[1]), "new": day >= cuts[1]}
    for name, wanted in parts.items():
        profile_batch(orders.where(wanted), path, name)
    profile = merged_profile(spark, path, orders.schema, "orders")
    return profile.select(
        "table", "column", "values_count", "null_count", "missing_count", "min", "max",
        F.round("mean", 6).alias("mean"),
    )


def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = profiled_orders(spark, sf_dir)
    rounded = {
        c: F.round(c, 6) for c in ("null_proportion", "unique_proportion", "mean", "median")
    }
    return profiling.column_profile(orders, "orders", ts=checked_at()).withColumns(rounded)


def q_column_sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_sample_values(table(spark, sf_dir, "lineitem"), 3)


def q_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.sample_rows(table(spark, sf_dir, "lineitem"), 7)


def q_sample_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.sample_payload(table(spark, sf_dir, "orders"), 5, ["o_orderkey"])


def q_lineage_dq_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("entity")
    )
    return quality.lineage_dq_badge(nodes, rule_results(spark, sf_dir))


def q_dq_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dq_incidents(rule_results(spark, sf_dir))


def q_dq_pass_rate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = quality.dq_pass_rate_daily(rule_results(spark, sf_dir))
    return rates.withColumn("pass_rate", F.round("pass_rate", 6))


def q_union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.union_results(
        rule_results(spark, sf_dir), ("EXTERNAL", external_results(spark, sf_dir))
    )


QUERIES = {
    "dq_not_null": q_dq_not_null,
    "dq_between": q_dq_between,
    "dq_equal_to": q_dq_equal_to,
    "dq_suite_run": q_dq_suite_run,
    "table_profile": q_table_profile,
    "column_profile": q_column_profile,
    "profile_batches": q_profile_batches,
    "column_sample_values": q_column_sample_values,
    "sample_rows": q_sample_rows,
    "sample_payload": q_sample_payload,
    "lineage_dq_badge": q_lineage_dq_badge,
    "dq_incidents": q_dq_incidents,
    "dq_pass_rate_daily": q_dq_pass_rate_daily,
    "union_results": q_union_results,
}

_TABLE_COLUMNS = {"lineitem": 11, "orders": 6, "customer": 5, "events": 6, "documents": 5}

_ORDER_COLUMNS = {
    "o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True,
    "o_orderdate": False, "o_orderpriority": False, "closed_price": True,
}

_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _column_sql(name: str, numeric: bool) -> str:
    blank = f"{name} IS NULL" if numeric else f"{name} IS NULL OR CAST({name} AS VARCHAR) = ''"
    mean = f"ROUND(AVG({name}), 6)" if numeric else "CAST(NULL AS DOUBLE)"
    median = f"ROUND(MEDIAN(CAST({name} AS DOUBLE)), 6)" if numeric else "CAST(NULL AS DOUBLE)"
    return f"""SELECT 'orders' AS "table", '{name}' AS "column",
  TIMESTAMP '{CHECKED_AT}' AS ts, COUNT(*) AS values_count,
  COUNT(*) FILTER (WHERE {name} IS NULL) AS null_count,
  COUNT(*) FILTER (WHERE {blank}) AS missing_count,
  COUNT(DISTINCT {name}) AS unique_count,
  ROUND(COUNT(*) FILTER (WHERE {name} IS NULL) / CAST(COUNT(*) AS DOUBLE), 6) AS null_proportion,
  ROUND(COUNT(DISTINCT {name}) / CAST(COUNT(*) AS DOUBLE), 6) AS unique_proportion,
  CAST(MIN({name}) AS VARCHAR) AS min, CAST(MAX({name}) AS VARCHAR) AS max,
  {mean} AS mean, {median} AS median FROM shown"""


def _sample_sql(name: str) -> str:
    return f"""SELECT '{name}' AS "column", CAST(rank AS INTEGER) AS rank,
  CAST(value AS VARCHAR) AS value FROM (
    SELECT value, ROW_NUMBER() OVER (ORDER BY value) AS rank
    FROM (SELECT DISTINCT {name} AS value FROM lineitem) WHERE value IS NOT NULL)
WHERE rank <= 3"""


_BETWEEN_SQL = """SELECT 'lines' AS suite, '{test}' AS test, 'lineitem' AS "table",
  '{column}' AS "column", TIMESTAMP '2024-02-01 00:00:00' AS ts,
  CASE WHEN bad = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  printf('%d values of {column} not within {low} to {high}, observed %.2f to %.2f', bad, lo, hi)
    AS message,
  total, bad AS violations, lo AS observed_min, hi AS observed_max
FROM (SELECT COUNT(*) AS total, MIN({column}) AS lo, MAX({column}) AS hi,
        COUNT(*) FILTER (WHERE NOT {column} BETWEEN {low} AND {limit}) AS bad FROM lineitem)"""

ORACLE = {
    "dq_not_null": f"""WITH {READINGS_SQL}
SELECT 'sensor_id_not_null' AS test,
       CASE WHEN COUNT(*) = COUNT(sensor_id) THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       COUNT(*) - COUNT(sensor_id) AS null_count, COUNT(*) AS total_rows
FROM readings""",
    "dq_between": f"""WITH {PROFILES_SQL}
SELECT 'confidence_in_range' AS test,
       CASE WHEN COUNT(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) = 0
            THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       COUNT(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) AS violations,
       CAST(MIN(confidence) AS DOUBLE) AS observed_min,
       CAST(MAX(confidence) AS DOUBLE) AS observed_max
FROM profiles""",
    "dq_equal_to": """SELECT 'o_orderstatus_equal_to' AS test,
       CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus <> 'F') = 0
            THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS violations, COUNT(*) AS total_rows
FROM orders""",
    "dq_suite_run": f"""SELECT 'lines' AS suite, 'order_present' AS test, 'lineitem' AS "table",
  'l_orderkey' AS "column", TIMESTAMP '{CHECKED_AT}' AS ts,
  CASE WHEN COUNT(*) = COUNT(l_orderkey) THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  printf('%d null in l_orderkey, rows checked: %d', COUNT(*) - COUNT(l_orderkey), COUNT(*))
    AS message,
  COUNT(*) AS total, COUNT(*) - COUNT(l_orderkey) AS violations,
  CAST(NULL AS DOUBLE) AS observed_min, CAST(NULL AS DOUBLE) AS observed_max
FROM lineitem
UNION ALL
{_BETWEEN_SQL.format(test="quantity_range", column="l_quantity", low="1", high="50", limit="50")}
UNION ALL
{_BETWEEN_SQL.format(test="discount_range", column="l_discount", low="0", high="0.05",
                     limit="CAST(0.05 AS DOUBLE)")}
UNION ALL
{_BETWEEN_SQL.format(test="price_range", column="l_extendedprice", low="0", high="1000000",
                     limit="1000000")}
UNION ALL
SELECT 'lines', 'not_returned', 'lineitem', 'l_returnflag', TIMESTAMP '{CHECKED_AT}',
  CASE WHEN COUNT(*) FILTER (WHERE l_returnflag <> 'N') = 0 THEN 'SUCCESS' ELSE 'FAILED' END,
  printf('%d values of l_returnflag differ from N, rows checked: %d',
         COUNT(*) FILTER (WHERE l_returnflag <> 'N'), COUNT(*)),
  COUNT(*), COUNT(*) FILTER (WHERE l_returnflag <> 'N'), NULL, NULL
FROM lineitem""",
    "table_profile": "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", TIMESTAMP '{CHECKED_AT}' AS ts,
  COUNT(*) AS row_count, CAST({width} AS INTEGER) AS column_count, TRUE AS has_size FROM {name}"""
        for name, width in _TABLE_COLUMNS.items()
    ),
    "column_profile": """WITH shown AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS closed_price FROM orders)
""" + "\nUNION ALL\n".join(_column_sql(*column) for column in _ORDER_COLUMNS.items()),
    "column_sample_values": "\nUNION ALL\n".join(_sample_sql(name) for name in _LINE_COLUMNS),
    "sample_rows": f"""SELECT {", ".join(_LINE_COLUMNS)} FROM lineitem
ORDER BY {", ".join(_LINE_COLUMNS)} LIMIT 7""",
    "sample_payload": f"""SELECT {list(_ORDER_COLUMNS)[:-1]} AS columns,
       LIST(shown ORDER BY shown) AS rows
FROM (SELECT [{", ".join(f"CAST({c} AS VARCHAR)" for c in list(_ORDER_COLUMNS)[:-1])}] AS shown
      FROM orders ORDER BY o_orderkey LIMIT 5)""",
    "lineage_dq_badge": f"""WITH {RESULTS_SQL}, latest AS (
  SELECT entity, test, status, ROW_NUMBER() OVER (
    PARTITION BY entity, test ORDER BY ts DESC, run_id DESC) AS n FROM results),
per_entity AS (
  SELECT entity, COUNT(*) FILTER (WHERE status = 'FAILED') AS failed_tests, COUNT(*) AS tests
  FROM latest WHERE n = 1 GROUP BY entity),
nodes AS (SELECT DISTINCT 'user:' || CAST(c_custkey AS VARCHAR) AS entity FROM customer)
SELECT nodes.entity,
       CASE WHEN failed_tests > 0 THEN 'red' WHEN tests > 0 THEN 'green' ELSE 'none' END AS badge,
       COALESCE(failed_tests, 0) AS failed_tests, COALESCE(tests, 0) AS tests
FROM nodes LEFT JOIN per_entity ON nodes.entity = per_entity.entity""",
    "dq_incidents": f"""WITH {RESULTS_SQL}
SELECT test || '/' || CAST(run_id AS VARCHAR) AS incident, test, entity, run_id, ts, message
FROM results WHERE status = 'FAILED'""",
    "dq_pass_rate_daily": f"""WITH {RESULTS_SQL}
SELECT ts AS day, COUNT(*) AS runs,
       ROUND(AVG(CASE WHEN status = 'SUCCESS' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM results GROUP BY ts""",
    "union_results": f"""WITH {RESULTS_SQL}
SELECT entity, test, run_id, ts, status, message, 'NATIVE' AS source,
       CAST(NULL AS DOUBLE) AS score FROM results
UNION ALL
SELECT 'user:' || CAST(o_custkey AS VARCHAR), 'order_closed', o_orderkey, o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' ELSE 'FAILED' END, NULL, 'EXTERNAL',
       o_totalprice
FROM orders""",
}
ORACLE["profile_batches"] = f"""SELECT "table", "column", values_count, null_count, missing_count,
  "min", "max", mean FROM ({ORACLE["column_profile"]})"""
