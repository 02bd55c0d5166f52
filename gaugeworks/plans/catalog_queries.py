"""Registered queries: schema catalog, identity, governance, lookup, search and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import keys
from gaugeworks.operators import catalog, lineage, quality, search_index
from gaugeworks.operators.catalog import GOVERNANCE_FIELDS
from gaugeworks.operators.joins import sized_join
from gaugeworks.operators.kpi_deltas import KpiState
from gaugeworks.operators.quality import FAILED
from gaugeworks.plans.lineage_queries import KEY_EDGES_SQL, key_edges
from gaugeworks.plans.quality_queries import RESULTS_SQL, rule_results
from gaugeworks.plans.standins import READINGS_SQL, readings, table, tagged
from gaugeworks.session import scratch_path, settle

KNOWN_FLAGS = ["A", "N"]


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance changes from orders; each order sets some fields of its customer.

    The order's priority is the name of the column concerned, for changes per column.
    """
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    order = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        tagged("customer", "o_custkey").alias("key"),
        priority.alias("name"),
        F.when(status == "F", F.concat(F.lit("team "), priority)).alias("owner"),
        F.when(status == "P", F.concat(F.lit("Tier"), F.substring("o_orderpriority", 1, 1)))
        .alias("tier"),
        F.when(priority == "5-LOW", "sales").alias("domain"),
        F.when(priority == "1-URGENT", "hot-account").alias("term"),
        F.when(status == "O", F.concat(F.lit("order "), order)).alias("description"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )


def governed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with attached fields, and suppliers and parts without any."""
    customers = table(spark, sf_dir, "customer").select(
        tagged("customer", "c_custkey").alias("key")
    )
    attached = catalog.governance_attach(customers, customer_changes(spark, sf_dir)).select(
        "key", F.lit("customer").alias("type"), "owner", "tier", "description"
    )
    bare = [F.lit(None).cast("string").alias(c) for c in ("owner", "tier")]
    suppliers = table(spark, sf_dir, "supplier").select(
        tagged("supplier", "s_suppkey").alias("key"), F.lit("supplier").alias("type"), *bare,
        F.col("s_name").alias("description"),
    )
    parts = table(spark, sf_dir, "part").select(
        tagged("part", "p_partkey").alias("key"), F.lit("part").alias("type"), *bare,
        F.col("p_name").alias("description"),
    )
    return attached.unionByName(suppliers).unionByName(parts)


def parts_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        tagged("part", "p_partkey").alias("key"),
        F.col("p_name").alias("external_name"),
        F.col("p_brand").alias("internal_name"),
        F.col("p_type").alias("type"),
        F.col("p_size").cast("string").alias("size"),
        F.split("p_name", " ").alias("tags"),
    )


def q_schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = {"readings": readings(spark, sf_dir)}
    described |= {name: table(spark, sf_dir, name) for name in ("orders", "nation")}
    parts = [catalog.schema_catalog(df, name) for name, df in described.items()]
    return reduce(DataFrame.unionByName, parts)


def q_entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        keys.dotted_name(F.lit("store"), F.col("p_type"), F.col("p_brand"), F.col("p_name"))
        .alias("dotted"),
        keys.dataset_urn("plant", F.concat_ws(".", "p_type", "p_name")).alias("urn"),
        keys.job_urn("plant", F.col("p_type"), F.col("p_name")).alias("job"),
        keys.path_name(F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name")).alias("path"),
    )


def q_governance_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        tagged("customer", "c_custkey").alias("key"),
        F.lit("unassigned").alias("domain"),
    )
    changes = customer_changes(spark, sf_dir)
    entities = catalog.governance_attach(customers, changes)
    columns = catalog.governance_attach(
        changes.select("key", "name").distinct(), changes, ("key", "name")
    )
    shown = ["key", "name", *GOVERNANCE_FIELDS]
    return entities.withColumn("name", F.lit(None).cast("string")).select(shown).unionByName(
        columns.select(shown)
    )


def q_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = parts_as_entities(spark, sf_dir)
    names = entities.select(
        F.explode(F.array("external_name", "internal_name", "type")).alias("name")
    )
    return catalog.entity_lookup(names, entities)


def q_dotted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    dotted = keys.dotted_name(F.lit("store"), F.col("p_type"), F.col("p_brand"), F.col("p_name"))
    entities = parts.where("p_size > 10").select(
        tagged("part", "p_partkey").alias("key"), dotted.alias("dotted")
    )
    return catalog.entity_lookup(parts.select(dotted.alias("name")), entities, ["dotted"])


def q_governance_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = catalog.governance_kpis(
        governed_entities(spark, sf_dir), key_edges(spark, sf_dir), rule_results(spark, sf_dir)
    )
    return kpis.select([F.round(c, 6).alias(c) if c.endswith(("_share", "_rate")) else F.col(c)
                        for c in kpis.columns])


def q_kpi_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of `governance_kpis`, kept by signed changes in three batches.

    The second batch brings rows without their tier, edges and results that do not last; the
    third takes them away.
    """
    state = KpiState(scratch_path(spark, "kpis"), buckets=16)
    entities, edges, results = (
        make(spark, sf_dir) for make in (governed_entities, key_edges, rule_results)
    )
    settled = settle(entities)
    customers = F.col("type") == "customer"
    bare = settled.where(customers).withColumn("tier", F.lit(None).cast("string"))
    passing = edges.select(F.col("upstream").alias("downstream"), F.lit("part:1").alias("upstream"))
    failed = results.withColumn("status", F.lit(FAILED))

    def signed(*parts: tuple[DataFrame, int]) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.withColumn("sign", F.lit(sign)) for df, sign in parts])

    state.apply(spark, 1, signed((settled.where(~customers), 1)), signed((edges, 1)), signed((results, 1)))
    state.apply(spark, 2, signed((bare, 1)), signed((passing, 1)), signed((failed, 1)))
    state.apply(
        spark, 3, signed((bare, -1), (settled.where(customers), 1)), signed((passing, -1)), signed((failed, -1))
    )
    kpis = state.kpis(spark)
    return kpis.select([F.round(c, 6).alias(c) if c.endswith(("_share", "_rate")) else F.col(c)
                        for c in kpis.columns])


def q_facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.facet_filter(
        parts_as_entities(spark, sf_dir),
        {"type": ["ECONOMY", "PROMO", "SMALL"], "tags": ["ring", "bolt", "gear", "widget"]},
        prefix="s", name="external_name",
    )
    return catalog.facet_counts(found, ["type", "internal_name", "size", "tags"])


def q_governed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        tagged("customer", "c_custkey").alias("key")
    )
    governed = catalog.governance_attach(customers, customer_changes(spark, sf_dir))
    found = catalog.facet_filter(
        governed,
        {"owner": ["team 1-URGENT", "team 5-LOW"], "domain": ["sales"], "term": ["hot-account"]},
    )
    return catalog.facet_counts(found, ["owner", "tier", "domain", "term"])


def q_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.keyword_search(table(spark, sf_dir, "documents"), "text", "On THE, of")
    return found.select("doc_id", "lang", "n_chars")


def q_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of `keyword_search`, on posting lists that are added to in two batches."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "keywords")
    for batch, wanted in (("even", "doc_id % 2 = 0"), ("odd", "doc_id % 2 <> 0")):
        search_index.add_to_keyword_index(docs.where(wanted), path, batch, "doc_id", "text")
    found = search_index.keyword_lookup(spark, path, "On THE, of").withColumnRenamed("key", "doc_id")
    return sized_join(docs.select("doc_id", "lang", "n_chars"), found, ["doc_id"], "left_semi")


def q_facet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of `facet_search`, on bitmaps."""
    path, facets = scratch_path(spark, "facets"), ["type", "internal_name", "size", "tags"]
    search_index.write_facet_index(parts_as_entities(spark, sf_dir), path, facets, name="external_name")
    found = search_index.facet_lookup(
        spark, path,
        {"type": ["ECONOMY", "PROMO", "SMALL"], "tags": ["ring", "bolt", "gear", "widget"]}, prefix="s",
    )
    return search_index.indexed_facet_counts(spark, path, found, facets)


def q_walk_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges along the lineage: what a region stands on, with the outcome of its tests.

    The daily tests of a user count as tests of the customer of that number.
    """
    walked = lineage.lineage_walk(settle(key_edges(spark, sf_dir)), "region:0", "upstream")
    results = rule_results(spark, sf_dir).withColumn("entity", F.replace("entity", F.lit("user:"), F.lit("customer:")))
    return walked.join(quality.lineage_dq_badge(walked, results), "entity")


def q_orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(
        tagged("customer", "o_custkey").alias("upstream"),
        tagged("order", "o_orderkey").alias("downstream"),
    )
    customers = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    registered = customers.select(tagged("customer", "c_custkey").alias("key")).unionByName(
        orders.select(tagged("order", "o_orderkey").alias("key"))
    )
    return catalog.orphan_edges(edges, registered)


def q_payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("key"),
        F.col("l_returnflag").alias("type"),
        tagged("supplier", "l_suppkey").alias("data_source"),
        F.when(F.col("l_linestatus") == "F", tagged("order", "l_orderkey")).alias("parent"),
    )
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return catalog.payload_checks(
        payload,
        KNOWN_FLAGS,
        suppliers.select(tagged("supplier", "s_suppkey").alias("key")),
        orders.select(tagged("order", "o_orderkey").alias("key")),
    )


QUERIES = {
    "schema_catalog": q_schema_catalog,
    "entity_key": q_entity_key,
    "governance_attach": q_governance_attach,
    "entity_lookup": q_entity_lookup,
    "dotted_lookup": q_dotted_lookup,
    "governance_kpis": q_governance_kpis,
    "kpi_deltas": q_kpi_deltas,
    "facet_search": q_facet_search,
    "governed_search": q_governed_search,
    "keyword_search": q_keyword_search,
    "keyword_index": q_keyword_index,
    "walk_badges": q_walk_badges,
    "facet_index": q_facet_index,
    "orphan_edges": q_orphan_edges,
    "payload_checks": q_payload_checks,
}

_ORDER_TYPES = {
    "o_orderkey": "TYPE_INTEGER", "o_custkey": "TYPE_INTEGER", "o_orderstatus": "TYPE_STRING",
    "o_totalprice": "TYPE_NUMBER", "o_orderdate": "TYPE_DATETIME",
    "o_orderpriority": "TYPE_STRING",
}
_NATION_TYPES = {
    "n_nationkey": "TYPE_INTEGER", "n_name": "TYPE_STRING", "n_regionkey": "TYPE_INTEGER",
}
_READING_TYPES = {
    "sensor_id": "TYPE_STRING", "metric_1": "TYPE_NUMBER", "metric_2": "TYPE_NUMBER",
    "ts": "TYPE_STRING",
}


def _catalog_sql(key: str, source: str, types: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{key}' AS key, CAST({i} AS INTEGER) AS position, '{name}' AS name,
  '{kind}' AS catalog_type, COUNT(*) > COUNT({name}) AS has_nulls FROM {source}"""
        for i, (name, kind) in enumerate(types.items(), 1)
    )


CHANGES_SQL = """changes AS (
  SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS name,
    o_orderdate AS ts, o_orderkey AS seq,
    CASE WHEN o_orderstatus = 'F' THEN 'team ' || o_orderpriority END AS owner,
    CASE WHEN o_orderstatus = 'P' THEN 'Tier' || SUBSTRING(o_orderpriority, 1, 1) END AS tier,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'sales' END AS domain,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'hot-account' END AS term,
    CASE WHEN o_orderstatus = 'O' THEN 'order ' || CAST(o_orderkey AS VARCHAR) END AS description
  FROM orders)""" + "".join(
    f""", new_{field} AS (
  SELECT key, {field} FROM (
    SELECT key, {field}, ROW_NUMBER() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n
    FROM changes WHERE {field} IS NOT NULL) WHERE n = 1)"""
    for field in GOVERNANCE_FIELDS
)

_FOUND_SQL = """found AS (
  SELECT p_type AS type, p_brand AS internal_name, CAST(p_size AS VARCHAR) AS size,
         string_split(p_name, ' ') AS tags
  FROM part
  WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') AND p_name LIKE 's%'
    AND list_has_any(string_split(p_name, ' '), ['ring', 'bolt', 'gear', 'widget']))"""

ORACLE = {
    "schema_catalog": f"""WITH {READINGS_SQL.replace("AS metric_2", "AS metric_2, ts")}
{_catalog_sql("readings", "readings", _READING_TYPES)}
UNION ALL
{_catalog_sql("orders", "orders", _ORDER_TYPES)}
UNION ALL
{_catalog_sql("nation", "nation", _NATION_TYPES)}""",
    "entity_key": """SELECT p_partkey,
  'store.' || p_type || '.' || p_brand || '.' || p_name AS dotted,
  'urn:li:dataset:(urn:li:dataPlatform:file,plant.' || p_type || '.' || p_name || ',PROD)' AS urn,
  'urn:li:dataJob:(urn:li:dataFlow:(spark,plant.' || p_type || ',PROD),' || p_name || ')' AS job,
  '//file/host/local/path/' || p_type || '/' || p_name AS path
FROM part""",
    "governance_attach": f"""WITH {CHANGES_SQL}
SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS name,
       owner, tier, COALESCE(domain, 'unassigned') AS domain, term, description
FROM customer
""" + "\n".join(
        f"LEFT JOIN new_{f} ON new_{f}.key = 'customer:' || CAST(c_custkey AS VARCHAR)"
        for f in GOVERNANCE_FIELDS
    ) + """
UNION ALL
SELECT key, name, """ + ", ".join(
        f"ARG_MAX({f}, ROW(ts, seq)) FILTER (WHERE {f} IS NOT NULL) AS {f}"
        for f in GOVERNANCE_FIELDS
    ) + """
FROM changes GROUP BY key, name""",
    "entity_lookup": """WITH asked AS (
  SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part)
SELECT name, MIN('part:' || CAST(p_partkey AS VARCHAR)) AS key
FROM asked LEFT JOIN part ON p_name = name OR p_brand = name GROUP BY name""",
    "dotted_lookup": """WITH parts AS (
  SELECT *, 'store.' || p_type || '.' || p_brand || '.' || p_name AS dotted FROM part)
SELECT dotted AS name,
       MIN('part:' || CAST(p_partkey AS VARCHAR)) FILTER (WHERE p_size > 10) AS key
FROM parts GROUP BY dotted""",
    "governance_kpis": f"""WITH {CHANGES_SQL}, {KEY_EDGES_SQL}, {RESULTS_SQL}, entities AS (
  SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key, 'customer' AS type,
         owner, tier, description
  FROM customer
  LEFT JOIN new_owner ON new_owner.key = 'customer:' || CAST(c_custkey AS VARCHAR)
  LEFT JOIN new_tier ON new_tier.key = 'customer:' || CAST(c_custkey AS VARCHAR)
  LEFT JOIN new_description ON new_description.key = 'customer:' || CAST(c_custkey AS VARCHAR)
  UNION ALL
  SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'supplier', NULL, NULL, s_name FROM supplier
  UNION ALL
  SELECT 'part:' || CAST(p_partkey AS VARCHAR), 'part', NULL, NULL, p_name FROM part),
linked AS (SELECT upstream AS key FROM edges UNION SELECT downstream FROM edges),
flags AS (
  SELECT type, CASE WHEN owner IS NULL THEN 0.0 ELSE 1.0 END AS o,
         CASE WHEN tier IS NULL THEN 0.0 ELSE 1.0 END AS t,
         CASE WHEN description IS NULL THEN 0.0 ELSE 1.0 END AS d,
         CASE WHEN linked.key IS NULL THEN 0.0 ELSE 1.0 END AS l
  FROM entities LEFT JOIN linked ON linked.key = entities.key)
SELECT type, COUNT(*) AS assets, ROUND(AVG(o), 6) AS owner_share, ROUND(AVG(t), 6) AS tier_share,
       ROUND(AVG(d), 6) AS description_share, ROUND(AVG(l), 6) AS lineage_share,
       CAST(NULL AS DOUBLE) AS dq_pass_rate
FROM flags GROUP BY type
UNION ALL
SELECT 'ALL', COUNT(*), ROUND(AVG(o), 6), ROUND(AVG(t), 6), ROUND(AVG(d), 6), ROUND(AVG(l), 6),
       (SELECT ROUND(AVG(CASE WHEN status = 'SUCCESS' THEN 1.0 ELSE 0.0 END), 6) FROM results)
FROM flags""",
    "facet_search": f"""WITH {_FOUND_SQL}
SELECT 'type' AS facet, type AS value, COUNT(*) AS entities FROM found GROUP BY type
UNION ALL
SELECT 'internal_name', internal_name, COUNT(*) FROM found GROUP BY internal_name
UNION ALL
SELECT 'size', size, COUNT(*) FROM found GROUP BY size
UNION ALL
SELECT 'tags', tag, COUNT(*) FROM (
  SELECT UNNEST(list_distinct(tags)) AS tag FROM found) GROUP BY tag""",
    "governed_search": f"""WITH {CHANGES_SQL}, found AS (
  SELECT owner, tier, domain, term FROM customer
  """ + "\n  ".join(
        f"LEFT JOIN new_{f} ON new_{f}.key = 'customer:' || CAST(c_custkey AS VARCHAR)"
        for f in ("owner", "tier", "domain", "term")
    ) + """
  WHERE owner IN ('team 1-URGENT', 'team 5-LOW') AND domain = 'sales' AND term = 'hot-account')
""" + "\nUNION ALL\n".join(
        f"SELECT '{f}' AS facet, {f} AS value, COUNT(*) AS entities FROM found "
        f"WHERE {f} IS NOT NULL GROUP BY {f}"
        for f in ("owner", "tier", "domain", "term")
    ),
    "keyword_search": """WITH words AS (
  SELECT doc_id, lang, n_chars, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w
  FROM documents)
SELECT doc_id, lang, n_chars FROM words
WHERE list_contains(w, 'on') AND list_contains(w, 'the') AND list_contains(w, 'of')""",
    "orphan_edges": """WITH edges AS (
  SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS upstream,
         'order:' || CAST(o_orderkey AS VARCHAR) AS downstream FROM orders),
registered AS (
  SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal >= 0
  UNION SELECT 'order:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')
SELECT upstream, downstream,
       CASE WHEN u.key IS NULL AND d.key IS NULL THEN 'both'
            WHEN u.key IS NULL THEN 'upstream' ELSE 'downstream' END AS missing_end
FROM edges LEFT JOIN registered u ON u.key = upstream LEFT JOIN registered d ON d.key = downstream
WHERE u.key IS NULL OR d.key IS NULL""",
    "payload_checks": """WITH payload AS (
  SELECT concat_ws('/', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR)) AS key,
         l_returnflag, l_suppkey, CASE WHEN l_linestatus = 'F' THEN l_orderkey END AS parent
  FROM lineitem)
SELECT key, 'unknown_type' AS reason FROM payload WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL
SELECT key, 'unknown_data_source' FROM payload WHERE NOT EXISTS (
  SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal >= 0)
UNION ALL
SELECT key, 'unknown_parent' FROM payload WHERE parent IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_orderkey = parent AND o_orderstatus <> 'P')""",
}
ORACLE |= {"keyword_index": ORACLE["keyword_search"], "facet_index": ORACLE["facet_search"],
           "kpi_deltas": ORACLE["governance_kpis"]}
ORACLE["walk_badges"] = f"""WITH RECURSIVE {KEY_EDGES_SQL}, {RESULTS_SQL}, up(entity, hops) AS (
  SELECT 'region:0', 0
  UNION SELECT upstream, hops + 1 FROM up JOIN edges ON downstream = entity),
walked AS (SELECT entity, CAST(MIN(hops) AS INTEGER) AS hops FROM up WHERE hops > 0 GROUP BY entity),
latest AS (
  SELECT replace(entity, 'user:', 'customer:') AS entity, test, status, ROW_NUMBER() OVER (
    PARTITION BY entity, test ORDER BY ts DESC, run_id DESC) AS n FROM results),
per_entity AS (
  SELECT entity, COUNT(*) FILTER (WHERE status = 'FAILED') AS failed_tests, COUNT(*) AS tests
  FROM latest WHERE n = 1 GROUP BY entity)
SELECT walked.entity, hops,
       CASE WHEN failed_tests > 0 THEN 'red' WHEN tests > 0 THEN 'green' ELSE 'none' END AS badge,
       COALESCE(failed_tests, 0) AS failed_tests, COALESCE(tests, 0) AS tests
FROM walked LEFT JOIN per_entity ON walked.entity = per_entity.entity"""
