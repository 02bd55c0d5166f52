"""Metadata tables: schemas, governance attributes, name lookup, coverage, search, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import holds_word, quoted
from gaugeworks.operators.joins import BROADCAST_ROWS, HOT_ROWS, flag_listed, sized_join
from gaugeworks.operators.latest import newest_set
from gaugeworks.operators.quality import SUCCESS
from gaugeworks.session import settle

# Catalog type names.
TYPE_STRING, TYPE_NUMBER = "TYPE_STRING", "TYPE_NUMBER"
TYPE_INTEGER, TYPE_DATETIME = "TYPE_INTEGER", "TYPE_DATETIME"
TYPE_OTHER = "TYPE_UNKNOWN"

GOVERNANCE_FIELDS = ("owner", "tier", "domain", "term", "description")


def catalog_type(kind: T.DataType) -> str:
    """Name a catalog shows for a Spark type."""
    if isinstance(kind, T.StringType):
        return TYPE_STRING
    if isinstance(kind, T.IntegralType):
        return TYPE_INTEGER
    if isinstance(kind, T.NumericType):
        return TYPE_NUMBER
    if isinstance(kind, T.DatetimeType) or isinstance(kind, T.TimestampNTZType):
        return TYPE_DATETIME
    return TYPE_OTHER


def schema_catalog(df: DataFrame, key: str) -> DataFrame:
    """One row per column: position, name, types, and whether nulls occur in the data."""
    fields = df.schema.fields
    observed = df.agg(*[
        F.coalesce(F.bool_or(quoted(f.name).isNull()), F.lit(False)).alias(f"nulls_{i}")
        for i, f in enumerate(fields)
    ])
    entries = [
        F.struct(
            F.lit(key).alias("key"),
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(catalog_type(f.dataType)).alias("catalog_type"),
            F.col(f"nulls_{i}").alias("has_nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return observed.select(F.inline(F.array(*entries)))


def governance_attach(
    entities: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = ("key",),
    fields: Sequence[str] = GOVERNANCE_FIELDS,
) -> DataFrame:
    """Add governance fields to entities, or to columns with keys (key, name).

    `changes` holds (keys, fields, ts, seq); a null field leaves that field alone, a value
    replaces the field's earlier one. Changes shrink to one row per key before the join.
    A field the entities already have is kept where no change sets it.
    """
    newest = changes.groupBy(*keys).agg(*[
        newest_set(field, "ts", "seq").alias(f"_{field}") for field in fields
    ])
    attached = entities.join(newest, list(keys), "left")
    for field in fields:
        old = [F.col(field)] if field in entities.columns else []
        attached = attached.withColumn(field, F.coalesce(F.col(f"_{field}"), *old))
    return attached.drop(*[f"_{field}" for field in fields])


def entity_lookup(
    names: DataFrame,
    entities: DataFrame,
    name_columns: Sequence[str] = ("external_name", "internal_name"),
) -> DataFrame:
    """Resolve names to entity keys: the first entity, by key, that carries the name.

    Entities are turned into an index of one row per name by a partial aggregate, and
    requests are made distinct, so a name shared by many rows never meets in a join.
    Names nothing carries come back with a null key.
    """
    carried = F.array_distinct(F.array(*[F.col(c) for c in name_columns]))
    index = (
        entities.select("key", F.explode(carried).alias("name"))
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min("key").alias("key"))
    )
    return names.select("name").distinct().join(index, "name", "left").select("name", "key")


def governance_kpis(
    entities: DataFrame,
    edges: DataFrame,
    results: DataFrame,
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Coverage per entity type and for all types (type ALL).

    Shares of entities with owner, tier, description and at least one lineage edge; the
    quality pass rate stands on the ALL row. Ends of edges that no entity carries are dropped
    before the rest is made distinct: where the entities are few, in the scan itself.
    """
    ends = edges.select(F.explode(F.array("upstream", "downstream")).alias("key")).where(
        F.col("key").isNotNull()
    )
    known = sized_join(
        ends, entities.select("key"), ["key"], "left_semi", max_rows=max_rows, hot_rows=hot_rows
    )
    linked = known.distinct().withColumn("_linked", F.lit(True))
    flags = entities.join(linked, "key", "left").select(
        F.col("type"),
        F.col("owner").isNotNull().alias("owner"),
        F.col("tier").isNotNull().alias("tier"),
        F.col("description").isNotNull().alias("description"),
        F.col("_linked").isNotNull().alias("lineage"),
    )
    per_type = flags.groupBy("type").agg(
        F.count(F.lit(1)).alias("assets"),
        *[F.count_if(F.col(c)).alias(c) for c in ("owner", "tier", "description", "lineage")],
    )
    # Types are few, so the total is taken from the per-type counts.
    totals = per_type.rollup("type").agg(
        F.grouping("type").alias("_all"),
        *[F.sum(c).alias(c) for c in ("assets", "owner", "tier", "description", "lineage")],
    )
    passed = results.agg(F.avg((F.col("status") == SUCCESS).cast("double")))
    return totals.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("type")).alias("type"),
        "assets",
        *[
            (F.col(c) / F.col("assets")).alias(f"{c}_share")
            for c in ("owner", "tier", "description", "lineage")
        ],
        F.when(F.col("_all") == 1, passed.scalar()).alias("dq_pass_rate"),
    )


def facet_filter(
    entities: DataFrame,
    facets: Mapping[str, Sequence[str]] | None = None,
    prefix: str | None = None,
    name: str = "name",
) -> DataFrame:
    """Entities with one of the wanted values in every given facet, and the name prefix.

    A facet may be a plain column or an array column (tags).
    """
    kept = entities
    for facet, wanted in (facets or {}).items():
        column = F.col(facet)
        if isinstance(entities.schema[facet].dataType, T.ArrayType):
            kept = kept.where(F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted])))
        else:
            kept = kept.where(column.isin(list(wanted)))
    return kept if prefix is None else kept.where(F.col(name).startswith(prefix))


def facet_counts(entities: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Entities per value of each facet, all facets in one pass."""
    pairs = []
    for facet in facets:
        column = F.col(facet)
        if not isinstance(entities.schema[facet].dataType, T.ArrayType):
            column = F.array(column)
        values = F.array_distinct(column).alias("values")
        pairs.append(F.struct(F.lit(facet).alias("facet"), values))
    return (
        entities.select(F.inline(F.array(*pairs)))
        .select("facet", F.explode("values").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("entities"))
    )


def keyword_search(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every word of the query, in no particular order.

    Words are runs of ASCII letters and digits, in any case. A plain substring test goes
    first, so that the pattern is tried on candidate texts only.
    """
    words = query_words(query)
    if not words:
        raise ValueError("the query holds no word")
    lowered = F.lower(F.col(text))
    wanted = F.lit(True)
    for word in words:
        wanted = wanted & lowered.contains(word)
    for word in words:
        wanted = wanted & holds_word(lowered, word)
    return df.where(wanted)


def query_words(query: str) -> list[str]:
    """Distinct words of a query, in order."""
    spaced = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower())
    return sorted(set(spaced.split()))


def unregistered_keys(df: DataFrame, columns: Sequence[str], registry: DataFrame) -> DataFrame:
    """Distinct values of some key columns that the registry (one column: key) lacks.

    Values are made distinct before they meet the registry: no hot key in the join.
    """
    used = (
        df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("key"))
        .where(F.col("key").isNotNull())
        .distinct()
    )
    return used.join(registry.select("key").distinct(), "key", "left_anti")


def orphan_edges(
    edges: DataFrame,
    entities: DataFrame,
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Lineage edges with an end that is no registered entity, and which ends those are."""
    missing = settle(unregistered_keys(edges, ["upstream", "downstream"], entities))
    flagged = flag_listed(
        edges,
        {"_upstream_gone": ("upstream", missing), "_downstream_gone": ("downstream", missing)},
        max_rows=max_rows,
        hot_rows=hot_rows,
    )
    up, down = F.col("_upstream_gone"), F.col("_downstream_gone")
    return flagged.where(up | down).select(
        *edges.columns,
        F.when(up & down, "both").when(up, "upstream").otherwise("downstream").alias("missing_end"),
    )


def payload_checks(
    payload: DataFrame,
    known_types: Sequence[str],
    sources: DataFrame,
    registry: DataFrame,
    key: str = "key",
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rejected rows, one per reason: unknown type, data source or parent.

    `payload` has (key, type, data_source, parent); `sources` and `registry` have key.
    A null parent means the row names none; a null source or type is rejected.
    """
    bad_source = settle(unregistered_keys(payload, ["data_source"], sources))
    bad_parent = settle(unregistered_keys(payload, ["parent"], registry))
    flagged = flag_listed(
        payload,
        {"_bad_source": ("data_source", bad_source), "_bad_parent": ("parent", bad_parent)},
        max_rows=max_rows,
        hot_rows=hot_rows,
    )
    return _reasons(
        flagged,
        key,
        unknown_type=~F.coalesce(F.col("type").isin(list(known_types)), F.lit(False)),
        unknown_data_source=F.col("_bad_source") | F.col("data_source").isNull(),
        unknown_parent=F.col("_bad_parent"),
    )


def _reasons(df: DataFrame, key: str, **tests: Column) -> DataFrame:
    found = F.array(*[F.when(test, name) for name, test in tests.items()])
    return df.select(F.col(key), F.explode(found).alias("reason")).where(
        F.col("reason").isNotNull()
    )
