import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import keys
from gaugeworks.operators import catalog, joins, lineage

T0 = datetime(2024, 1, 1)


def pairs(df, *columns):
    return sorted(tuple(row[c] for c in columns) for row in df.collect())


def test_identity_strings(spark):
    row = spark.range(1).select(
        keys.dataset_urn("inst", F.lit("tmp.t")).alias("urn"),
        keys.job_urn("inst", F.lit("flow"), F.lit("job")).alias("job"),
        keys.path_name(F.lit("/tmp/t")).alias("path"),
        keys.dotted_name(F.lit("a"), F.lit("b")).alias("dotted"),
        keys.dotted_name(F.lit("a"), F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row.urn == "urn:li:dataset:(urn:li:dataPlatform:file,inst.tmp.t,PROD)"
    assert row.job == "urn:li:dataJob:(urn:li:dataFlow:(spark,inst.flow,PROD),job)"
    assert row.path == "//file/host/local/path/tmp/t"
    assert row.dotted == "a.b" and row.none is None


def test_aspect_value_is_json_text_inside_json(spark):
    df = spark.createDataFrame([("u", 'say "hi"', 3)], "urn string, note string, n int")
    aspect = F.struct("note", "n")
    record = keys.aspect_encode(F.lit("dataset"), F.col("urn"), F.lit("notes"), aspect)
    text = df.select(record.alias("r")).first().r
    outer = json.loads(text)
    assert outer["changeType"] == "UPSERT" and outer["aspect"]["contentType"] == "application/json"
    assert isinstance(outer["aspect"]["value"], str)
    assert json.loads(outer["aspect"]["value"]) == {"note": 'say "hi"', "n": 3}
    schema = df.select(aspect.alias("a")).schema["a"].dataType
    back = keys.aspect_decode(df.select(record.alias("r")), "r", schema).first()
    assert (back.urn, back.aspect_name, back.aspect.note, back.aspect.n) == ("u", "notes", 'say "hi"', 3)


def test_schema_catalog_observes_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), (None, None, 2)], "s string, d double, i long")
    assert pairs(catalog.schema_catalog(df, "t"), "position", "name", "catalog_type", "has_nulls") == [
        (1, "s", "TYPE_STRING", True), (2, "d", "TYPE_NUMBER", True), (3, "i", "TYPE_INTEGER", False)]
    assert not any(r.has_nulls for r in catalog.schema_catalog(df.limit(0), "t").collect())


def test_governance_replaces_field_by_field_also_on_columns(spark):
    entities = spark.createDataFrame([("t", "c1", "old"), ("t", "c2", "old")], "key string, name string, owner string")
    changes = spark.createDataFrame(
        [("t", "c1", "me", None, T0, 1), ("t", "c1", None, "Tier1", T0, 2), ("t", "c1", "you", None, T0, 0)],
        "key string, name string, owner string, tier string, ts timestamp, seq long")
    got = catalog.governance_attach(entities, changes, ("key", "name"), ("owner", "tier"))
    assert pairs(got, "name", "owner", "tier") == [("c1", "me", "Tier1"), ("c2", "old", None)]


def test_lookup_takes_either_name_first_hit_and_reports_misses(spark):
    entities = spark.createDataFrame(
        [("e3", "x", "y"), ("e1", "y", None), ("e2", "x", "x")],
        "key string, external_name string, internal_name string")
    names = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "name string")
    got = catalog.entity_lookup(names, entities)
    assert sorted(map(tuple, got.collect()), key=str) == [("x", "e2"), ("y", "e1"), ("z", None)]


def test_kpis(spark):
    entities = spark.createDataFrame(
        [("a", "table", "o", "Tier1", "d"), ("b", "table", None, None, "d"), ("c", "job", None, None, None)],
        "key string, type string, owner string, tier string, description string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "upstream string, downstream string")
    results = spark.createDataFrame([("SUCCESS",), ("FAILED",)], "status string")
    got = {r.type: r for r in catalog.governance_kpis(entities, edges, results).collect()}
    assert (got["table"].assets, got["table"].owner_share, got["table"].lineage_share) == (2, 0.5, 1.0)
    assert (got["job"].description_share, got["job"].dq_pass_rate) == (0.0, None)
    assert got["ALL"].assets == 3 and got["ALL"].dq_pass_rate == 0.5


def test_facets_with_plain_and_array_columns(spark):
    df = spark.createDataFrame(
        [("sales", "t", ["x", "y"]), ("sales_2", "t", ["y", "y"]), ("ops", "j", None)],
        "name string, type string, tags array<string>")
    assert pairs(catalog.facet_filter(df, {"tags": ["x"]}), "name") == [("sales",)]
    assert pairs(catalog.facet_filter(df, {"type": ["t"]}, prefix="sales_"), "name") == [("sales_2",)]
    assert pairs(catalog.facet_counts(df, ["type", "tags"]), "facet", "value", "entities") == [
        ("tags", "x", 1), ("tags", "y", 2), ("type", "j", 1), ("type", "t", 2)]


def test_keywords_are_whole_words(spark):
    df = spark.createDataFrame(
        [(1, "The sensor-zone"), (2, "sensors of the zone"), (3, "ZONE\nthe SENSOR 7"), (4, None),
         (5, "sensoré zone the")], "id int, t string")
    assert pairs(catalog.keyword_search(df, "t", "Sensor, ZONE!"), "id") == [(1,), (3,), (5,)]
    with pytest.raises(ValueError):
        catalog.keyword_search(df, "t", " ?")


def test_orphans_and_payload_checks(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("a", "x"), ("y", "b"), ("y", "x"), (None, "b")], "upstream string, downstream string")
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    got = catalog.orphan_edges(edges, known)
    assert pairs(got, "upstream", "downstream", "missing_end") == [
        ("a", "x", "downstream"), ("y", "b", "upstream"), ("y", "x", "both")]
    payload = spark.createDataFrame(
        [("1", "TABLE", "s", None), ("2", "NOVELTY", "s", "a"), ("3", "TABLE", "q", "zz"), ("4", None, None, "b")],
        "key string, type string, data_source string, parent string")
    sources = spark.createDataFrame([("s",)], "key string")
    got = catalog.payload_checks(payload, ["TABLE"], sources, known)
    assert pairs(got, "key", "reason") == [
        ("2", "unknown_type"), ("3", "unknown_data_source"), ("3", "unknown_parent"),
        ("4", "unknown_data_source"), ("4", "unknown_type")]


EDGES = [("raw", "profiles"), ("profiles", "enriched"), ("lookup", "enriched"),
         ("enriched", "board"), ("board", "raw"), ("raw", "enriched"), ("other", None)]


@pytest.mark.parametrize("filter_keys, max_rows, hot_rows", [(9, 99, 99), (0, 99, 99), (0, 0, 1)])
def test_walk_with_cycle_and_shortcut(spark, monkeypatch, filter_keys, max_rows, hot_rows):
    monkeypatch.setattr(lineage, "FILTER_KEYS", filter_keys)
    edges = spark.createDataFrame(EDGES, "upstream string, downstream string")
    sizes = {"max_rows": max_rows, "hot_rows": hot_rows}
    down = lineage.lineage_walk(edges, "raw", "downstream", **sizes)
    assert pairs(down, "entity", "hops") == [("board", 2), ("enriched", 1), ("profiles", 1)]
    up = lineage.lineage_walk(edges, "profiles", "upstream", **sizes)
    assert pairs(up, "entity", "hops") == [
        ("board", 2), ("enriched", 3), ("lookup", 4), ("raw", 1)]
    assert lineage.lineage_walk(edges, "nowhere", "upstream", **sizes).isEmpty()


def test_filters_on_clustered_edges_skip_files(spark):
    edges = spark.range(2000).selectExpr(
        "lpad(id % 100, 3, '0') AS upstream", "CAST(id % 1000 AS STRING) AS downstream")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge such small files
    try:
        stored = lineage.clustered_edges(edges, "upstream")
        assert stored.count() == 1000 and len(stored.inputFiles()) > 1
        wanted = stored.where(F.col("upstream").isin(["007"])).select("downstream")
        assert len(wanted.collect()) == 10
        scan = wanted._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("sizes", [{}, {"max_rows": 0}, {"max_rows": 0, "hot_rows": 1}])
def test_checks_count_hot_keys_before_joining(spark, monkeypatch, sizes):
    counted = []
    count = joins.hot_buckets_of_each
    monkeypatch.setattr(
        joins, "hot_buckets_of_each", lambda df, *a: (counted.append(df), count(df, *a))[1])
    edges = spark.createDataFrame(
        [("a", "b"), ("a", "x"), ("y", "b"), ("y", "x"), ("y", "x")], "upstream string, downstream string")
    known = spark.createDataFrame([("a",), ("b",)], "key string")
    got = catalog.orphan_edges(edges, known, **sizes)
    assert pairs(got, "upstream", "downstream", "missing_end") == [
        ("a", "x", "downstream"), ("y", "b", "upstream"), ("y", "x", "both"), ("y", "x", "both")]
    assert len(counted) == (1 if sizes else 0)
    for df in counted:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_walk_too_deep_raises(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "upstream string, downstream string")
    with pytest.raises(ValueError, match="deeper than 3"):
        lineage.lineage_walk(chain, "0", "downstream", max_hops=3)


def test_edges_from_inputs_jobs_and_mappings(spark):
    inputs = spark.createDataFrame(
        [("enriched", ["profiles", "lookup"], T0, "me"), ("raw", [], T0, "me")],
        "downstream string, inputs array<string>, ts timestamp, actor string")
    assert pairs(lineage.lineage_edges(inputs), "upstream", "downstream", "type") == [
        ("lookup", "enriched", "TRANSFORMED"), ("profiles", "enriched", "TRANSFORMED")]
    typed = inputs.withColumns({"type": F.lit(lineage.COPY), "job": F.lit("j")})
    assert pairs(lineage.lineage_edges(typed), "upstream", "type", "job", "description") == [
        ("lookup", "COPY", "j", None), ("profiles", "COPY", "j", None)]
    jobs = spark.createDataFrame(
        [("j2", ["p", "z"], ["e"], ["j1"]), ("j1", ["r"], ["p"], None)],
        "job string, input_datasets array<string>, output_datasets array<string>, input_jobs array<string>")
    assert pairs(lineage.job_io_edges(jobs), "upstream", "downstream", "type") == [
        ("j1", "j2", "after"), ("j1", "p", "produces"), ("j2", "e", "produces"),
        ("p", "j2", "consumes"), ("r", "j1", "consumes"), ("z", "j2", "consumes")]
    mappings = spark.createDataFrame(
        [("r", "p", ["m1", "m2"], ["a"], "AVG"), ("q", "p", ["m"], ["a"], "AVG")],
        "upstream string, downstream string, upstream_fields array<string>, downstream_fields array<string>, operation string")
    edges = spark.createDataFrame([("r", "p"), ("r", "p")], "upstream string, downstream string")
    assert pairs(lineage.column_lineage(mappings, edges), "upstream_column", "downstream_column") == [
        ("m1", "a"), ("m2", "a")]
    assert lineage.column_lineage(mappings).count() == 3
