import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import catalog, search_index as S


def scan_metrics(df):
    """Run a query without adaptive planning; rows out of each scan, and its plan."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves, rows = plan.collectLeaves(), []
    for i in range(leaves.size()):
        rows.append(leaves.apply(i).metrics().apply("numOutputRows").value())
    return rows, plan.toString()


def test_lookup_equals_scan(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(9)]
    rows = [(i * 977, "The " + " ".join(rng.choices(words, k=5)) + (f" and-rare{i % 40}" if i % 3 == 0 else "")) for i in range(900)]
    rows += [(-5, "The w3/w5 and"), (2**40, "rare7 the"), (None, "the rare7"), (77, None), (78, "")]
    df = spark.createDataFrame(rows, "id long, body string")
    path = str(tmp_path)
    parts = {"a": df.where("id % 2 = 0 OR id IS NULL"), "b": df.where("id % 2 <> 0")}
    for batch in ("a", "b", "a"):
        S.add_to_keyword_index(parts[batch], path, batch, "id", "body")
    for query in ("the", "the rare7", "rare7 rare8", "The, w3 AND w5", "absent the", "w1 w2 w3"):
        got = sorted(r["key"] for r in S.keyword_lookup(spark, path, query).collect())
        want = sorted(r["id"] for r in catalog.keyword_search(df.where("id IS NOT NULL"), "body", query).collect())
        assert got == want and len(got) == len(set(got))


def test_a_lookup_reads_its_own_words_only(spark, tmp_path):
    texts = spark.range(30_000).selectExpr("id", "concat_ws(' ', 'common', 'x' || (id % 5000), 'y' || (id % 7)) AS t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge such small files
    try:
        S.add_to_keyword_index(texts, str(tmp_path), "0", "id", "t")
        total = spark.read.parquet(f"{tmp_path}/postings").count()
        found = S.keyword_lookup(spark, str(tmp_path), "common x17")
        assert sorted(r["key"] for r in found.collect()) == list(range(17, 30_000, 5000))
        rows, plan = scan_metrics(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,common)" in plan and "EqualTo(word,x17)" in plan
    assert sum(rows) < total
    files = list((tmp_path / "postings").rglob("*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(2)
    assert column.path_in_schema.startswith("ids") and "DELTA_BINARY_PACKED" in column.encodings
    with pytest.raises(ValueError, match="no word"):
        S.keyword_lookup(spark, str(tmp_path), " ,. ")


def entities_of(spark):
    rng = random.Random(4)
    rows = [
        (f"k{i}", rng.choice(["table", "job", "view", None]), rng.choice([1, 2, 3, None]),
         rng.choice([None, [], ["a"], ["a", "b", "a"], ["b", None]]), rng.choice(["sales_x", "sales", "hr", None, "Sales"]))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "key string, type string, size int, tags array<string>, name string").repartition(5)


@pytest.mark.parametrize("facets, prefix", [
    ({}, None), ({"type": ["table", "job"]}, None), ({"tags": ["b"], "size": ["1", "3"]}, None),
    ({"tags": ["a", "b"]}, "sal"), ({}, "sales_"), ({"type": ["none"]}, None),
])
def test_bitmaps_equal_the_scan(spark, tmp_path, facets, prefix):
    entities = entities_of(spark)
    path, names = str(tmp_path), ["type", "size", "tags"]
    S.write_facet_index(entities, path, names, name="name")
    found = S.facet_lookup(spark, path, facets, prefix)
    got = {tuple(r) for r in S.indexed_facet_counts(spark, path, found, names).collect()}
    kept = catalog.facet_filter(entities, {k: v if k != "size" else list(map(int, v)) for k, v in facets.items()}, prefix)
    want = {(r["facet"], r["value"], r["entities"]) for r in catalog.facet_counts(kept.withColumn("size", F.col("size").cast("string")), names).collect()}
    assert got == want
    if found is not None:
        keys = sorted(r["key"] for r in S.indexed_keys(spark, path, found).collect())
        assert keys == sorted(r["key"] for r in kept.collect())


def test_counts_read_no_entity_rows(spark, tmp_path):
    entities_of(spark).write.parquet(f"{tmp_path}/entities")
    path = f"{tmp_path}/index"
    S.write_facet_index(spark.read.parquet(f"{tmp_path}/entities"), path, ["type", "tags"], name="name")
    found = S.facet_lookup(spark, path, {"type": ["job"]}, "sales")
    counts = S.indexed_facet_counts(spark, path, found, ["tags"])
    assert {re.search(r"index/(\w+)/|entities", name)[1] for name in counts.inputFiles()} == {"bitmaps", "names"}
    assert "StringStartsWith(name,sales)" in counts._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "key long, type string, t string")
    S.add_to_keyword_index(none, f"{tmp_path}/k", "0", "key", "t")
    assert S.keyword_lookup(spark, f"{tmp_path}/k", "word").isEmpty()
    S.write_facet_index(none, f"{tmp_path}/f", ["type"])
    assert S.indexed_facet_counts(spark, f"{tmp_path}/f", None, ["type"]).isEmpty()
