"""Tables that are kept by batches, against the same figures computed anew."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators import catalog, keyed_table, latest
from gaugeworks.operators.keyed_table import KeyedTable
from gaugeworks.operators.kpi_deltas import KpiState
from gaugeworks.operators.profiling import column_profile
from gaugeworks.operators.stored_profile import merged_profile, profile_batch
from gaugeworks.operators.stored_versions import VersionHistory

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
T0 = datetime(2024, 1, 1)
LOG = T.StructType([
    *[T.StructField(name, T.StringType()) for name in ("urn", "aspect", "value")],
    T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
])


def log_rows(n, seed, keys=7, start=0):
    rng = random.Random(seed)
    return [
        (f"u{rng.randrange(keys)}", f"a{rng.randrange(2)}", f"v{start + i}", T0 + timedelta(minutes=(start + i) // 3), start + i)
        for i in range(n)
    ]


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


# Latest rows by key bucket


def test_an_upsert_rewrites_its_own_buckets_only(spark, tmp_path):
    kept = KeyedTable(str(tmp_path / "t"), ("urn", "aspect"), LOG, buckets=32)
    assert kept.read(spark).isEmpty()
    rows = [(f"u{i}", "a", "old", T0, i) for i in range(400)]
    assert len(kept.upsert(spark.createDataFrame(rows, LOG))) == 32
    before = files_of(tmp_path / "t")
    writes = [("u3", "a", "new", T0, 1000), ("u4", "a", "stale", T0 - timedelta(1), 2000), ("new", "a", "x", T0, 1)]
    touched = kept.upsert(spark.createDataFrame(writes, LOG))
    assert 1 <= len(touched) <= 3
    after = files_of(tmp_path / "t")
    same = {name for name in before if before[name] == after.get(name)}
    assert {name.split("/")[0] for name in set(before) - same} == {f"key_bucket={b}" for b in touched if b in {
        int(name.split("=")[1].split("/")[0]) for name in before}}
    found = {r["urn"]: r["value"] for r in kept.read(spark).collect()}
    assert found == {f"u{i}": "old" for i in range(400)} | {"u3": "new", "new": "x"}
    kept.upsert(spark.createDataFrame(writes, LOG))
    assert {r["urn"]: r["value"] for r in kept.read(spark).collect()} == found
    assert kept.upsert(spark.createDataFrame([], LOG)) == []
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(kept.path, kept.keys, LOG, buckets=31).upsert(spark.createDataFrame(rows, LOG))


def test_a_bucket_read_is_pruned(spark, tmp_path):
    kept = KeyedTable(str(tmp_path / "t"), ("urn",), LOG, buckets=8)
    kept.upsert(spark.createDataFrame(log_rows(100, 1, keys=50), LOG))
    plan = kept.read(spark, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({keyed_table.BUCKET}" in plan or f"{keyed_table.BUCKET}#" in plan.split("PartitionFilters")[1][:80]


def test_null_keys_and_hot_keys_upsert(spark, tmp_path):
    kept = KeyedTable(str(tmp_path / "t"), ("urn", "aspect"), LOG, buckets=4)
    rows = [("hot", "a", f"v{i}", T0, i) for i in range(500)] + [(None, "a", "n", T0, 1), (None, "a", "m", T0, 2)]
    kept.upsert(spark.createDataFrame(rows, LOG))
    assert {(r["urn"], r["value"]) for r in kept.read(spark).collect()} == {("hot", "v499"), (None, "m")}


# Versions


def versions(df):
    return sorted((r["urn"], r["aspect"], r["version"], r["value"]) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"slice_rows": 5, "max_rows": 0, "hot_rows": 3}])
def test_batches_append_and_rewrite_nothing(spark, tmp_path, sizes):
    history = VersionHistory(str(tmp_path / "v"), LOG, **sizes)
    assert history.read(spark).isEmpty()
    parts = [log_rows(40, 1), log_rows(30, 2, start=40), log_rows(5, 3, keys=2, start=70)]
    stored, everything = {}, []
    for i, rows in enumerate(parts):
        assert history.append(spark.createDataFrame(rows, LOG), i) == 0
        now = files_of(tmp_path / "v")
        assert stored.items() <= now.items()
        stored, everything = now, everything + rows
    want = versions(latest.aspect_versions(spark.createDataFrame(everything, LOG)))
    assert versions(history.read(spark)) == want
    counted = spark.read.parquet(f"{tmp_path}/v/counts/batch=2")
    assert counted.count() == len({r[:2] for r in parts[2]})  # its own keys only
    history.append(spark.createDataFrame(parts[2], LOG), 2)
    assert versions(history.read(spark)) == want
    with pytest.raises(ValueError, match="comes after"):
        history.append(spark.createDataFrame(parts[0], LOG), 1)


def test_late_rows_rank_their_keys_anew(spark, tmp_path):
    rows = log_rows(60, 4)
    late, rest = rows[10::7], [r for i, r in enumerate(rows) if not (i >= 10 and (i - 10) % 7 == 0)]
    history = VersionHistory(str(tmp_path / "v"), LOG)
    history.append(spark.createDataFrame(rest, LOG), 1)
    stored = files_of(tmp_path / "v")
    assert history.append(spark.createDataFrame(late, LOG), 2) > 0
    assert stored.items() <= files_of(tmp_path / "v").items()
    assert versions(history.read(spark)) == versions(latest.aspect_versions(spark.createDataFrame(rows, LOG)))
    more = log_rows(20, 5, start=60)
    history.append(spark.createDataFrame(more, LOG), 3)
    assert versions(history.read(spark)) == versions(latest.aspect_versions(spark.createDataFrame(rows + more, LOG)))


def test_rows_without_their_counts_are_not_seen(spark, tmp_path):
    history = VersionHistory(str(tmp_path / "v"), LOG)
    history.append(spark.createDataFrame(log_rows(20, 6), LOG), 1)
    want = versions(history.read(spark))
    history.append(spark.createDataFrame(log_rows(9, 7, start=20), LOG), 2)
    counts = tmp_path / "v" / "counts" / "batch=2"
    for p in counts.glob("*.parquet"):
        p.rename(p.with_name(f"_{p.name}"))  # as if the second write had not ended
    assert versions(history.read(spark)) == want


# Profiles


def table_of(spark, n, start=0):
    rng = random.Random(start)
    rows = [
        (start + i, rng.gauss(10, 3) if i % 9 else None, ("", "x", None, f"t{rng.randrange(300)}")[i % 4],
         T0 + timedelta(hours=rng.randrange(999)), i % 2 == 0, [1])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, d double, s string, t timestamp, b boolean, l array<int>")


def test_merged_profile_is_near_the_exact_one(spark, tmp_path):
    parts = [table_of(spark, 6000), table_of(spark, 60, 6000)]
    path = str(tmp_path / "p")
    for i, part in enumerate(parts):
        profile_batch(part, path, str(i))
    before = files_of(tmp_path / "p")
    whole = parts[0].unionByName(parts[1])
    exact = {r["column"]: r for r in column_profile(whole, "t").collect()}
    got = {r["column"]: r for r in merged_profile(spark, path, whole.schema, "t").collect()}
    assert got.keys() == exact.keys()
    d = sorted(r["d"] for r in whole.select("d").collect() if r["d"] is not None)
    for name, row in exact.items():
        for figure in ("values_count", "null_count", "missing_count", "null_proportion", "min", "max"):
            assert got[name][figure] == row[figure], (name, figure)
        assert got[name]["unique_count"] == pytest.approx(row["unique_count"], rel=0.03)
        assert got[name]["mean"] == pytest.approx(row["mean"])
    assert abs(sum(v <= got["d"]["median"] for v in d) / len(d) - 0.5) < 0.01
    assert abs(got["id"]["median"] - exact["id"]["median"]) < 0.01 * 6060
    profile_batch(parts[1], path, "1")  # again: the other batch's file stays, the figures too
    assert [n for n in before if n.startswith("batch=0")] == [n for n in files_of(tmp_path / "p") if n.startswith("batch=0")]
    assert {r["column"]: r["values_count"] for r in merged_profile(spark, path, whole.schema, "t").collect()}["id"] == 6060


def test_appending_reads_the_batch_only(spark, tmp_path):
    for part in (0, 1):
        spark.range(part * 100, part * 100 + (99, 1)[part]).write.parquet(f"{tmp_path}/t/part={part}")
    new = spark.read.parquet(f"{tmp_path}/t/part=1")
    profile_batch(new, f"{tmp_path}/p", "1")
    plan = merged_profile(spark, f"{tmp_path}/p", new.schema, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and f"{tmp_path}/p" in plan and f"{tmp_path}/t" not in plan


def test_profile_of_no_rows(spark, tmp_path):
    none = table_of(spark, 3).limit(0)
    profile_batch(none, f"{tmp_path}/p", "0")
    got = {r["column"]: r for r in merged_profile(spark, f"{tmp_path}/p", none.schema, "t").collect()}
    assert (got["d"]["values_count"], got["d"]["unique_count"], got["d"]["median"], got["d"]["mean"]) == (0, 0, None, None)
    assert got["s"]["null_proportion"] is None


# Governance figures

ENTITY = "key string, type string, owner string, tier string, description string, sign int"
EDGE = "upstream string, downstream string, sign int"
RESULT = "status string, sign int"


def kpi_rows(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"max_rows": 0, "hot_rows": 1, "buckets": 3}])
def test_kpis_after_inserts_updates_and_deletes(spark, tmp_path, sizes):
    rng = random.Random(9)
    state = KpiState(str(tmp_path / "k"), **sizes)
    entities, edges, results = {}, [], []

    def entity(key):
        return (key, rng.choice(["table", "job", None]), *(rng.choice([None, "x", "y"]) for _ in range(3)))

    for batch in range(1, 5):
        changed = []
        for key in [f"e{rng.randrange(20)}" for _ in range(9)]:
            if key in entities:
                changed.append((*entities.pop(key), -1))
            if rng.random() < 0.7:
                entities[key] = entity(key)
                changed.append((*entities[key], 1))
        gone = [edges.pop(rng.randrange(len(edges))) for _ in range(min(4, len(edges)))]
        came = [(f"e{rng.randrange(25)}", rng.choice([None, f"e{rng.randrange(25)}"])) for _ in range(7)]
        edges += came
        ran = [rng.choice(["SUCCESS", "FAILED", None]) for _ in range(5)]
        lost = [results.pop() for _ in range(min(2, len(results)))]
        results += ran

        def apply():
            state.apply(
                spark, batch, spark.createDataFrame(changed, ENTITY),
                spark.createDataFrame([(*e, -1) for e in gone] + [(*e, 1) for e in came], EDGE),
                spark.createDataFrame([(s, 1) for s in ran] + [(s, -1) for s in lost], RESULT),
            )

        apply()
        want = kpi_rows(catalog.governance_kpis(
            spark.createDataFrame(list(entities.values()), ENTITY.rpartition(",")[0]),
            spark.createDataFrame(edges, EDGE.rpartition(",")[0]),
            spark.createDataFrame([(s,) for s in results], "status string"),
        ))
        assert kpi_rows(state.kpis(spark)) == want
        if batch in (2, 4):
            apply()
            assert kpi_rows(state.kpis(spark)) == want
    with pytest.raises(ValueError, match="comes after"):
        state.apply(spark, 2)


def test_a_dropped_tier_and_the_last_edge(spark, tmp_path):
    state = KpiState(str(tmp_path / "k"))
    rows = [("a", "table", "o", "Tier1", None, 1), ("b", "table", None, None, "d", 1)]
    state.apply(spark, 1, spark.createDataFrame(rows, ENTITY), spark.createDataFrame([("a", "x", 1), ("a", "b", 1)], EDGE))

    def figures():
        row = state.kpis(spark).where("type = 'ALL'").first()
        return row["assets"], row["tier_share"], row["lineage_share"], row["dq_pass_rate"]

    assert figures() == (2, 0.5, 1.0, None)
    state.apply(spark, 2, edges=spark.createDataFrame([("a", "b", -1)], EDGE))
    assert figures() == (2, 0.5, 0.5, None)
    dropped = [("a", "table", "o", "Tier1", None, -1), ("a", "table", "o", None, None, 1)]
    state.apply(spark, 3, spark.createDataFrame(dropped, ENTITY), results=spark.createDataFrame([("SUCCESS", 1)], RESULT))
    assert figures() == (2, 0.0, 0.5, 1.0)
    state.apply(spark, 4, spark.createDataFrame([("b", "table", None, None, "d", -1)], ENTITY), spark.createDataFrame([("a", "x", -1)], EDGE))
    assert figures() == (1, 0.0, 0.0, 1.0)


def test_many_changes_are_summed_without_choosing_keys(spark, tmp_path, monkeypatch):
    """Neither hot keys are sought nor keys joined; a bucket with many rows is cut over tasks."""
    monkeypatch.setattr("gaugeworks.operators.joins.hot_buckets", lambda *_: pytest.fail("keys counted"))
    monkeypatch.setattr("gaugeworks.operators.kpi_deltas.sized_join", lambda *_, **__: pytest.fail("keys chosen"))
    kept = {name: spark.conf.get(name) for name in (ADVISORY, COALESCE)}
    spark.conf.set(ADVISORY, "1k")
    spark.conf.set(COALESCE, "false")
    try:
        state = KpiState(str(tmp_path / "k"), buckets=1, max_rows=10)
        rows = [(f"e{i}", "table", None, None, None, 1) for i in range(2000)]
        edges = spark.createDataFrame([(f"e{i}", f"x{i}", 1) for i in range(500)], EDGE)
        state.apply(spark, 1, spark.createDataFrame(rows, ENTITY), edges)
        assert len(list((tmp_path / "k/entities/batch=1/key_bucket=0").glob("*.parquet"))) > 1
        state.apply(spark, 2, edges=edges.where("upstream < 'e3'").withColumn("sign", F.lit(-1)))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    lost = sum(f"e{i}" < "e3" for i in range(500))
    row = state.kpis(spark).where("type = 'ALL'").first()
    assert (row["assets"], row["lineage_share"]) == (2000, (500 - lost) / 2000)
