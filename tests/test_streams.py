from datetime import datetime, timedelta

import pytest

from gaugeworks.operators.joins import sized_join
from gaugeworks.streaming import changes

T0 = datetime(2024, 1, 1)
LOG = "urn string, aspect string, value string, ts timestamp, seq long"


def write_files(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in{i}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")


@pytest.mark.parametrize("sizes", [{}, {"max_rows": 0}, {"max_rows": 0, "hot_rows": 2}])
def test_alerts_equal_the_batch_result_on_all_join_ways(spark, tmp_path, sizes):
    schema = "entity string, status string, run_id long"
    rows = [[(f"e{i % 5}", "FAILED" if i % 3 else "SUCCESS", i) for i in range(s, s + 20)] for s in (0, 20)]
    write_files(spark, tmp_path, rows, schema)
    tiers = spark.createDataFrame(
        [("e1", "Tier1"), ("e1", "Tier1"), ("e2", "Tier1"), ("e3", "Tier2")], "entity string, tier string")
    out, source = str(tmp_path / "out"), stream(spark, tmp_path, schema)
    assert changes.read_batches(spark, out, source.schema).isEmpty()
    changes.run_alerts_to_files(source, tiers, out, str(tmp_path / "progress"), **sizes).awaitTermination()
    got = sorted(r.run_id for r in changes.read_batches(spark, out, source.schema).collect())
    assert got == [i for i in range(40) if i % 5 in (1, 2) and i % 3]


def test_state_over_several_batches_and_after_a_restart(spark, tmp_path):
    rows = [
        [("a", "x", "1", T0, 1), ("b", "x", "2", T0 + timedelta(days=9), 2)],
        [("a", "x", "3", T0 + timedelta(days=1), 3), ("b", "x", "late", T0, 4)],
    ]
    write_files(spark, tmp_path, rows, LOG)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        state = changes.latest_state(stream(spark, tmp_path, LOG))
        query = changes.run_state_to_files(state, out, progress)
        query.awaitTermination()
        used = query.lastProgress["stateOperators"][0]["customMetrics"]
        assert any(name.startswith("rocksdb") for name in used)
        assert spark.conf.get(changes._STATE_STORE, None) is None
        found = changes.read_state(spark, out, state.schema).collect()
        return {r.urn: (r.value, r.seq) for r in found}

    state_schema = changes.latest_state(spark.createDataFrame([], LOG)).schema
    assert changes.read_state(spark, out, state_schema).isEmpty()
    assert run() == {"a": ("3", 3), "b": ("2", 2)}
    spark.createDataFrame([("a", "x", "9", T0 + timedelta(days=2), 9)], LOG).coalesce(1).write.parquet(
        str(tmp_path / "in9"))
    assert run() == {"a": ("9", 9), "b": ("2", 2)}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [[(f"k{i % 3}", "x", str(i), T0 + timedelta(days=i), i)] for i in range(5)]
    write_files(spark, tmp_path, rows, LOG)
    out = str(tmp_path / "out")
    state = changes.latest_state(stream(spark, tmp_path, LOG))
    changes.run_state_to_files(state, out, str(tmp_path / "p")).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"batch={i}" for i in range(5)]

    def found():
        return {r.urn: r.value for r in changes.read_state(spark, out, state.schema).collect()}

    assert found() == {"k0": "3", "k1": "4", "k2": "2"}
    again = spark.read.schema(state.schema).parquet(f"{out}/batch=3").collect()
    repeat = spark.createDataFrame(again, state.schema)
    (tmp_path / "out" / "batch=3" / "part-left-over.parquet").write_bytes(b"half a file")
    changes._batch_writer(out)(repeat, 3)
    assert found() == {"k0": "3", "k1": "4", "k2": "2"}


def test_replay_of_the_change_log_rebuilds_the_state(spark, tmp_path):
    """A stream that ends midway, goes on, and is then rebuilt elsewhere from the log alone."""
    rows = [[(f"k{(i * j) % 4}", f"x{j % 2}", f"{i}.{j}", T0 + timedelta(days=(i * 7 + j) % 11), 10 * i + j)
             for j in range(6)] for i in range(4)]
    write_files(spark, tmp_path, rows[:2], LOG)
    out, progress = str(tmp_path / "out"), str(tmp_path / "p")
    source = stream(spark, tmp_path, LOG)
    schema = changes.latest_state(source).schema

    def run(out, progress):
        changes.run_state_to_files(changes.latest_state(source), out, progress).awaitTermination()
        return sorted(changes.read_state(spark, out, schema).collect())

    run(out, progress)
    for i in (2, 3):
        spark.createDataFrame(rows[i], LOG).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    continued = run(out, progress)
    assert run(f"{tmp_path}/new", f"{tmp_path}/new-p") == continued
    log = spark.createDataFrame([r for part in rows for r in part], LOG)
    assert sorted(changes.latest_state(log).collect()) == continued


def test_streams_are_joined_per_batch(spark, tmp_path):
    write_files(spark, tmp_path, [[("e", 1)]], "entity string, x int")
    tiers = spark.createDataFrame([("e", "Tier1")], "entity string, tier string")
    with pytest.raises(ValueError, match="micro-batch"):
        sized_join(stream(spark, tmp_path, "entity string, x int"), tiers, ["entity"])
