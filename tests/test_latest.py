import random
from datetime import datetime, timedelta

import pytest

from gaugeworks.operators import latest
from gaugeworks.operators.latest import (
    aspect_versions, editorial_overlay, entity_page, upsert_latest,
)

LOG = "urn string, aspect string, value string, ts timestamp, seq long"
T0 = datetime(2024, 1, 1)


def expected_versions(rows):
    out = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    for members in groups.values():
        members.sort(key=lambda r: (r[3] is not None, r[3] or T0, r[4]), reverse=True)
        out.update({row[4]: i for i, row in enumerate(members)})
    return out


def skewed_rows(n, times):
    rnd = random.Random(5)
    rows = []
    for seq in range(n):
        hot = rnd.random() < 0.5
        urn = "hot" if hot else rnd.choice(["a", "b", None, "d"])
        rows.append((urn, rnd.choice(["x", "y"]) if not hot else "x", f"v{seq}", times(rnd), seq))
    rnd.shuffle(rows)
    return rows


SPREAD = lambda rnd: T0 + timedelta(seconds=rnd.randrange(86_400))
TIES = lambda rnd: T0 + timedelta(days=rnd.randrange(2))
ONE = lambda rnd: T0
BUNCHED = lambda rnd: (
    datetime(1970, 1, 1) if rnd.random() < 0.01 else T0 + timedelta(milliseconds=rnd.randrange(500))
)
SOME_NULL = lambda rnd: None if rnd.random() < 0.3 else T0 + timedelta(days=rnd.randrange(3))


@pytest.mark.parametrize("times", [SPREAD, TIES, ONE, BUNCHED, SOME_NULL])
@pytest.mark.parametrize("slice_rows", [20, 1_000_000])
def test_versions_match_brute_force_with_hot_keys(spark, times, slice_rows):
    rows = skewed_rows(600, times)
    df = spark.createDataFrame(rows, LOG)
    got = aspect_versions(df, slice_rows=slice_rows)
    assert got.columns == df.columns + ["version"]
    assert {r.seq: r.version for r in got.collect()} == expected_versions(rows)


def test_hot_slices_get_small(spark):
    df = spark.createDataFrame(skewed_rows(2000, BUNCHED), LOG)
    sliced, path = latest._slice_hot_keys(df, ["urn", "aspect"], "ts", "seq", 50)
    assert len(path) > 1  # one stray old row makes the first cut useless
    assert max(r["count"] for r in sliced.groupBy("urn", "aspect", *path).count().collect()) <= 50


def test_upsert_last_write_wins_and_repeats_change_nothing(spark):
    current = spark.createDataFrame([("a", "x", "old", T0, 1), ("b", "x", "kept", T0, 2)], LOG)
    writes = spark.createDataFrame(
        [("a", "x", "new", T0, 3), ("c", "x", "first", T0, 4),
         ("b", "x", "late", T0 - timedelta(days=1), 9)], LOG)
    once = upsert_latest(current, writes, ["urn", "aspect"])
    assert {r.urn: r.value for r in once.collect()} == {"a": "new", "b": "kept", "c": "first"}
    twice = upsert_latest(once, writes, ["urn", "aspect"])
    assert sorted(twice.collect()) == sorted(once.collect())


def test_upsert_merges_keys_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "x", "v", T0, 1)], LOG)
    once = upsert_latest(df, df, ["urn", "aspect"])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and plan.count("Exchange") == 1
    assert once.columns == df.columns


def test_entity_page_takes_newest_of_named_aspects(spark):
    log = spark.createDataFrame(
        [("a", "x", "1", T0, 1), ("a", "x", "2", T0, 2), ("a", "z", "no", T0, 3),
         ("b", "y", "3", T0, 4)], LOG)
    got = {r.urn: (r.x, r.y) for r in entity_page(log, ["x", "y"]).collect()}
    assert got == {"a": ("2", None), "b": (None, "3")}


def test_overlay_survives_ingestion_field_by_field(spark):
    ingested = spark.createDataFrame(
        [("a", "ing", "owner1"), ("b", "ing", "owner2")], "urn string, description string, owner string")
    edits = spark.createDataFrame(
        [("a", "edit 1", None, T0, 1), ("a", "edit 2", None, T0, 2), ("a", None, "me", T0, 3)],
        "urn string, description string, owner string, ts timestamp, seq long")
    got = {r.urn: (r.description, r.owner) for r in
           editorial_overlay(ingested, edits, "urn", ["description", "owner"]).collect()}
    assert got == {"a": ("edit 2", "me"), "b": ("ing", "owner2")}
