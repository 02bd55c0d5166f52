import random

import pytest

from gaugeworks.operators.joins import fits_broadcast, hot_buckets, sized_join


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(3)
    # A third of the left rows share one key, with many equal rows; a fifth have none.
    left = []
    for i in range(3000):
        draw = rnd.random()
        key = "hot" if draw < 0.34 else None if draw < 0.5 else f"k{rnd.randrange(300)}"
        left.append((key, i % 3 if key == "hot" else i))
    right = [(f"k{i}", i) for i in range(0, 300, 2)] + [("hot", -1), ("k4", 99), (None, 5)]
    return (
        spark.createDataFrame(left, "k string, x int").repartition(6),
        spark.createDataFrame(right, "k string, y int"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(sides, how):
    left, right = sides
    want = sorted(map(repr, left.join(right, ["k"], how).collect()))
    salted = sized_join(left, right, ["k"], how, max_rows=10, hot_rows=100)
    assert "_salt" in plan(salted)
    assert sorted(map(repr, salted.collect())) == want
    small = sized_join(left, right, ["k"], how)
    assert "broadcast" in plan(small)
    assert sorted(map(repr, small.collect())) == want
    plain = sized_join(left, right, ["k"], how, max_rows=10)
    assert "_salt" not in plan(plain)  # large right side, but no key is hot
    assert sorted(map(repr, plain.collect())) == want


def test_hot_buckets_are_the_two_hot_keys(sides):
    left, _ = sides
    hot = hot_buckets(left, ["k"], hot_rows=100)
    keys = left.where("k = 'hot' OR k IS NULL")
    assert len(hot.rows) == 2 and sum(hot.rows.values()) == keys.count()
    assert left.where(hot.holds()).count() == keys.count()
    assert not hot_buckets(left, ["k"]).rows


def test_hot_key_is_spread_over_tasks(spark, sides):
    left, right = sides
    joined = sized_join(left, right.hint("merge"), ["k"], "inner", max_rows=1, hot_rows=50)
    assert joined.where("k = 'hot'").count() == left.where("k = 'hot'").count()


def test_size_is_measured(spark):
    df = spark.range(1000)
    assert fits_broadcast(df, max_rows=1000)
    assert not fits_broadcast(df, max_rows=999)
    assert not fits_broadcast(spark.range(10).selectExpr("repeat('x', 1000) AS t"), 100, 5000)


def test_refuses_what_salting_cannot_do(sides):
    left, right = sides
    with pytest.raises(ValueError):
        sized_join(left, right, ["k"], "full")
    with pytest.raises(TypeError):
        sized_join(left, right.selectExpr("y AS k"), ["k"])
