import random
from collections import deque

import pytest

from gaugeworks.operators import lineage
from gaugeworks.operators.contraction import contract_runs

EDGE = "upstream string, downstream string"


def brute_walk(edges, start, direction):
    here, there = (1, 0) if direction == "upstream" else (0, 1)
    steps = {}
    for e in edges:
        steps.setdefault(e[here], set()).add(e[there])
    hops, queue = {start: 0}, deque([start])
    while queue:
        for other in steps.get(node := queue.popleft(), ()):
            if other not in hops:
                hops[other] = hops[node] + 1
                queue.append(other)
    return {k: v for k, v in hops.items() if v}


def chain(name, n, first=None, last=None):
    nodes = [first or f"{name}0", *(f"{name}{i}" for i in range(1, n)), last or f"{name}{n}"]
    return list(zip(nodes, nodes[1:]))


def walked(spark, edges, start, direction, **options):
    df = spark.createDataFrame(edges, EDGE)
    rows = lineage.lineage_walk(df, start, direction, **options).collect()
    assert len({r.entity for r in rows}) == len(rows)
    return {r.entity: r.hops for r in rows}


GRAPHS = {
    "two ways of different length": chain("a", 9, "s", "t") + chain("b", 4, "s", "t") + chain("c", 7, "t", "u"),
    "long way first seen": [("s", "x")] + chain("p", 12, "x", "y") + chain("q", 3, "s", "y") + chain("r", 8, "y", "z"),
    "ring through the start": chain("r", 15, "s", "s"),
    "ring behind a chain": chain("a", 6, "s", "b") + chain("r", 9, "b", "b"),
    "ring apart": chain("a", 8, "s", "t") + chain("r", 5, "x", "x") + [("l", "l")],
    "back to a seen one": chain("a", 9, "s", "t") + [("t", "a1"), ("t", "v")],
    "loose ends": chain("a", 8, "s") + [("a3", None), (None, "a4"), ("w", "w")] + chain("b", 5, "a4", "s"),
}


@pytest.mark.parametrize("direction, contract_after", [("downstream", 0), ("downstream", 2), ("upstream", 1)])
def test_contracted_walks(spark, direction, contract_after):
    """All graphs as one, hung on a common start."""
    edges = [(a and f"{i}{a}", b and f"{i}{b}") for i, graph in enumerate(GRAPHS.values()) for a, b in graph]
    real = [e for e in edges if None not in e]
    hooks = [(("*", f"{i}s"), (f"{i}{graph[-1][1]}", "*"))[direction == "upstream"] for i, graph in enumerate(GRAPHS.values())]
    want = brute_walk(real + hooks, "*", direction)
    assert walked(spark, edges + hooks, "*", direction, contract_after=contract_after) == want


@pytest.mark.parametrize("seed", (1, 2))
def test_random_sparse_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [e for i in range(14) for e in chain(f"c{i}_", rng.randrange(1, 9), f"n{rng.randrange(8)}", f"n{rng.randrange(8)}")]
    edges += edges[:5]
    start = edges[0][0]
    options = {"contract_after": 1, "max_rows": 0, "hot_rows": 2} if seed == 2 else {"contract_after": 1}
    assert walked(spark, edges, start, "downstream", **options) == brute_walk(edges, start, "downstream")


def test_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    from gaugeworks.operators import contraction

    rounds = []
    measured = contraction._measured
    monkeypatch.setattr(contraction, "_measured", lambda df: (rounds.append(1), measured(df))[1])
    n = 100_000
    df = spark.range(n).selectExpr("'n' || id AS upstream", "'n' || (id + 1) AS downstream")
    found = lineage.lineage_walk(df, "n0", "downstream", contract_after=2)
    wrong = found.where("entity <> 'n' || hops").count()
    assert (found.count(), wrong) == (n, 0)
    assert len(rounds) <= 19


def test_deep_walk_raises_beyond_the_bound(spark):
    df = spark.createDataFrame(chain("a", 30), EDGE)
    assert lineage.lineage_walk(df, "a0", "downstream", max_hops=30, contract_after=3).count() == 30
    with pytest.raises(ValueError, match="deeper than 29"):
        lineage.lineage_walk(df, "a0", "downstream", max_hops=29, contract_after=3)


def test_runs_become_single_steps(spark):
    steps = spark.createDataFrame(chain("a", 5, "s", "t") + [("s", "x"), ("x", "y"), ("x", "z")], "entity string, next string")
    fixed = spark.createDataFrame([("s",)], "entity string")
    got = contract_runs(steps, fixed)
    assert {(r.entity, r.next, r.weight, r.head) for r in got.steps.collect()} == {
        ("s", "t", 5, "a1"), ("s", "x", 1, None), ("x", "y", 1, None), ("x", "z", 1, None),
    }
    assert {(r.entity, r.head, r.offset) for r in got.members.collect()} == {(f"a{i}", "a1", i - 1) for i in range(1, 5)}
