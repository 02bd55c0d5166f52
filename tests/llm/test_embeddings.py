import math
import random

import numpy as np
import pytest

from gaugeworks.llm import embeddings as E


def brute(rows, threshold=0.98):
    n = len(rows)
    sound = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        sound.append(bool(ok))
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo.extend(new)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def key(row):
    return repr(row)


def compare(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = E.embedding_groups(df, **settings).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(rows)))


@pytest.mark.parametrize("settings", [{}, {"block": 8, "sample": 50}])
def test_matches_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(E, "CELL_VECTORS", 25)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (centre + rng.normal(size=8) * rng.choice([0.02, 0.1])).tolist(), int(rng.integers(0, 2))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    compare(spark, rows, **settings)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (9, None, 1), (10, [], 1), (11, [0.0, 0.0], 1),
        (12, [nan, 1.0], 1), (13, [inf, 1.0], 1), (14, [None, 1.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 2),
        (15, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.0], 1), (16, [3e38, 3e38], 1), (17, [1e-40, 1e-40], 1), (18, [-0.0, 1.0], 3),
        (19, [0.0, 1.0], 3),
    ]
    compare(spark, rows)
    wide = spark.createDataFrame([(1, [1.0], 1, "x", 2)], "vec_id long, embedding array<float>, label int, node string, n_links int")
    assert E.embedding_groups(wide).collect() == [(1, 0, 1, True)]
    assert E.embedding_groups(wide.limit(0)).count() == 0


def test_cells_lose_no_link():
    rng = np.random.default_rng(1)
    vectors = E.unit(rng.normal(size=(3000, 6)))
    near = E.unit(vectors + rng.normal(size=vectors.shape) * 0.05)
    centres = E.spherical_kmeans(vectors, 40)
    home, visited = E.cells_of(near, centres, 0.98)
    linked = np.einsum("ij,ij->i", vectors, near) >= 0.98
    own = (vectors @ centres.T).argmax(axis=1)
    assert linked.sum() > 1000
    assert visited[np.flatnonzero(linked), own[linked]].all()
    assert (own[linked] != home[linked]).any()
