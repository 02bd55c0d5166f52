import random

import numpy as np
import pytest
import xxhash

from gaugeworks.llm import simhash as S


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    marks = [m for _, m in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [
    None, "", " \n", "One", "one Two", "A b\tC\x0bd \x85e f", "É À é x \x1c y z " * 40, "x " * 70_000,
])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    marks = rng.integers(0, 1 << 63, 300, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False)) for _ in marks]
    others = marks ^ np.array(flips, np.uint64)
    valid = S._mask(rng.random(300) < 0.8)
    got = S.lanes(S.within_radius(S.bit_planes(marks), S.bit_planes(others), valid, radius))
    allowed = set(S.lanes(valid).tolist())
    assert got.tolist() == [i for i in range(300) if i in allowed and bin(flips[i]).count("1") <= radius]


def near(rng, n, clusters):
    rows = []
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(n // clusters):
            rows.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    return rows


def test_links_in_large_and_small_bands_agree():
    marks = np.array(sorted(set(near(random.Random(1), 60, 3))), np.uint64)
    small = S.link_small_bands(np.zeros(len(marks)), marks, 2)
    large = S.link_large_band(marks, 2)
    for found in (small, large):
        want = brute_components([(i, int(m)) for i, m in enumerate(marks)], 2)
        assert found.tolist() == want


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_groups_match_brute_force(spark, hot_rows, monkeypatch):
    rng = random.Random(2)
    marks = near(rng, 400, 8) + [rng.getrandbits(64) for _ in range(100)] + [0] * 30
    rows = [(i if i % 17 else None, m) for i, m in enumerate(marks)]
    table = spark.createDataFrame(
        [(i, m - (1 << 64) if m >> 63 else m) for i, m in rows], "id long, fingerprint long"
    )
    monkeypatch.setattr(S, "fingerprints", lambda df, *_: df)
    got = S.simhash_groups(table, hot_rows=hot_rows).collect()
    key = lambda r: (r[1] & (1 << 64) - 1, -1 if r[0] is None else r[0])
    want = [(i, m, c) for (i, m), c in zip(rows, brute_components(rows, 2), strict=True)]
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=key) == sorted(want, key=key)


def test_edge_cases_and_stage(spark):
    schema = "text string, doc_id long, lang string, source string, n_chars long, fingerprint string, mark int"
    rows = [
        (None, 5, None, None, None, "x", 1), ("", 3, "en", "a", 0, "y", 2), ("same words here", 9, "en", "a", 1, "", 3),
        ("same words here", 9, "en", "a", 1, "", 3), ("Same words here", 7, None, "a", 1, "", 4),
        ("lonely", None, "en", None, 6, None, None), ("w " * 90_000, 1, "en", "a", 2, "", 5),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r[0] is None, r[0] or 0, r[2]) for r in S.simhash_groups(docs).collect())
    assert got == [(False, 1, 1), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 9, 7), (False, 9, 7), (True, 0, None)]
    kept = S.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 7), (True, 0),
    ]
    twice = docs.unionByName(docs)
    assert S.simhash_stage(spark, twice, "").where("doc_id is not null").count() == 3
    assert S.simhash_groups(docs.limit(0)).count() == 0
    assert S.simhash_stage(spark, docs.limit(0), "").count() == 0
