import hashlib
import random

import numpy as np
import pytest

from gaugeworks.llm import substrings as S


def brute(rows, window=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if order(first[tuple(words[k : k + window])]) < order(i):
                gone |= set(range(k, k + window))
        line = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(line).hexdigest()))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice("a b c d e f".split()) + str(rng.randint(0, 400)) for _ in range(rng.choice([0, 5, 12, 13, 14, 80]))]
        if i % 3 == 0:
            words.insert(len(words) // 2, passage)
        rows.append((i * 7, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(10_000 + i, rows[30][1]) for i in range(40)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2_000, "bucket_windows": 100}])
def test_matches_brute_force(spark, sizes):
    rows = corpus(1)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    got = got.select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2_000, "bucket_windows": 100}])
def test_colliding_hashes_remove_nothing(spark, sizes):
    """The first hash has seven values only, within a chunk and between chunks: the second decides."""
    rows = corpus(2, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def poor(digits, window):
        return S.window_hashes(digits, window) % np.uint64(7) << np.uint64(61)

    got = S.remove_repeats(docs, first=poor, **sizes).select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_rows_without_an_id_are_spread(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "'text ' || id AS text")
    dealt = rows.select("doc_id", S.chunk_of(S.F.coalesce("doc_id", S.F.lit(S._NO_ID)), S.F.col("text"), 30).alias("chunk"))
    sizes = [r["count"] for r in dealt.where("doc_id IS NULL").groupBy("chunk").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 80


def test_windows_are_independent_of_place():
    words = "a b c d e f g h i j k l m n o p".split()
    far = S.word_digits(" ".join(words * 90_000))
    for which in (0, 1):
        hashes = S.window_hashes(far, which=which)
        assert np.array_equal(hashes[:16], hashes[16 * 80_000 : 16 * 80_000 + 16])
        assert len(set(hashes[:16].tolist())) == 16
        assert len(S.window_hashes(far[:12], which=which)) == 0
    assert not set(S.window_hashes(far[:40]).tolist()) & set(S.window_hashes(far[:40], which=1).tolist())


def test_edge_cases_and_stage(spark):
    text = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"v{k % 50_000}" for k in range(100_000))
    rows = [
        (text, 4, "en", "a", 9, "x"), (text, None, "en", "a", 9, "x"), (text, 4, "en", "a", 9, "x"),
        (None, 2, None, None, None, None), ("", 3, "en", "b", 0, ""), (long, 1, "en", "b", 1, "y"),
        (" " + text + " z", 8, "en", "b", 1, "y"),
    ]
    docs = spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars long, chunk string")
    got = S.remove_repeats(docs).select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r[1], r[0]) for r in rows]), key=key)
    kept = S.substring_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert S.substring_stage(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns
    by = {r["doc_id"]: r for r in kept.collect()}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[1]["text"] == long
    assert by[4]["text"] == "" and by[4]["n_chars"] == 0 and by[None]["text"] == text
    assert by[8]["text"] == " w0 w19 z" and by[8]["chunk"] == "y"
    assert S.remove_repeats(docs.limit(0)).count() == 0
    intervals = {r["id"]: (r["starts"], r["ends"]) for r in S.remove_repeats(docs).collect()}
    assert intervals[8] == ([1], [19]) and intervals[1] == ([], [])
