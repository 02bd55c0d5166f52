import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeworks.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = Q.op7_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = np.mean([g > b for g in good for b in bad])
    assert wins > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    everything = scored.collect()
    assert len(everything) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in everything:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_no_learning_from_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert np.array_equal(Q.fit_quality(docs, labels), Q.fit_quality(docs, other))


def test_bound_on_training_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert not np.array_equal(Q.fit_quality(docs, labels, max_rows=60), Q.fit_quality(docs, labels))


def test_ftrl_separates():
    rows = [Q._shifted(t, 10) for t in ["good text here", "bad !!! words", "more good text", "!!! bad"]] * 5
    weights = Q.fit_ftrl(rows, [1, 0, 1, 0] * 5, 4, 10)
    assert Q.score_text(weights, "good text", 10) > 0.6 > 0.4 > Q.score_text(weights, "bad !!!", 10)


@pytest.mark.parametrize("labelled", [True, False])
def test_edge_cases(spark, labelled):
    rows = [(None, 1, "x"), ("", 2, None), ("w " * 80_000, None, "y"), ("w w w", 3, "z"), ("w w w", 3, "z")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, quality_score string")
    labels = spark.createDataFrame(
        [(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (2, None, 1)] if labelled else [], "doc_id long, quality int, toxic int"
    )
    weights = Q.fit_quality(docs, labels)
    scored = Q.score_quality(docs, weights)
    assert scored.columns == ["text", "doc_id", "quality_score"]
    scores = [r["quality_score"] for r in scored.collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    if not labelled:
        assert set(scores) == {0.5}
    assert Q.score_quality(docs.limit(0), weights).count() == 0


def test_stage_drops_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = Q.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    accepted = Q.op7_quality_classifier(spark, SF).where("predicted = 1").select("doc_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in accepted.collect())


def brute_features(text, bits):
    """Log counts of hashed 1- and 2-grams, a dictionary, scaled to length one."""
    words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", (text or "").encode())
    codes = [zlib.crc32(w) for w in words]
    grams = codes + [0x5851F42D4C957F2D if a == b else a * 31 + b + 0x7F4A7C15 for a, b in zip(codes, codes[1:])]
    counts = Counter(g * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits) for g in grams)
    length = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    return {-1: 1.0} | {slot: math.log1p(n) / length for slot, n in counts.items()}


def brute_weights(rows, epochs, s=Q.Ftrl()):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_query_matches_brute_force(spark):
    """Features, updates and scores worked out one number at a time."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    drawn = labels.select("doc_id", "quality", Q.draw_of("doc_id").alias("draw")).collect()
    known = sorted((r["draw"], r["doc_id"], r["quality"]) for r in drawn if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    rows = {i: brute_features(t, Q.FEATURE_BITS) for i, t in docs.items()}
    weights = brute_weights([(rows[i], y) for _, i, y in known if i in rows], Q.EPOCHS)
    got = {r["doc_id"]: r["score"] for r in Q.op7_quality_classifier(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, x in rows.items():
        dot = sum(v * weights.get(slot, 0.0) for slot, v in x.items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-3)


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"!!! {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 7"))
    assert np.array_equal(Q.fit_quality(docs, labels), Q.fit_quality(more, labels))
    assert not np.array_equal(Q.fit_quality(docs, labels, max_bytes=400), Q.fit_quality(docs, labels))
