import math
from collections import Counter, defaultdict

import pytest

from gaugeworks.llm import mixing as M


def test_exponent_meets_entropy_and_limit():
    tokens = [6000, 900, 300, 50]
    goal = 0.9 * math.log(4)
    a = M.solve_exponent(tokens, 7250, goal, None)
    assert M.entropy(M.tempered([t / 7250 for t in tokens], a)) == pytest.approx(goal, abs=1e-9)
    b = M.solve_exponent(tokens, 7250, goal, 3.0)
    given = M.quotas(tokens, 7250, goal, 3.0)
    assert b > a and all(g <= 3 * t for g, t in zip(given, tokens, strict=True))
    assert M.solve_exponent(tokens, 7250, 0.0, None) == 1.0
    assert M.solve_exponent(tokens, 7250, 9.9, None) == 0.0
    assert M.solve_exponent([0, 0], 10, 1.0, 2.0) == 1.0 and M.quotas([0, 0], 10, 1.0, 2.0) == [0, 0]
    whole = M.quotas(tokens, None, None, 1.5)
    assert whole[0] == 6000 and all(t <= g <= 1.5 * t + 1 for g, t in zip(whole, tokens, strict=True))


def corpus(spark):
    rows = []
    for i in range(900):
        source = ["big", "big", "big", "mid", None, "tiny"][i % 6] if i < 600 else "big"
        if source == "tiny" and i > 100:
            source = "big"
        rows.append(("w " * (i * 7 % 40), i, "en", source, i, "mine"))
    return spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars long, mix_start string")


def test_quotas_are_filled_by_whole_epochs(spark):
    docs = corpus(spark)
    rows = M.mix_sources(docs, budget=9000, entropy_share=0.95, max_repeat=2.5, block_docs=16).collect()
    used, seen = Counter(), defaultdict(list)
    for r in rows:
        used[r["mix_source"]] += r["mix_tokens"]
        seen[r["mix_source"], r["doc_id"]].append(r["mix_epoch"])
    quota = {r["mix_source"]: r["mix_quota"] for r in rows}
    for source, n in used.items():
        assert quota[source] - 40 < n <= quota[source]
    assert sum(quota.values()) <= 9000
    for epochs in seen.values():
        assert len(set(epochs)) == len(epochs)
    for source in quota:
        counts = [len(e) for (s, _), e in seen.items() if s == source]
        assert max(counts) - min(counts) <= 1
        starts = sorted((r["mix_start"], r["mix_tokens"]) for r in rows if r["mix_source"] == source and r["mix_tokens"])
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_stage_keeps_every_document(spark):
    docs = corpus(spark)
    mixed = M.mixing_stage(spark, docs.drop("mix_start"), "")
    assert mixed.columns == docs.drop("mix_start").columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) == set(range(900)) and set(times.values()) <= {1, 2}


def test_edge_cases(spark):
    schema = "text string, doc_id long, lang string, source string, n_chars long"
    rows = [(None, 1, None, None, None), ("", 2, "en", "a", 0), ("w " * 50_000, 3, "en", "b", 1)] + [("w w", 4, "en", "b", 1)] * 3
    docs = spark.createDataFrame(rows, schema)
    assert M.mixing_stage(spark, docs, "").count() == 6
    assert M.mixing_stage(spark, docs.limit(0), "").count() == 0
    assert M.mix_sources(docs.limit(0), budget=5, entropy_share=0.9).count() == 0
    assert M.mix_sources(docs.limit(2), budget=5, entropy_share=0.9).count() == 0


def test_stage_flattens_a_hot_source(spark):
    rows = [("w " * 20, i, "en", "hot" if i % 3 == 0 else f"s{i % 20}", 40) for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars long")
    times = Counter((r["source"], r["doc_id"]) for r in M.mixing_stage(spark, docs, "").collect())
    assert {i for _, i in times} == set(range(3000)) and set(times.values()) <= {1, 2}
    total = sum(times.values())
    share = Counter()
    for (source, _), n in times.items():
        share[source] += n / total
    assert share["hot"] < 0.22 and M.entropy(list(share.values())) > 0.94 * math.log(21)
