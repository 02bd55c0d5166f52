import re
from collections import Counter
from dataclasses import fields

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import common, rules as R

SF = "/root/testdata/sf0.01"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def base(text):
    m = R.measure(text)
    return tuple(getattr(m, name) for name in BASE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A\n\t\x0b#é  |!", max_size=60))
def test_base_counts(text):
    assert base(text) == brute_base(text)


def test_pieces_do_not_change_counts(monkeypatch):
    text = "one two three\n" * 40 + "ünï code é " * 50 + "x" * 200
    whole = R.measure(text)
    monkeypatch.setattr(R, "_PIECE", 7)
    monkeypatch.setattr(R, "pieces", lambda raw: common.pieces(raw, 7))
    assert R.measure(text) == whole


def test_other_measures():
    m = R.measure('Dr. Smith\'s "well-known" ABC!! x3 ###\nno end\nends.')
    assert (m.n_upper, m.n_calls, m.n_lines, m.n_ended_lines) == (5, 2, 3, 1)
    assert m.n_plain_words == 6 and m.top_word == 1  # not ABC!!, x3 and ###


def brute_posteriors(votes, rounds):
    """Expectation-maximisation document by document, with products of plain probabilities."""
    n_rules = len(votes[0])
    theta = [[list(R.START[k]) for _ in range(n_rules)] for k in (0, 1)]
    prior = 0.5

    def posterior(row):
        p = [1 - prior, prior]
        for r, v in enumerate(row):
            p = [p[k] * theta[k][r][v] for k in (0, 1)]
        return p[1] / sum(p)

    for _ in range(rounds):
        good = [posterior(row) for row in votes]
        new = []
        for k, weights in ((0, [1 - g for g in good]), (1, good)):
            new.append([])
            for r in range(n_rules):
                seen = [R.SMOOTHING * R.START[k][v] for v in range(3)]
                for row, w in zip(votes, weights, strict=True):
                    seen[row[r]] += w
                new[k].append([x / sum(seen) for x in seen])
        theta, prior = new, (sum(good) + 1) / (len(good) + 2)
    return [posterior(row) for row in votes]


def test_estimation_matches_brute_force():
    rng = np.random.default_rng(3)
    votes = rng.integers(0, 3, (40, 4))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fit = R.fit_accuracies(patterns, counts.astype(float), rounds=15)
    assert np.allclose(fit.posterior(patterns)[inverse.ravel()], brute_posteriors(votes.tolist(), 15))


def test_estimated_rates_are_those_of_the_rules():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    rates = np.array([[[0.7, 0.2, 0.1]] * 4, [[0.05, 0.15, 0.8]] * 4])
    draws = rng.random((len(good), 4))
    edges = np.cumsum(rates, axis=2)[good.astype(int)]
    votes = (draws[:, :, None] > edges).sum(axis=2)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fit = R.fit_accuracies(patterns, counts.astype(float))
    assert abs(fit.prior - 0.8) < 0.02
    assert np.abs(fit.rates - rates).max() < 0.03


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in R.op13_quality_rules(spark, SF).collect()}
    assert got.keys() == docs.keys()
    order = sorted(docs)
    votes = [["-0+".index(rule.vote(R.measure(docs[i]))) for rule in R.RULES] for i in order]
    posterior = dict(zip(order, brute_posteriors(votes, R.ROUNDS), strict=True))
    for i in order:
        want = brute_base(docs[i])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert tuple(got[i][name] for name in BASE) == want
        assert got[i]["base_failed"] == failed
        assert got[i]["quality"] == pytest.approx(posterior[i], abs=1e-6)
        assert got[i]["kept"] == (not failed and posterior[i] >= R.KEEP_AT)


def test_agrees_with_labels_it_never_saw(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", R.F.col("quality").alias("label"))
    judged = R.op13_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    assert len(judged) > 100
    assert np.mean([r["kept"] == (r["label"] == 1) for r in judged]) > 0.97


def test_edge_cases(spark):
    long = "One sentence of words follows another here. " * 3 + " ".join(f"w{i}ord" for i in range(200_000))
    rows = [
        (None, 1, "x", "p"), ("", 2, None, "q"), (" \n\t", 3, "y", "r"), ("a b c", None, "z", "s"),
        ("a b c", None, "z", "s"), (long, 4, "v", "t"),
    ]
    docs = spark.createDataFrame(rows, "text string, doc_id long, votes string, quality string")
    got = R.judge_quality(docs).collect()
    assert len(got) == 6
    by_id = {r["id"]: r for r in got if r["id"] is not None}
    assert [by_id[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0]
    assert all(by_id[i]["base_failed"] and not by_id[i]["kept"] for i in (1, 2, 3))
    assert all(by_id[i]["votes"] == "0" * len(R.RULES) for i in (1, 2, 3))
    assert by_id[4]["n_words"] == 200_021 and not by_id[4]["base_failed"]
    twins = [r for r in got if r["id"] is None]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert R.judge_quality(docs.limit(0)).count() == 0


def test_measures_are_what_rules_name():
    names = {f.name for f in fields(R.Measures)}
    assert all(set(rule.share) <= names for rule in R.RULES)
