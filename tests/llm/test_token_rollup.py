import pytest

from gaugeworks.llm import token_rollup as R
from gaugeworks.llm.bpe import RANKS, load

SCHEMA = "doc_id long, source string, lang string, text string, n_tokens string"


@pytest.fixture
def docs(spark):
    rows = [
        (1, "a", "en", "one two", "x"), (2, "a", "en", None, ""), (3, None, "en", "three", None), (4, "b", None, "", "y"),
        (4, "b", None, "four five six", "y"), (None, "a", "en", "w " * 50_000, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def totals(ledger):
    return sorted(map(tuple, ledger.totals().collect()), key=str)


def test_batches_count_once_in_any_order(spark, docs, tmp_path):
    words = R.word_count(R.F.col("text"))
    load = R.inserted(docs, "v1", words)
    gone = R.deleted(docs.where("source = 'b'"), "v1", words)
    more = R.revised(docs.where("doc_id = 1"), "v1", words, words + 5)
    results = []
    for k, order in enumerate([[("l", load), ("g", gone), ("m", more)], [("m", more), ("g", gone), ("l", load)]]):
        ledger = R.TokenLedger(spark, str(tmp_path / str(k)))
        assert totals(ledger) == []
        for name, changes in order:
            assert ledger.commit(name, changes)
            assert not ledger.commit(name, changes.unionByName(changes))
        results.append(totals(ledger))
    assert results[0] == results[1] == sorted([("a", "en", "v1", 3, 50_007), (None, "en", "v1", 1, 1)], key=str)


def test_compaction_changes_no_total(spark, docs, tmp_path):
    ledger = R.TokenLedger(spark, str(tmp_path))
    for name in ("x", "y", "z"):
        ledger.commit(name, R.inserted(docs, name, R.word_count(R.F.col("text"))))
        before = totals(ledger)
        ledger.compact()
        assert totals(ledger) == before and ledger._counted() == [f"base-{'xyz'.index(name) + 1}"]
        assert not ledger.commit("x", R.inserted(docs, "x", R.word_count(R.F.col("text"))))
    ledger.compact()
    assert totals(ledger) == before


def test_broken_batch_is_written_anew(spark, docs, tmp_path):
    ledger = R.TokenLedger(spark, str(tmp_path))
    changes = R.inserted(docs, "v", R.word_count(R.F.col("text")))
    ledger.commit("one", changes)
    want = totals(ledger)
    (tmp_path / "batches" / "one" / "_SUCCESS").unlink()
    assert totals(ledger) == [] and not ledger.is_committed("one")
    assert ledger.commit("one", changes) and totals(ledger) == want


def test_edge_cases(spark, docs, tmp_path):
    ledger = R.TokenLedger(spark, str(tmp_path))
    assert ledger.commit("empty", R.inserted(docs.limit(0), "v", R.word_count(R.F.col("text"))))
    assert ledger.is_committed("empty") and totals(ledger) == []
    assert ledger.commit("nulls", R.inserted(docs.limit(1), "v", R.F.lit(None)))
    assert totals(ledger) == [("a", "en", "v", 1, 0)]
    for bad in ("", "a/b", "base-1", "_x", ".x"):
        with pytest.raises(ValueError):
            ledger.commit(bad, docs)


def test_counts_of_a_real_tokenizer(spark, docs, tmp_path):
    """Inserted, then some deleted and one revised under the 50k byte-level ranks."""
    encode = load(RANKS).encoding.encode_ordinary
    named = docs.withColumn("n_bpe", R.F.lit("x")).withColumn("a.b", R.F.lit(1))
    counted = R.with_bpe_count(named)
    assert counted.columns == [*docs.columns, "a.b", "n_bpe"]
    rows = counted.collect()
    assert all(r["n_bpe"] == len(encode(r["text"] or "")) for r in rows) and len(rows) == 6
    ledger = R.TokenLedger(spark, str(tmp_path))
    n = R.F.col("n_bpe")
    ledger.commit("load", R.inserted(counted, "byte_bpe_50k", n))
    ledger.commit("gone", R.deleted(counted.where("doc_id = 3"), "byte_bpe_50k", n))
    again = R.with_bpe_count(docs.where("doc_id = 1").withColumn("text", R.F.lit("one, two; three")))
    ledger.commit("edit", R.revised(again, "byte_bpe_50k", R.F.lit(len(encode("one two"))), n))
    want = {}
    for r in rows:
        if r["doc_id"] != 3:
            text = "one, two; three" if r["doc_id"] == 1 else r["text"] or ""
            key = (r["source"], r["lang"], "byte_bpe_50k")
            want[key] = tuple(a + b for a, b in zip(want.get(key, (0, 0)), (1, len(encode(text)))))
    assert totals(ledger) == sorted((k + v for k, v in want.items()), key=str)
