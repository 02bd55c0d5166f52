"""The pipeline against its stages worked out one text at a time."""

import hashlib
from collections import Counter

import corpus_pipeline
from gaugeworks.llm import bpe, quality, simhash
from gaugeworks.session import settle
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def without_repeats(rows, window=13):
    split = [(i, t, (t or "").encode().split()) for i, t in sorted(rows)]
    first = {}
    for i, _, words in split:
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = {}
    for i, text, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else text or ""
    return out


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    good = [(i, t) for i, t in rows if quality.score_text(weights, t) >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows)
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in good], 2)
    single = [row for row, lead in zip(good, groups, strict=True) if row[0] == lead]
    assert len(single) < len(good)
    texts = without_repeats(single)
    got = corpus_pipeline.run(spark, SF).collect()
    encode = bpe.load(bpe.RANKS).encoding.encode_ordinary
    assert {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in got} == {
        i: (len(encode(t)), encode(t)) for i, t in texts.items()
    }
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()
    }
    assert set(Counter(r["doc_id"] for r in got).values()) <= {1, 2}


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "byte_bpe",
    ]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_columns_of_any_name_pass_through_the_stages(spark):
    """Names the stages use themselves, no n_chars, rows without an id and with repeated ones."""
    words = [f"word{i} follows another" for i in range(400)]
    texts = [". ".join(words[20 * i : 20 * i + 20]) for i in range(20)] + [None, ""]
    rows = [
        (f"o{n}", n, f"q{n}", 0.5 + n, n % 3, texts[n % len(texts)], None if n % 5 == 0 else n % 17, ("a", "b", None)[n % 3],
         ["x"], f"s{n}", "c", n, "k")
        for n in range(60)
    ]
    names = ["offset", "mix_note", "quality_score", "mix_start", "component", "text", "doc_id", "source", "carried_0",
             "_salt", "text2", "id", "a.b"]
    types = "string int string double int string long string array<string> string string int string".split()
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
    marks = {}
    for row in rows:
        marks[row[1]] = tuple(repr(v) for i, v in enumerate(row) if names[i] != "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["mix_note"]: r["text"] for r in docs.collect()}
        docs = settle(stage(spark, docs, SF))
        assert docs.columns == names
        kept = docs.collect()
        for row in kept:
            assert tuple(repr(v) for n, v in zip(names, row) if n != "text") == marks[row["mix_note"]], name
        if name in ("substring_dedup", "source_mixing"):
            assert {r["mix_note"] for r in kept} == set(before), name
        if name == "simhash_near_dedup":
            # No group of texts is lost: every fingerprint component keeps a row.
            def print_of(text):
                return simhash.fingerprint(text)

            prints = {n: print_of(t) for n, t in before.items()}
            left = {prints[r["mix_note"]] for r in kept}
            assert all(any((p ^ q).bit_count() <= 2 for q in left) for p in prints.values())
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert done.count() == docs.count()
