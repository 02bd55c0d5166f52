import hashlib
import random

import pytest

from gaugeworks.llm import bpe as B


def want(bpe, text):
    ids = bpe.encoding.encode_ordinary(text or "")
    return ids


def samples():
    rng = random.Random(3)
    pieces = ["a", "word", "'ll", "'", "'re", " ", "  ", "\n", "\n\n ", "\t", " ", "é", "漢字", "12345", "!!", "🙂", "\x1c", "x" * 90, " " * 70, "'" * 50, "\r\n", " ", "R", "'s"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 400))) for _ in range(150)] + [
        "y" * 1000, " " * 1000, "é" * 333, "a" * 63 + "'ll" + "b" * 300, None, "",
    ]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 60), (50, 7)])
def test_stitched_chunks_match_the_library(spark, chunk, overlap):
    texts = samples()
    bpe = B.load(B.RANKS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["ids"] for r in B.encode_documents(docs, chunk=chunk, overlap=overlap).collect()}
    assert {i: got[i] for i in got} == {i: want(bpe, t) for i, t in enumerate(texts)}
    decoded = {r["id"]: r for r in B.decode_documents(B.encode_documents(docs, chunk=chunk, overlap=overlap)).collect()}
    for i, text in enumerate(texts):
        assert bytes(decoded[i]["decoded"]) == (text or "").encode()
        line = " ".join(map(str, want(bpe, text))).encode()
        assert decoded[i]["ids_sha256"] == hashlib.sha256(line).hexdigest()


def test_edge_cases(spark):
    long = "one two  three\n" * 9000
    rows = [(long, 1, "x"), (long, 1, "y"), (long, None, "z"), ("", None, None), (None, 4, "ids"), ("a", 4, "a")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, ids string")
    got = B.encode_documents(docs).collect()
    bpe = B.load(B.RANKS)
    assert sorted((r["id"] is None, r["id"] or 0, r["ids"]) for r in got) == sorted(
        (i is None, i or 0, want(bpe, t)) for t, i, _ in rows
    )
    assert B.encode_documents(docs.limit(0)).count() == 0
    staged = B.bpe_stage(spark, docs, "")
    assert staged.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and staged.count() == len(rows)


def test_reads_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bpe = B.load(B.RANKS)
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in B.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.select("doc_id", "text").collect():
        ids = want(bpe, row["text"])
        assert got[row["doc_id"]] == (len(ids), hashlib.sha256((row["text"] or "").encode()).hexdigest())
