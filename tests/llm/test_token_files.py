import zlib

import numpy as np
import pytest
from tokenizers import AddedToken, Tokenizer

from gaugeworks.llm import token_files as F


def expected(rows):
    library = Tokenizer.from_file(F.TOKENIZER)
    library.encode_special_tokens = True
    out, start = [], 0
    for own, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((own, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = F.op4_token_files(spark, sf).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_pieces_match_the_library():
    library = Tokenizer.from_file(F.TOKENIZER)
    library.encode_special_tokens = True
    texts = ["a'll b   x \u0085y\x1cz", "漢字 12 ３٣ 🙂🙂", "<|endoftext|> x", " \n\n\t x", "'re're 'S", "", "é é"]
    own = F.PieceEncoder(F.TOKENIZER)
    texts += ["a b  c", "x ", " x", "  x", "a \n b", "one two\nthree four", "a \u00a0b", "it's we'll x'S", " ", "y \x1c z"]
    for text in texts + texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shard_bytes", [1, 300, 1 << 20])
def test_edge_cases_and_single_documents(spark, tmp_path, shard_bytes):
    long = "word piece " * 40_000
    rows = [("one two", 7, "x"), (None, 3, None), ("", None, "y"), (long, 1, "z"), ("one two", 7, "x")] + [
        (f"document number {i} with some text", 100 + i, "") for i in range(300)
    ]
    docs = spark.createDataFrame(rows, "text string, doc_id long, ids string")
    path = str(tmp_path / "files")
    F.write_token_files(docs, path, shard_bytes=shard_bytes)
    ordered = sorted(((i, t) for t, i, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = F.read_token_files(spark, path).collect()
    have = sorted(
        ((r["id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got), key=lambda r: r[1]
    )
    assert have == expected(ordered)
    wanted = spark.createDataFrame([(7,), (150,), (9999,)], "id long")
    found = F.read_documents(spark, path, wanted).collect()
    assert sorted(r["id"] for r in found) == [7, 7, 150]
    whole = {r["id"]: bytes(r["ids"]) for r in got}
    assert all(bytes(r["ids"]) == whole[r["id"]] for r in found)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    F.write_token_files(docs, str(tmp_path / "none"))
    assert F.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_dictionary_helps_short_documents(spark, tmp_path):
    F.write_token_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "d"))
    raw = F.read_dictionary(spark, str(tmp_path / "d"))
    lines = [bytes(r["ids"]) for r in F.read_token_files(spark, str(tmp_path / "d")).collect()]
    short = [line for line in lines if len(line) < 3000]
    plain = sum(len(F.zstandard.ZstdCompressor(level=3).compress(x)) for x in short)
    shared = F.zstandard.ZstdCompressor(level=3, dict_data=F.zstandard.ZstdCompressionDict(raw))
    assert raw and sum(len(shared.compress(x)) for x in short) < 0.9 * plain


MARKED = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "one two\n\n<|endoftext|>  three it's", "<|endoftext|",
    "tail <|endoftext|>", " \n<|endoftext|>\n ", "plain words", "", "漢字<|endoftext|>é <|endoftext|>" + " word" * 500,
]


def test_added_tokens_inside_texts_match_the_library(spark, tmp_path):
    library = Tokenizer.from_file(F.TOKENIZER)
    assert library.encode(MARKED[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    F.write_token_files(docs, str(tmp_path / "marked"))
    start = 0
    for row in sorted(F.read_token_files(spark, str(tmp_path / "marked")).collect(), key=lambda r: r["id"]):
        want = library.encode(MARKED[row["id"]], add_special_tokens=False).ids + [0]
        assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == want
        assert (row["start"], row["n_tokens"]) == (start, len(want))
        start += len(want)


@pytest.mark.parametrize("flags", [{"lstrip": True}, {"rstrip": True}, {"single_word": True}, {"normalized": True}])
def test_flags_of_added_tokens_match_the_library(tmp_path, flags):
    library = Tokenizer.from_file(F.TOKENIZER)
    library.add_tokens([AddedToken("<x>", **{"normalized": False} | flags), AddedToken("<x><y>", normalized=False)])
    library.save(str(tmp_path / "t.json"))
    own = F.TextEncoder(str(tmp_path / "t.json"))
    for text in [*MARKED, "a <x> b", "a<x>b", " <x><y><x> ", "<|endoftext|> <x>\n<y>"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_repetitive_texts_fill_shards_by_their_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, "alpha beta " * 3000) for i in range(40)], "doc_id long, text string").coalesce(1)
    F.write_token_files(docs, str(tmp_path / "f"), shard_id_bytes=100_000)
    shards = spark.read.parquet(f"{tmp_path}/f/shards").select("n_tokens").collect()
    assert len(shards) > 5 and max(r["n_tokens"] for r in shards) * 4 < 150_000
    got = F.read_token_files(spark, str(tmp_path / "f"))
    assert got.count() == 40 and got.select("ids").distinct().count() == 1


def test_texts_together_match_the_library(monkeypatch):
    """Different words are looked up once in all texts; odd texts among them come out the same."""
    library = Tokenizer.from_file(F.TOKENIZER)
    texts = ["", " ", "  x", " x", "x ", "a  b", "a  b c", "y \x1c z", "\nx y", "<|endoftext|> x", "one two\nthree"]
    texts += ["word, word. word word$$$ word\nword", "a'll it's", "漢字, 漢字 é²x ²x", "word " * 50, "x" * 90, ""]
    own = F.TextEncoder(F.TOKENIZER)
    monkeypatch.setattr(F, "TOGETHER_BYTES", 80)
    want = [library.encode(text, add_special_tokens=False).ids for text in texts]
    batch = F.pa.RecordBatch.from_arrays([F.pa.array(range(len(texts))), F.pa.array(texts)], ["id", "text"])
    for rows in (batch, batch.slice(3), batch.slice(0, 1), batch.slice(0, 0)):
        got = [line for cut in F._together([rows]) for line in own.encode_all(cut.column(1))]
        have = [np.frombuffer(line, "<u4").tolist() for line in got]
        assert have == [want[k] for k in rows.column(0).to_pylist()]
    monkeypatch.undo()
    met, encode = [], own.encode_word
    own.words.clear()
    own.words.encode = lambda word: met.append(word) or encode(word)
    assert [len(line) // 4 for line in own.encode_all(F.pa.array(texts))] == [len(ids) for ids in want]
    own.encode_all(F.pa.array(texts))
    assert len(met) == len(set(met))
    assert own.encode_all(F.pa.array(["", ""])) == [b"", b""]
    assert own.encode_all(F.pa.array([], F.pa.string())) == []
