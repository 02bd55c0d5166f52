"""Token-id files: documents compressed one by one under a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from gaugeworks.llm.common import draw_of, drawn, long_id, partitions_for, ship_package, table
from gaugeworks.operators.joins import sized_join
from gaugeworks.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Documents the dictionary is trained on, the first characters taken of each, and its own size.
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 1 << 14
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: A shard ends with the document that brings its frames, or the ids in them, to so many bytes.
SHARD_BYTES = 1 << 20
SHARD_ID_BYTES = 1 << 24
#: Ids kept in a process: of pre-tokens, of what follows a word's letters, of words.
KNOWN_PIECES = 200_000
KNOWN_RESTS = 50_000
KNOWN_WORDS = 750_000
#: Texts are encoded together up to so many bytes; a longer one is encoded on its own.
TOGETHER_BYTES = 1 << 23
_SPACES = re.compile(r" (?:\s|$)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes, in order, from code point 256 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept(dict):
    """Ids of texts, as `encode` gives them; the first `limit` texts met are kept."""

    def __init__(self, encode, limit: int) -> None:
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(self) < self.limit:
            self[text] = ids
        return ids


class PieceEncoder:
    """A byte-level BPE file of the tokenizers library, one pre-token at a time.

    Merges never cross pre-tokens, so a text's ids are those of its pre-tokens, which the
    library's model encodes. A pre-token always begins at a space before anything but white
    space, so words between single spaces are encoded apart too; one also ends where a word's
    leading letters end, so they and the rest of the word are encoded apart. Ids of words,
    rests and other pre-tokens met before are kept, up to a bound.
    """

    def __init__(self, path: str) -> None:
        space = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(space)
        self.leading = regex.compile(r"\p{L}+").match
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _byte_letters()
        known = self.library.get_vocab(with_added_tokens=False).values()
        self.packed = {number: struct.pack("<I", number) for number in known}
        self.pieces = _Kept(self.encode_piece, KNOWN_PIECES)
        self.rests = _Kept(self.encode_pieces, KNOWN_RESTS)
        self.words = _Kept(self.encode_word, KNOWN_WORDS)

    def encode_piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return b"".join([self.packed[token.id] for token in found])

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode_word(self, word: str) -> bytes:
        """Ids of a word led by a space; letters alone need no pattern."""
        if word.isascii() and word.isalpha():
            return b"".join([self.packed[token.id] for token in self.model.tokenize(self.letters[0x20] + word)])
        letters = self.leading(word)
        if letters is None:
            return self.encode_pieces(" " + word)
        end = letters.end()
        if end == len(word):
            return self.encode_piece(" " + word)
        return self.words[word[:end]] + self.rests[word[end:]]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if _SPACES.search(text):
            return self.encode_pieces(text)
        first, *others = text.split(" ")
        return self.encode_pieces(first) + b"".join(map(self.words.__getitem__, others))


class TextEncoder(PieceEncoder):
    """A PieceEncoder that recognises the file's added tokens inside texts, as the library does.

    The text between added tokens is encoded on its own. Added tokens that strip blanks, stand
    as single words only or match normalised text are left to the library's whole-text call.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        listed = self.library.get_added_tokens_decoder()
        self.added = {token.content: struct.pack("<I", number) for number, token in listed.items() if token.content}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in listed.values())
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest_first))})")

    def encode(self, text: str) -> bytes:
        if not any(content in text for content in self.added):
            return super().encode(text)
        if not self.plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        between = super().encode
        return b"".join(
            self.added[part] if k % 2 else between(part) for k, part in enumerate(self.marks.split(text))
        )

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each of some texts without nulls, as `encode` gives them.

        Every different word of the texts is looked up once, and Arrow puts the ids in place.
        Long texts, and those with added tokens or with white space behind a space, go through
        `encode`.
        """
        apart = pc.binary_length(texts).to_numpy(zero_copy_only=False) > TOGETHER_BYTES
        for content in self.added:
            apart |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        rows, lines = np.flatnonzero(~apart), [b""] * len(texts)
        if len(rows):
            split = pc.split_pattern(texts.take(pa.array(rows)), " ")
            edges = split.offsets.to_numpy()
            coded = split.values.dictionary_encode()
            words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
            first = edges[:-1]  # no text is without a word, an empty one has an empty word
            heads = [self.encode_pieces(words[k]) for k in numbers[first]]
            numbers[first] = len(words) + np.arange(len(first))
            blank = np.array([not w or w[0].isspace() for w in words] + [False] * len(heads))
            ids = [b"" if none else self.words[w] for w, none in zip(words, blank.tolist(), strict=False)]
            placed = pa.array(ids + heads, pa.large_binary()).take(pa.array(numbers))
            starts = np.frombuffer(placed.buffers()[1], np.int64)[edges].tolist()
            data = memoryview(placed.buffers()[2] or b"")
            for row, a, b in zip(rows.tolist(), starts, starts[1:], strict=False):
                lines[row] = bytes(data[a:b])
            apart[rows] = np.logical_or.reduceat(blank[numbers], first)
        for row in np.flatnonzero(apart).tolist():
            lines[row] = self.encode(texts[row].as_py())
        return lines


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches of ids and texts where the texts come to TOGETHER_BYTES."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER_BYTES)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


@cache
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialized id arrays; empty where the samples are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def fit_dictionary(docs: DataFrame, count: int, path: str, tokenizer: str = TOKENIZER) -> bytes:
    """Train on a bounded sample, the documents whose ids hash smallest of `count`, and write
    the dictionary with its hash below `path`; returns it."""
    spark = docs.sparkSession
    docs = docs.where(drawn(SAMPLE_DOCS / max(1, count), "id", "mark"))

    def train(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("draw").to_numpy(), kind="stable")
        texts = group.column("text").take(pa.array(order))
        samples = [encoder(tokenizer).encode(t.as_py()) for t in texts]
        return pa.table([pa.array([train_dictionary([s for s in samples if s])], pa.binary())], ["dictionary"])

    begun = F.left("text", F.lit(SAMPLE_CHARS)).alias("text")  # before the texts move
    sampled = docs.select(draw_of("id", "mark").alias("draw"), begun, F.lit(0).alias("all"))
    found = sampled.groupBy("all").applyInArrow(train, "dictionary binary").collect()
    raw = bytes(found[0]["dictionary"]) if found else b""
    spark.createDataFrame(
        [(hashlib.sha256(raw).hexdigest(), bytearray(raw))], "hash string, dictionary binary"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    return raw


def write_token_files(
    df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text",
    tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES,
    shard_id_bytes: int = SHARD_ID_BYTES,
) -> None:
    """Encode whole texts and write them below `path` in ascending order of their ids.

    A shard holds the frames of consecutive documents, one zstandard frame each under the
    shared dictionary, beside an index: ids, offsets (one more than documents), token
    counts, and the dictionary's hash. Shards are rows of Parquet files, which Spark commits
    to any store; reading the index leaves the payloads alone. A shard is bounded in the bytes
    of its frames and of the ids they hold, as repetitive texts shrink a thousandfold. Texts are dealt into ranges
    of ids once, as text; each task encodes its range in order. Added tokens of the tokenizer's
    file inside a text get their own ids. Null texts count as empty, and every document ends with
    `end_id`. Null ids come first; rows of one id are ordered
    by a hash of their text. An empty table writes no shard.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(
        long_id(df, id_column).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    raw = fit_dictionary(docs, size["n"], path, tokenizer)
    name = hashlib.sha256(raw).hexdigest()
    end = np.array([end_id], "<u4").tobytes()
    parts = partitions_for(spark, size["bytes"] or 0, 64 << 20)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        part = TaskContext.get().partitionId()
        number, held, ids, counts, size, plain = 0, [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, held)]).tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([name]),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([sum(counts)], pa.int64()),
                    pa.array([b"".join(held)], pa.binary()),
                ],
                ["part", "shard", "dictionary", "ids", "offsets", "counts", "n_tokens", "payload"],
            )

        for batch in _together(batches):
            for own, line in zip(batch.column(0).to_pylist(), made.encode_all(batch.column(1)), strict=True):
                frame = press.compress(line + end)
                held.append(frame)
                ids.append(own)
                counts.append(len(line) // 4 + 1)
                size, plain = size + len(frame), plain + len(line)
                if size >= shard_bytes or plain >= shard_id_bytes:
                    yield shard()
                    number, held, ids, counts, size, plain = number + 1, [], [], [], 0, 0
        if held:
            yield shard()

    ordered = docs.repartitionByRange(parts, "id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    ordered.mapInArrow(
        pack,
        "part long, shard long, dictionary string, ids array<long>, offsets array<long>, counts array<long>, "
        "n_tokens long, payload binary",
    ).write.parquet(f"{path}/shards")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """First token of each shard: part, shard, first_token. Parts are summed first, so one
    window runs over the parts only."""
    sizes = spark.read.parquet(f"{path}/shards").select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return sized_join(placed, parts, ["part"]).select(
        "part", "shard", (F.col("part_start") + F.col("inside")).alias("first_token")
    )


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary below `path`, checked against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return raw


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files: id, start, n_tokens and `ids` (binary, little-endian
    unsigned 32-bit). Raises where a shard names another dictionary."""
    ship_package(spark)
    raw = read_dictionary(spark, path)
    name = hashlib.sha256(raw).hexdigest()

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for part, shard, used, ids, offsets, counts, payload in zip(*batch.columns, strict=True):
                if used.as_py() != name:
                    raise ValueError("a shard was written under another dictionary")
                block = memoryview(payload.as_buffer())
                edges, sizes = offsets.as_py(), counts.as_py()
                lines = [press.decompress(block[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                inside = np.cumsum([0, *sizes])[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(lines), pa.int64()), pa.array([shard.as_py()] * len(lines), pa.int64()),
                        ids.values, pa.array(inside, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lines, pa.binary()),
                    ],
                    ["part", "shard", "id", "inside", "n_tokens", "ids"],
                )

    shards = spark.read.parquet(f"{path}/shards").select(
        "part", "shard", "dictionary", "ids", "offsets", "counts", "payload"
    )
    docs = shards.mapInArrow(unpack, "part long, shard long, id long, inside long, n_tokens long, ids binary")
    return sized_join(docs, shard_starts(spark, path), ["part", "shard"], small=True).select(
        "id", (F.col("first_token") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Only the documents whose id is in `wanted` (column id): id and ids, as above.

    The index names their shards and offsets; of those shards the frames alone are cut out
    and decompressed.
    """
    ship_package(spark)
    raw = read_dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    index = shards.select("part", "shard", "offsets", F.posexplode("ids").alias("at", "id"))
    index = sized_join(index, wanted.select("id").distinct(), ["id"], "left_semi")
    places = index.select(
        "part", "shard", "id", F.col("offsets")[F.col("at")].alias("first"), F.col("offsets")[F.col("at") + 1].alias("last")
    )
    found = sized_join(places, shards.select("part", "shard", "payload"), ["part", "shard"], small=False)
    frames = found.select("id", F.expr("substring(payload, int(first + 1), int(last - first))").alias("frame"))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            lines = [press.decompress(frame.as_py()) for frame in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.binary())], ["id", "ids"])

    return frames.mapInArrow(unpack, "id long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {"op4_token_files": op4_token_files}
ORACLE: dict[str, str] = {}
