"""Byte-level BPE by rank files: chunks pre-tokenised in parallel and stitched; decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import long_id, ship_package, slices, table
from gaugeworks.session import settle

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points of one chunk, and how far it reads into the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: A match that ends this close to the end of a chunk's text may end elsewhere in the whole
#: text: the pattern looks one code point past a match, and an apostrophe may take two more.
MARGIN = 4


class Bpe:
    """A rank file with its pre-token pattern."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        # White space as Unicode names it, which the rank files' own library matches too.
        space = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(space)

    def ends(self, text: str, start: int = 0) -> np.ndarray:
        """Where pre-tokens end, scanning from `start`, which begins one."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text, start)), np.int64)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins and ends at pre-token boundaries."""
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


class EncodedChunk:
    """A chunk's ids, with the boundaries near both of its ends where it may be cut.

    `at` are positions in the whole text, `before` the number of ids before each.
    """

    def __init__(self, offset: int, ids: np.ndarray, at: np.ndarray, before: np.ndarray) -> None:
        self.offset, self.ids, self.at, self.before = offset, ids, at, before


def encode_chunk(bpe: Bpe, text: str, offset: int, last: bool, chunk: int, overlap: int) -> EncodedChunk:
    """Encode one chunk with its overlap; its first pre-tokens and its last may be wrong.

    It is cut only behind pre-tokens that end in no white space: what ends there matches
    alike with and without the text that follows, while the end of a text draws the white
    space before it together. A chunk without neighbours needs no boundary inside.
    """
    if last and offset == 0:
        ids = np.array(bpe.encode(text), np.int32)
        return EncodedChunk(0, ids, np.array([0, len(text)], np.int64), np.array([0, len(ids)], np.int64))
    ends = bpe.ends(text)
    if not last:
        ends = ends[ends <= len(text) - MARGIN]
    near = (ends <= overlap) | (ends >= chunk)
    if len(ends) and not near[-1]:
        near |= ends >= ends[-1] - overlap
    ends = ends[near]
    solid = np.array([not text[e - 1].isspace() for e in ends.tolist()], bool)
    keep = np.r_[0, ends[solid]].astype(np.int64)
    if last and keep[-1] != len(text):
        keep = np.r_[keep, len(text)]
    ids: list[int] = []
    before = [0]
    for a, b in zip(keep[:-1].tolist(), keep[1:].tolist(), strict=True):
        ids.extend(bpe.encode(text[a:b]))
        before.append(len(ids))
    return EncodedChunk(offset, np.array(ids, np.int32), keep + offset, np.array(before, np.int64))


def stitch(bpe: Bpe, chunks: list[EncodedChunk], texts: list[str], chunk: int) -> np.ndarray:
    """Join a document's chunks at the first boundary that both neighbours have.

    Matching depends only on what follows, so from a common boundary on both would match
    alike; the earlier chunk's boundaries hold by induction. Where the overlap has none, a
    run without boundaries is longer than it: the text is scanned on from the last boundary
    that holds until a later chunk has the same one.
    """
    parts: list[np.ndarray] = []
    current, entered = 0, 0  # chunk number, and the index of the boundary it is entered at
    while True:
        here = chunks[current]
        if current == len(chunks) - 1:
            parts.append(here.ids[here.before[entered] :])
            return np.concatenate(parts)
        following = chunks[current + 1]
        common = np.intersect1d(here.at[entered:], following.at)
        if len(common):
            cut = int(np.searchsorted(here.at, common[0]))
            parts.append(here.ids[here.before[entered] : here.before[cut]])
            current, entered = current + 1, int(np.searchsorted(following.at, common[0]))
            continue
        parts.append(here.ids[here.before[entered] :])
        known = int(here.at[-1])
        whole = "".join([t[:chunk] for t in texts[:-1]] + [texts[-1]])
        later = {int(p): (i, k) for i in range(len(chunks) - 1, current, -1) for k, p in enumerate(chunks[i].at)}
        ends = bpe.ends(whole, known).tolist()
        met = next((e for e in ends if e in later and not whole[e - 1].isspace()), len(whole))
        parts.append(np.array(bpe.encode(whole[known:met]), np.int32))
        if met not in later:
            return np.concatenate(parts)
        current, entered = later[met]


def encode_documents(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", ranks: str = RANKS,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Ids of whole texts: columns id and ids (array<int>), one row per input row.

    Texts are cut into overlapping chunks, and their encoded chunks are stitched. A text of one
    chunk has nothing to stitch and is encoded where it lies; the chunks of others go to any
    task and meet again per document. Null and empty texts have no ids. Long rows that repeat
    an id and text are encoded once and returned as often; a null id stays null. An empty table gives an empty one. Other
    columns are left out. `ranks` is a file that every worker has.
    """
    ship_package(df.sparkSession)
    narrow = df.select(long_id(df, id_column).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    short = narrow.where(F.length("text") <= chunk)
    long = narrow.where(F.length("text") > chunk).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in slices(batches):
            ids = [encode_chunk(bpe, t, 0, True, chunk, overlap).ids for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"]
            )

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in slices(batches, 16):
            rows = []
            for row in batch.to_pylist():
                last = row["number"] == row["chunks"] - 1
                done = encode_chunk(bpe, row["text"], row["number"] * chunk, last, chunk, overlap)
                rows.append((row["id"], row["digest"], row["copies"], row["number"], row["text"], done.ids, done.at, done.before))
            kinds = [
                pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()),
                pa.list_(pa.int64()), pa.list_(pa.int64()),
            ]
            names = ["id", "digest", "copies", "number", "text", "ids", "at", "before"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

    def joined(group: pa.Table) -> pa.Table:
        bpe = load(ranks)
        rows = sorted(group.to_pylist(), key=lambda row: row["number"])
        chunks = [
            EncodedChunk(r["number"] * chunk, np.array(r["ids"], np.int32), np.array(r["at"]), np.array(r["before"]))
            for r in rows
        ]
        ids = stitch(bpe, chunks, [r["text"] for r in rows], chunk)
        return pa.table(
            [
                pa.array([rows[0]["id"]], pa.int64()), pa.array([ids], pa.list_(pa.int32())),
                pa.array([rows[0]["copies"]], pa.int64()),
            ],
            ["id", "ids", "copies"],
        )

    numbered = long.withColumn("digest", F.sha2("text", 256)).withColumn(
        "chunks", F.ceil(F.length("text") / chunk)
    )
    cut = numbered.select(
        "id", "digest", "copies", "chunks", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("number")
    ).select(
        "id", "digest", "copies", "chunks", "number",
        F.expr(f"substring(text, int(number * {chunk} + 1), {chunk + overlap})").alias("text"),
    )
    encoded = cut.repartition("digest", "number").mapInArrow(
        pieces,
        "id long, digest string, copies long, number long, text string, ids array<int>, at array<long>, before array<long>",
    )
    stitched = encoded.groupBy("digest", "id").applyInArrow(joined, "id long, ids array<int>, copies long")
    # Copies are a number until here, and rows of their own only in the JVM.
    stitched = stitched.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("id", "ids")
    return short.mapInArrow(whole, "id long, ids array<int>").unionByName(stitched)


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Bytes of encoded documents: id, ids, n_tokens, ids_sha256 and `decoded` (binary).

    Decoding concatenates the raw bytes of the ids. Null ids count as none.
    """
    ship_package(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        decimals = list(map(str, range(len(bpe.bytes_of))))
        for batch in slices(batches):
            lists = [ids or [] for ids in batch.column(1).to_pylist()]
            lines = [" ".join(map(decimals.__getitem__, ids)).encode() for ids in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(map(len, lists), pa.int64()),
                    pa.array([hashlib.sha256(line).hexdigest() for line in lines], pa.string()),
                    pa.array(map(bpe.decode, lists), pa.binary()),
                ],
                ["id", "ids", "n_tokens", "ids_sha256", "decoded"],
            )

    return encoded.select("id", "ids").mapInArrow(
        run, "id long, ids array<int>, n_tokens long, ids_sha256 string, decoded binary"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return decoded.select(
        F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document and decode its ids: doc_id, n_tokens, ids and decoded_sha256.

    The ids are written in between, so that no task holds a coder of either kind at once.
    """
    return decode_documents(settle(encode_documents(docs))).select(
        F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE: dict[str, str] = {}
