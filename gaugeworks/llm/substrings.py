"""Substring dedup: Rabin-Karp hashes of every token window, counted across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import (
    encoded, long_id, partitions_for, pieces, ship_package, table, text_bytes,
)

WINDOW = 13
#: Text of one chunk of documents, and window hashes of one counting bucket: both grow with
#: the corpus up to what a task holds with ease, so that their product, the number of blobs
#: shuffled, stays far below the number of windows.
CHUNK_BYTES = (4 << 20, 32 << 20)
BUCKET_WINDOWS = (1 << 21, 1 << 22)
#: Bases of the two window hashes, odd, so that they have inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_KNOWN_WORDS = 1 << 18
_NO_ID = -(1 << 63)

#: Hashes of all windows from a text's word numbers and the window's length.
Hash = Callable[[np.ndarray, int], np.ndarray]

_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("text", T.StringType()),
    T.StructField("kept_sha256", T.StringType()),
])


class _Digits(dict):
    """XXH64 of words; frequent ones are looked up, and only so many are held."""

    def __missing__(self, word: bytes) -> int:
        digit = xxhash.xxh64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = digit
        return digit


_DIGITS = _Digits()


def word_digits(text: str | None) -> np.ndarray:
    """A 64-bit number for each word of a text, null as empty."""
    parts = [np.empty(0, np.uint64)]
    for piece in pieces(encoded(text)):
        words = piece.split()
        parts.append(np.fromiter(map(_DIGITS.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of a base, computed once in a process."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads values evenly, so that their order can deal them out."""
    values = (values ^ (values >> np.uint64(33))) * _MIX
    return values ^ (values >> np.uint64(29))


def window_hashes(digits: np.ndarray, window: int = WINDOW, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every run of `window` words, modulo 2**64, by one of two polynomials.

    The digits are the words' numbers, for the second polynomial mixed once more. Prefix sums
    give each window in one subtraction; the factor base**start is divided out.
    """
    n = len(digits) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[which]
    if which:
        digits = _mixed(digits ^ np.uint64(base))
    out = np.empty(n, np.uint64)
    step = 1 << 16  # so that the powers stay a short table
    up, down = _powers(base, step + window), _powers(_INVERSES[which], step)
    for start in range(0, n, step):
        part = digits[start : min(start + step, n) + window - 1]
        sums = np.r_[np.uint64(0), np.add.accumulate(part * up[: len(part)])]
        count = len(part) - window + 1
        out[start : start + count] = (sums[window:] - sums[:count]) * down[:count]
    return _mixed(out)


def covered_words(flags: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Words covered by the flagged windows of a document."""
    edges = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(flags)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.cumsum(edges)[:n_words] > 0


def intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered words as start and end (exclusive) positions."""
    edges = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class _Chunk:
    """Windows of a chunk of documents, in the order of ids.

    `codes` has for each window its counting bucket, from the upper half of the first hash,
    above that hash's lower half.
    """

    def __init__(
        self, docs: pa.Table, window: int, buckets: int, first: Hash = window_hashes, second: Hash | None = None
    ) -> None:
        ids = docs.column("id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order].astype(np.int64)
        self.texts = docs.column("text").combine_chunks() if docs.num_rows else docs.column("text")
        self.window, self.second = window, second or partial(window_hashes, which=1)
        self.digits = [word_digits(self.text(i)) for i in range(len(ids))]
        half = np.uint64(32)

        def coded(hashes: np.ndarray) -> np.ndarray:
            return (hashes >> half) * np.uint64(buckets) >> half << half | hashes & np.uint64(0xFFFFFFFF)

        codes = [coded(first(d, window)) for d in self.digits]
        sizes = np.array([len(c) for c in codes], np.int64)
        self.codes = np.concatenate([*codes, np.empty(0, np.uint64)])
        self.of_window = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def text(self, i: int) -> str | None:
        return self.texts[int(self.order[i])].as_py()

    def seconds(self, where: np.ndarray) -> np.ndarray:
        """Second hashes of the windows at these positions, in rising order."""
        out = np.empty(len(where), np.uint64)
        edges = np.searchsorted(where, np.r_[self.starts, self.ends[-1:]])
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            out[part] = self.second(self.digits[i], self.window)[where[part] - self.starts[i]]
        return out


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(32)).astype(np.int64)


def _low(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint32)


def _rows(key: np.ndarray, names: Sequence[str], columns: Sequence[np.ndarray], **fixed: int) -> pa.Table:
    """One row per run of equal keys, with the bytes of its part of each column."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(key)] if len(cuts) else cuts
    arrays = [pa.array(key[cuts], pa.int64())]
    arrays += [pa.array([value] * len(cuts), pa.int64()) for value in fixed.values()]
    for column in columns:
        arrays.append(pa.array([column[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()))
    return pa.table(arrays, [names[0], *fixed, *names[1:]])


def _column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in table.column(name)]


def _groups(ordered: Sequence[np.ndarray]) -> np.ndarray:
    """Number of the group of equal rows that each row of sorted columns belongs to."""
    if not len(ordered[0]):
        return np.empty(0, np.int64)
    differs = np.any([c[1:] != c[:-1] for c in ordered], axis=0)
    return np.r_[0, np.cumsum(differs)]


def _firsts(group: np.ndarray) -> np.ndarray:
    """The first row of each group."""
    return np.flatnonzero(np.r_[True, np.diff(group) > 0]) if len(group) else np.empty(0, np.int64)


def _counted(chunk: _Chunk, number: int) -> pa.Table:
    """The chunk's distinct half hashes, rising, for each bucket."""
    codes = np.unique(chunk.codes)
    return _rows(_bucket(codes), ["bucket", "halves"], [_low(codes)], chunk=number)


def _shared(blobs: pa.Table) -> pa.Table:
    """For each chunk, a bit for each of its half hashes in the bucket: does another have it?"""
    halves = _column(blobs, "halves", np.uint32)
    sizes = [len(h) for h in halves]
    merged = np.concatenate(halves)
    order = np.argsort(merged, kind="stable")
    ordered = merged[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(merged), bool)
    flags[order] = np.r_[False, same] | np.r_[same, False]
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    keep = [i for i, part in enumerate(parts) if part.any()]
    return pa.table(
        [
            blobs.column("chunk").combine_chunks().take(pa.array(keep, pa.int64())),
            blobs.column("bucket").combine_chunks().take(pa.array(keep, pa.int64())),
            pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary()),
        ],
        ["chunk", "bucket", "shared"],
    )


def _confirmed(chunk: _Chunk, shared: pa.Table, number: int) -> pa.Table:
    """Half hashes and second hashes of the windows that are shared by the first, once per
    pair, in the order of the smallest document that has it: its id and number of pairs."""
    rank = np.argsort(chunk.codes, kind="stable")
    ordered = chunk.codes[rank]
    starts = _firsts(_groups((ordered,)))
    buckets = _bucket(ordered[starts])
    asked = np.zeros(len(starts), bool)
    for bucket, bits in zip(shared.column("bucket"), _column(shared, "shared", np.uint8), strict=True):
        a, b = np.searchsorted(buckets, [bucket.as_py(), bucket.as_py() + 1])
        asked[a:b] = np.unpackbits(bits, count=b - a)
    where = np.sort(rank[np.repeat(asked, np.diff(np.r_[starts, len(ordered)]))])
    del rank, ordered, starts, buckets, asked
    one, two, owner = chunk.codes[where], chunk.seconds(where), chunk.ids[chunk.of_window[where]]
    order = np.lexsort((owner, two, one))
    order = order[_firsts(_groups((one[order], two[order])))]
    order = order[np.lexsort((owner[order], _bucket(one[order])))]
    one, two, owner = one[order], two[order], owner[order]
    # Runs of an owner within a bucket: its id once, and how many pairs follow.
    bucket = _bucket(one)
    starts = _firsts(_groups((bucket, owner)))
    counts = np.diff(np.r_[starts, len(one)]).astype(np.uint32)
    pairs = _rows(bucket, ["bucket", "low", "two"], [_low(one), two], chunk=number)
    runs = _rows(bucket[starts], ["bucket", "owners", "counts"], [owner[starts], counts])
    return pairs.append_column("owners", runs.column("owners")).append_column("counts", runs.column("counts"))


def _seen_before(blobs: pa.Table) -> pa.Table:
    """For each chunk, the bucket's pairs that start in an earlier document of another chunk."""
    lows = _column(blobs, "low", np.uint32)
    of_blob = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    low, two = np.concatenate(lows), np.concatenate(_column(blobs, "two", np.uint64))
    owner = np.repeat(
        np.concatenate(_column(blobs, "owners", np.int64)), np.concatenate(_column(blobs, "counts", np.uint32))
    )
    order = np.lexsort((owner, two, low))
    group = _groups((low[order], two[order]))
    later = order[owner[order] > owner[order][_firsts(group)][group]]
    later = later[np.argsort(of_blob[later], kind="stable")]
    number = blobs.column("chunk").to_numpy()[of_blob[later]]
    return _rows(number, ["chunk", "low", "two"], [low[later], two[later]], bucket=blobs.column("bucket")[0].as_py())


def _repeated(chunk: _Chunk, replies: pa.Table) -> np.ndarray:
    """Windows that start in an earlier document, of this chunk or by the replies."""
    codes, seconds = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for bucket, low, two in zip(
        replies.column("bucket"), _column(replies, "low", np.uint32), _column(replies, "two", np.uint64), strict=True
    ):
        codes.append(np.uint64(bucket.as_py()) << np.uint64(32) | low.astype(np.uint64))
        seconds.append(two)
    seen = [np.concatenate(codes), np.concatenate(seconds)]
    out = np.zeros(len(chunk.codes), bool)
    # Only windows whose code occurs twice here, or is in the replies, need the second hash.
    rank = np.argsort(chunk.codes, kind="stable")
    ordered = chunk.codes[rank]
    same = ordered[1:] == ordered[:-1]
    asked = np.r_[False, same] | np.r_[same, False] if len(ordered) else np.zeros(0, bool)
    at = np.searchsorted(ordered, seen[0])  # the others of that code are asked for as well
    at = at[at < len(ordered)]
    asked[at] = True
    where = np.sort(rank[asked])
    del rank, ordered, same, asked
    one = np.r_[chunk.codes[where], seen[0]]
    two = np.r_[chunk.seconds(where), seen[1]]
    owner = np.r_[chunk.ids[chunk.of_window[where]], np.full(len(seen[0]), _NO_ID)]
    foreign = np.r_[np.zeros(len(where), bool), np.ones(len(seen[0]), bool)]
    order = np.lexsort((owner, ~foreign, two, one))
    group = _groups((one[order], two[order]))
    if not len(group):
        return out
    lead = order[_firsts(group)][group]  # the reply, or else the smallest document
    earlier = ~foreign[order] & (foreign[lead] | (owner[order] > owner[lead]))
    out[where[order[earlier]]] = True
    return out


def _kept(text: str | None, covered: np.ndarray) -> Iterator[bytes]:
    """The words that are not covered, joined by one space, a piece of the text at a time."""
    at, between = 0, b""
    for piece in pieces(encoded(text)):
        words = piece.split()
        gone = covered[at : at + len(words)]
        at += len(words)
        if gone.any():
            edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8))).tolist()
            words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
        if words:
            yield between + b" ".join(words)
            between = b" "


def _cleaned(chunk: _Chunk, docs: pa.Table, replies: pa.Table) -> pa.Table:
    """Apply the replies of all buckets, and the chunk's own repeats, to its documents."""
    repeated = _repeated(chunk, replies)
    out: list[tuple] = []
    for i, (start, end) in enumerate(zip(chunk.starts, chunk.ends, strict=True)):
        text, n_words = chunk.text(i), len(chunk.digits[i])
        covered = covered_words(repeated[start:end], n_words, chunk.window)
        starts, ends = intervals(covered)
        digest, parts = hashlib.sha256(), []
        for part in _kept(text, covered):
            digest.update(part)
            if len(starts):
                parts.append(part)
        own = int(chunk.ids[i])
        out.append((
            None if own == _NO_ID else own, n_words, int(covered.sum()),
            starts.astype(np.int32).tolist(), ends.astype(np.int32).tolist(),
            b"".join(parts).decode("utf-8", "replace") if len(starts) else text, digest.hexdigest(),
        ))
    columns = list(zip(*out, strict=True)) or [()] * 7
    kinds = [
        pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string(),
    ]
    carried = docs.column_names[3:]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    arrays += [docs.column(name).take(pa.array(chunk.order)) for name in carried]
    return pa.table(arrays, [*_SCHEMA.names, *carried])


def chunk_of(own: Column, text: Column, chunks: int) -> Column:
    """The chunk a row is dealt to: rows without an id, or of one id, spread by their texts."""
    return F.pmod(F.xxhash64(own, text), F.lit(chunks))


def _between(bounds: tuple[int, int], wanted: int) -> int:
    return max(bounds[0], min(bounds[1], wanted))


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
    chunk_bytes: int | None = None, bucket_windows: int | None = None,
    carry: Sequence[str] = (), first: Hash = window_hashes, second: Hash | None = None,
) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Returns id, n_words, n_removed, the removed intervals of word positions (starts, ends;
    maximal, end exclusive), `text` (unchanged where nothing is removed, else the kept words
    joined by one space) and the kept words' kept_sha256; one row per input row.

    Documents are dealt into chunks by id and text. Each chunk hashes every window of its
    whole texts and sends half of each distinct hash to counting buckets; a passage that a
    third of all documents share is one entry per chunk there. Buckets answer with a bit per
    entry: whether other chunks have it too, which some thousandth seem to have only by
    chance. For these few the chunks send a second, independent hash with the smallest
    document, and are told which of them start earlier elsewhere; then they mark their
    windows. So windows count as equal if 96 bits agree, besides those that name the bucket,
    and a collision of the first hash costs an entry, not a document's words. The documents
    are shuffled once and read three times. `first` and `second` are the hash functions.

    Null and empty texts have no words. Rows with a null id count as smaller than every
    other and not smaller than one another; equal ids likewise do not remove from one
    another. An empty table gives an empty one. Of other columns those named in `carry`
    come along, as carried_0, carried_1 and so on.
    """
    spark = df.sparkSession
    ship_package(spark)
    total = text_bytes(df, f"`{text}`")
    chunk_bytes = chunk_bytes or _between(CHUNK_BYTES, total >> 8)
    bucket_windows = bucket_windows or _between(BUCKET_WINDOWS, total >> 12)
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total // (6 * bucket_windows)))  # at least six bytes a word, about
    own = F.coalesce(long_id(df, id_column), F.lit(_NO_ID).cast("long"))
    along = [F.col(f"`{name}`").alias(f"carried_{i}") for i, name in enumerate(carry)]
    docs = df.select(
        own.alias("id"), F.col(f"`{text}`").alias("text"),
        chunk_of(own, F.col(f"`{text}`"), chunks).alias("chunk"), *along,
    )
    schema = T.StructType([
        *_SCHEMA.fields,
        *(T.StructField(f"carried_{i}", df.schema[name].dataType) for i, name in enumerate(carry)),
    ])
    docs = docs.repartition(partitions_for(spark, total, 4 * chunk_bytes), "chunk")
    by_bucket = partitions_for(spark, total)  # four bytes a window

    def chunk_for(group: pa.Table) -> _Chunk:
        return _Chunk(group, window, buckets, first, second)

    def counted(group: pa.Table) -> pa.Table:
        return _counted(chunk_for(group), group.column("chunk")[0].as_py())

    def confirmed(group: pa.Table, shared: pa.Table) -> pa.Table:
        return _confirmed(chunk_for(group), shared, group.column("chunk")[0].as_py() if group.num_rows else 0)

    def cleaned(group: pa.Table, replies: pa.Table) -> pa.Table:
        return _cleaned(chunk_for(group), group, replies)

    blobs = docs.groupBy("chunk").applyInArrow(counted, "bucket long, chunk long, halves binary")
    shared = blobs.repartition(by_bucket, "bucket").groupBy("bucket").applyInArrow(
        _shared, "chunk long, bucket long, shared binary"
    )
    pairs = docs.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        confirmed, "bucket long, chunk long, low binary, two binary, owners binary, counts binary"
    )
    replies = pairs.groupBy("bucket").applyInArrow(_seen_before, "chunk long, bucket long, low binary, two binary")
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cleaned, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256"
    )


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace texts by what substring dedup leaves of them, and n_chars if it is there; all
    documents and other columns stay."""
    carry = [name for name in docs.columns if name not in ("text", "n_chars")]
    cleaned = remove_repeats(docs, carry=carry)
    named = {name: F.col(f"carried_{i}") for i, name in enumerate(carry)}
    named["text"] = F.col("text")
    if "n_chars" in docs.columns:
        named["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select([named[name].alias(name) for name in docs.columns])


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {
    "op5_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13
), hashed AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM hashed GROUP BY h
), repeats AS (
  SELECT doc_id, i FROM hashed JOIN firsts USING (h) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeats, range(13) AS t(k)
), gone_lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(gone, x)), lambda x: words[x]) END AS kept
  FROM w LEFT JOIN gone_lists ON w.doc_id = gone_lists.doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept""",
}
