"""SimHash near-duplicates: fingerprints, then bit-sliced comparison inside bands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import encoded, long_id, ship_package, slices, table
from gaugeworks.llm.graph import components
from gaugeworks.operators.joins import hot_buckets, sized_join
from gaugeworks.session import settle

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Rows of one hash bucket of bands above which its bands are cut finer.
HOT_BAND_ROWS = 200_000
#: Rows a task lays out as bit planes at a time; a larger band is laid out whole.
BLOCK_ROWS = 1 << 17
#: Bands up to this size are compared by shifted planes, larger ones member by member.
SMALL_BAND = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# Fingerprints


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of a text in lower case (A-Z only), repeats included."""
    words = encoded(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends.tolist()]
    hashed = map(
        xxhash.xxh64_intdigest,
        [line[a : b - 1] for a, b in zip(starts, starts[size:], strict=False)],
        [42] * (len(words) - size + 1),
    )
    return np.fromiter(hashed, np.uint64, len(words) - size + 1)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where more than half the shingle hashes have it set."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[start : start + (1 << 15)])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    majority = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprints(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE
) -> DataFrame:
    """One row per input row: the id and `fingerprint` as a long holding the 64 bits.

    Null and empty texts have fingerprint zero. Texts are read whole, one at a time.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks.view(np.int64))], ["id", "fingerprint"]
            )

    narrow = df.select(long_id(df, id_column).alias("id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "id long, fingerprint long")


# Bit-sliced comparison


def bit_planes(marks: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b holds bit b of all of them, 64 to a word."""
    padded = np.zeros(-(-len(marks) // 64) * 64, np.uint64)
    padded[: len(marks)] = marks
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(
    planes: np.ndarray, others: np.ndarray, valid: np.ndarray, radius: int
) -> np.ndarray:
    """Mask of the lanes in `valid` whose two fingerprints differ in at most `radius` bits.

    All lanes of a word are counted at once by carry-save addition: the planes of their
    differences go through a bitwise counter that starts so high that its top carry is set
    exactly when more than `radius` bits differ. Every eight planes, words with no lane
    left within the radius are abandoned. `others` may hold one word per plane, the same
    for all lanes.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    live = np.flatnonzero(valid)
    counters = [np.full(len(live), _ALL if start >> j & 1 else 0, np.uint64) for j in range(width)]
    over = np.zeros(len(live), np.uint64)
    alone = others.shape[1] == 1
    for first in range(0, BITS, 8):
        if not len(live):
            break
        left = planes[first : first + 8, live]
        right = others[first : first + 8] if alone else others[first : first + 8, live]
        for difference in left ^ right:
            carry = difference
            for j in range(width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
            over |= carry
        keep = (valid[live] & ~over) != 0
        if not keep.all():
            live, over = live[keep], over[keep]
            counters = [counter[keep] for counter in counters]
    found = np.zeros_like(valid)
    found[live] = valid[live] & ~over
    return found


def lanes(mask: np.ndarray) -> np.ndarray:
    """Positions of the set lanes of a mask."""
    words = np.flatnonzero(mask)
    bits = np.unpackbits(mask[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(bits)
    return words[word] * 64 + lane


def _mask(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which lane i holds what lane i + by held, for 0 < by < 64."""
    following = np.zeros_like(planes)
    following[..., :-1] = planes[..., 1:]
    return (planes >> np.uint64(by)) | (following << np.uint64(64 - by))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_small_bands(bands: np.ndarray, marks: np.ndarray, radius: int) -> np.ndarray:
    """Root position of every row, linking rows of equal band within the radius.

    Rows are ordered by band, and no band has more than SMALL_BAND rows: each row meets
    the d-th after it, for all rows at once, until no band is that long.
    """
    parent = np.arange(len(marks))
    planes = bit_planes(marks)
    for distance in range(1, min(SMALL_BAND, len(marks))):
        same = np.zeros(len(marks), bool)
        same[:-distance] = bands[:-distance] == bands[distance:]
        if not same.any():
            break
        found = within_radius(planes, _shifted(planes, distance), _mask(same), radius)
        for i in lanes(found).tolist():
            a, b = _root(parent, i), _root(parent, i + distance)
            parent[max(a, b)] = min(a, b)
    return np.array([_root(parent, i) for i in range(len(marks))], np.int64)


def link_large_band(marks: np.ndarray, radius: int) -> np.ndarray:
    """Root position of every row of one band; each row is compared with those not reached."""
    planes = bit_planes(marks)
    waiting = _mask(np.ones(len(marks), bool))
    roots = np.arange(len(marks))
    for seed in range(len(marks)):
        if not waiting[seed // 64] >> np.uint64(seed % 64) & np.uint64(1):
            continue
        waiting[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        reached = [seed]
        while reached:
            mark = int(marks[reached.pop()])
            query = np.array([[_ALL if mark >> b & 1 else 0] for b in range(BITS)], np.uint64)
            found = within_radius(planes, query, waiting, radius)
            waiting &= ~found
            new = lanes(found)
            roots[new] = seed
            reached.extend(new.tolist())
    return roots


def band_links(bands: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that span each band's linked fingerprints; rows are in band order."""
    starts = np.flatnonzero(np.r_[True, bands[1:] != bands[:-1]])
    sizes = np.diff(np.r_[starts, len(bands)])
    of_row = np.repeat(sizes, sizes)
    roots, members = [], []
    small = np.flatnonzero((of_row > 1) & (of_row <= SMALL_BAND))
    if len(small):
        found = link_small_bands(bands[small], marks[small], radius)
        moved = found != np.arange(len(small))
        roots.append(marks[small][found[moved]])
        members.append(marks[small][moved])
    for start, size in zip(starts[sizes > SMALL_BAND], sizes[sizes > SMALL_BAND], strict=True):
        own = marks[start : start + size]
        found = link_large_band(own, radius)
        moved = found != np.arange(size)
        roots.append(own[found[moved]])
        members.append(own[moved])
    if not roots:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(roots), np.concatenate(members)


# Candidates in Spark


def band_masks(radius: int) -> list[tuple[int, list[int]]]:
    """Masks of which two fingerprints within the radius agree on at least one.

    The 64 bits are cut into radius + 2 blocks; two of them at least hold no difference,
    so every pair of blocks makes a mask. With each come finer masks: its free bits are cut
    into radius + 1 parts, one of which holds no difference either.
    """
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    masks = []
    for i, j in combinations(range(blocks), 2):
        mask = whole[i] | whole[j]
        free = [b for b in range(BITS) if not mask >> b & 1]
        edges = [len(free) * k // (radius + 1) for k in range(radius + 2)]
        finer = [
            mask | sum(1 << b for b in free[edges[k] : edges[k + 1]]) for k in range(radius + 1)
        ]
        masks.append((mask, finer))
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _banded(marks: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """A row per fingerprint and (number, mask): columns band_no, band, mark."""
    bands = F.array(*[
        F.struct(F.lit(no).alias("band_no"), F.col("mark").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("band"))
        for no, mask in masks
    ])
    return marks.select("mark", F.explode(bands).alias("b")).select("b.band_no", "b.band", "mark")


def fingerprint_links(marks: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_BAND_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of `mark` within the radius.

    Fingerprints that agree on a mask form a band; within each, bit-sliced comparison finds
    all that are close, and links to one root per linked set are returned, never all pairs.
    Bands in hash buckets of over `hot_rows` rows are replaced by their finer masks, so what
    meets in one task has about a third of 32 bits fixed more: it cannot exceed 2**22
    distinct fingerprints at radius 2, whatever the table's size.
    """
    ship_package(marks.sparkSession)
    masks = band_masks(radius)
    finer_count = radius + 1
    coarse = _banded(marks, [(no, mask) for no, (mask, _) in enumerate(masks)])
    hot = hot_buckets(coarse, ["band_no", "band"], hot_rows)
    if hot.rows:
        finer = [
            (len(masks) + no * finer_count + k, mask)
            for no, (_, parts) in enumerate(masks)
            for k, mask in enumerate(parts)
        ]
        crowded = coarse.where(hot.holds()).select("band_no", "mark")
        parts = _banded(crowded.select("mark").distinct(), finer)
        owner = F.floor((F.col("band_no") - len(masks)) / finer_count).cast("int")
        kept = crowded.select(F.col("band_no").alias("owner"), "mark").distinct()
        parts = parts.withColumn("owner", owner).join(kept, ["owner", "mark"], "left_semi")
        bands = coarse.where(~hot.holds()).unionByName(parts.select("band_no", "band", "mark"))
    else:
        bands = coarse

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def linked(block: np.ndarray) -> pa.RecordBatch:
            change = np.any(block[1:, :2] != block[:-1, :2], axis=1)
            bands = np.r_[0, np.cumsum(change)]
            roots, members = band_links(bands, block[:, 2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(roots.view(np.int64)), pa.array(members.view(np.int64))], ["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64))
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            block = np.ascontiguousarray(np.concatenate(held))
            last = np.any(block[:, :2] != block[-1, :2], axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last band may go on
            if cut:
                yield linked(block[:cut])
            held, rows = [block[cut:]], len(block) - cut
        if rows:
            yield linked(np.ascontiguousarray(np.concatenate(held)))

    ordered = bands.select(F.col("band_no").cast("long"), "band", "mark").repartition(
        "band_no", "band"
    ).sortWithinPartitions("band_no", "band", "mark")
    return ordered.mapInArrow(run, "a long, b long")


def simhash_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE,
    radius: int = RADIUS, hot_rows: int = HOT_BAND_ROWS,
) -> DataFrame:
    """Near-duplicate groups: id, fingerprint (long), component_id and component, one row per
    input row.

    Fingerprints that differ in at most `radius` bits are linked, and component_id is the
    smallest id reachable by links, the row's own included; component, a fingerprint of the
    group, tells groups apart that share an id. Equal fingerprints are one node,
    so copies never meet in pairs. Null and empty texts have fingerprint zero and are linked
    like any other; rows with a null id belong to their group without naming it, and
    component_id is null where no row of a group has an id. Repeated rows give repeated
    rows. An empty table gives an empty one. Other columns are left out.
    """
    marked = settle(fingerprints(df, id_column, text, size))
    nodes = marked.groupBy(F.col("fingerprint").alias("mark")).agg(F.min("id").alias("least"))
    nodes = settle(nodes)
    joined = components(fingerprint_links(nodes.select("mark"), radius, hot_rows), "a", "b")
    joined = settle(joined)
    grouped = sized_join(nodes, joined.withColumnRenamed("node", "mark"), ["mark"], "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "mark"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = sized_join(grouped, named, ["component"]).select(
        F.col("mark").alias("fingerprint"), "component_id", "component"
    )
    return sized_join(marked, settle(nodes), ["fingerprint"]).select(
        "id", "fingerprint", "component_id", "component"
    )


# Query and stage


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group: the one with the group's smallest id.

    Groups are those of texts, so rows of one id with unlike texts belong to several groups,
    each of which keeps a document. Of several rows of a group with its smallest id, the one
    with the smallest fingerprint and then text stays. Rows without an id take no part in
    groups and stay. All columns, whatever their names, stay as they are.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    groups = settle(simhash_groups(named))
    leads = groups.groupBy("component").agg(F.min(F.struct("id", "fingerprint")).alias("lead")).select("lead.*")
    often = settle(groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    leads = settle(leads)
    held = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), long_id(docs, "doc_id").alias("id"))
    single = sized_join(leads.select("id"), often, ["id"], "left_anti")
    kept = sized_join(held, single, ["id"], "left_semi").select("row").unionByName(held.where("id IS NULL").select("row"))
    if often.isEmpty():
        return kept.select("row.*")
    several = settle(sized_join(held, often, ["id"], "left_semi").withColumn("place", F.monotonically_increasing_id()))
    marks = fingerprints(several.select("place", F.col("row.text").alias("text")), "place").withColumnRenamed("id", "place")
    several = several.join(marks, "place")
    chosen = sized_join(several, leads, ["id", "fingerprint"], "left_semi").groupBy("id", "fingerprint").agg(
        F.min_by("row", F.struct(F.coalesce("row.text", F.lit("")).alias("text"), F.col("place"))).alias("row")
    )
    return kept.unionByName(chosen.select("row")).select("row.*")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLE: dict[str, str] = {}
