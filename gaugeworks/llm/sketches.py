"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import long_id, partitions_for, table
from gaugeworks.session import settle

#: Words of a paragraph piece, and of the finer ones that the first piece is cut into.
PIECE_WORDS = 32
FIRST_WORDS = 4
#: Cells of each of the three parts of the sketch that the fingerprint is a digest of.
BASE_WIDTH = 8
#: Cells of a part beside those in proportion: two keys of a small pair that share all
#: three cells cannot be told apart, which is as rare as this number's cube is large.
SPARE = 32
#: Cells of a part per digest of a pair at the first attempt.
FIRST_WIDTH = 0.75
#: Peeling steps of one attempt; each peels one of the three parts.
STEPS = 12
_NO_ID = -(1 << 63)
# A word and the blanks behind it; possessive, so that matching never goes back.
_WORD = r"[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+"
_CHECK_BITS = (1 << 32) - 1


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraph pieces.

    A line is cut every PIECE_WORDS words, and the document's first piece every FIRST_WORDS
    words, so that short texts have several pieces. Where a piece ends depends only on what
    precedes it in its line; an edit further on leaves it alone.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{_WORD}){{1,{PIECE_WORDS}}}+"), F.lit(0))
    first = F.regexp_extract_all(
        F.coalesce(F.get(pieces, F.lit(0)), F.lit("")), F.lit(f"(?:{_WORD}){{1,{FIRST_WORDS}}}+"), F.lit(0)
    )
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.array_distinct(F.transform(F.concat(first, rest), lambda p: F.xxhash64(F.rtrim(p))))


def _check(key: Column) -> Column:
    """What one key adds to a cell's checks: 32 further bits of hash."""
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(_CHECK_BITS))


def _cell(key: Column, part: int, width: Column) -> Column:
    """The key's cell in one of the three parts."""
    return (F.pmod(F.xxhash64(key, F.lit(part)), width) + part * width).cast("int")


def _summed(cells: DataFrame) -> DataFrame:
    """Sum up cells, which are linear; empty ones go.

    `keys` and `checks` are exclusive ors, so no number of keys overflows them; `count` is
    the sum of the signs. Digests recovered so far ride along by `found`, which is null in
    the rows of cells.
    """
    summed = cells.groupBy("g", "width", "cell", "found").agg(
        F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks"), F.sum("count").alias("count")
    )
    return summed.where("keys <> 0 or checks <> 0 or count <> 0 or found is not null")


def sketch_cells(sets: DataFrame) -> DataFrame:
    """Sketches of digest sets: rows (g, width, cell, found, keys, checks, count) of cells that
    hold something.

    `sets` has g, a long, width, an int, and `entries`, an array of (key, sign).
    """
    keyed = sets.select("g", "width", F.explode("entries").alias("e")).select("g", "width", "e.key", "e.sign")
    placed = keyed.select(
        "g", "width", F.explode(F.array(*[_cell(F.col("key"), p, F.col("width")) for p in range(3)])).alias("cell"),
        F.lit(None).cast("long").alias("found"),
        F.col("key").alias("keys"), _check(F.col("key")).alias("checks"), F.col("sign").alias("count"),
    )
    return _summed(placed)


def signed(digests: str, sign: int) -> Column:
    return F.transform(digests, lambda k: F.struct(k.alias("key"), F.lit(sign).cast("long").alias("sign")))


def base_fingerprints(sets: DataFrame) -> DataFrame:
    """Fingerprint of each set: 32 hex digits digested from the cells of its sketch of base
    size. `sets` has g and digests; sets without digests have no row."""
    cells = sketch_cells(sets.select("g", F.lit(BASE_WIDTH).alias("width"), signed("digests", 1).alias("entries")))
    digested = cells.groupBy("g").agg(
        F.bit_xor(F.xxhash64("cell", "keys", "checks", "count")).alias("x"),
        F.bit_xor(F.xxhash64("count", "checks", "keys", "cell")).alias("y"),
    )
    return digested.select("g", F.lower(F.concat(F.lpad(F.hex("x"), 16, "0"), F.lpad(F.hex("y"), 16, "0"))).alias("fingerprint"))


def _peeled(cells: DataFrame, part: int) -> DataFrame:
    """Peel every pure cell of one part.

    A cell is pure if its count is one, ours or theirs, its checks are those of its keys and
    they belong there. A key has one cell in a part, so none is peeled twice; it leaves its
    other two cells and becomes a found digest, at cell -1 if ours, -2 if theirs.
    """
    key, count, width = F.col("keys"), F.col("count"), F.col("width")
    pure = F.col("found").isNull() & (F.abs(count) == 1) & (F.col("checks") == _check(key)) & (
        F.col("cell") == _cell(key, part, width))
    none = F.lit(None).cast("long")

    def row(cell: Column, found: Column, keys: Column, checks: Column, amount: Column) -> Column:
        return F.struct(
            cell.alias("cell"), found.alias("found"), keys.alias("keys"), checks.alias("checks"), amount.alias("count")
        )

    others = [row(_cell(key, p, width), none, key, F.col("checks"), -count) for p in range(3) if p != part]
    zero = F.lit(0).cast("long")
    found = row(F.when(count > 0, -1).otherwise(-2), key, zero, zero, zero)
    kept = row(F.col("cell"), F.col("found"), key, F.col("checks"), count)
    emitted = F.when(pure, F.array(found, *others)).otherwise(F.array(kept))
    return _summed(cells.select("g", "width", F.explode(emitted).alias("c")).select("g", "width", "c.*"))


def subtract_and_peel(pairs: DataFrame, steps: int = STEPS) -> DataFrame:
    """One attempt: subtract the sketches of `ours` and `theirs` (digest arrays) and peel.

    Returns g, plus and minus, the digests recovered on our and on their side, and left, the
    cells that could not be peeled; pairs without a difference have no row. Stays within the
    partitions of `pairs` where they are dealt by g.
    """
    cells = sketch_cells(pairs.select("g", "width", F.concat(signed("ours", 1), signed("theirs", -1)).alias("entries")))
    for step in range(steps):
        cells = _peeled(cells, step % 3)
    return cells.groupBy("g").agg(
        F.collect_list(F.when(F.col("cell") == -1, F.col("found"))).alias("plus"),
        F.collect_list(F.when(F.col("cell") == -2, F.col("found"))).alias("minus"),
        F.count_if(F.col("cell") >= 0).alias("left"),
    )


def recovered_digests(pairs: DataFrame, first_width: float = FIRST_WIDTH) -> DataFrame:
    """The differing digests of every pair by their sketches: columns g, plus and minus.

    `pairs` has g, a long, and the digest arrays ours and theirs. plus are the digests that
    only ours has, minus those that only theirs has, both empty for equal sides. The first
    attempt takes `first_width` cells a part per digest and SPARE more; pairs that do not
    peel to nothing are tried again with four times as many until all have.
    """
    total = (F.size("ours") + F.size("theirs")).cast("long")
    waiting = pairs.withColumn("width", (F.ceil(total * first_width) + SPARE).cast("int"))
    none = F.array().cast("array<long>")
    done = None
    while True:
        peeled = waiting.select("g").join(subtract_and_peel(waiting), "g", "left")
        tried = settle(peeled.select(
            "g", F.coalesce("plus", none).alias("plus"), F.coalesce("minus", none).alias("minus"),
            F.coalesce("left", F.lit(0)).alias("left"),
        ))
        solved = tried.where("left = 0").drop("left")
        done = solved if done is None else done.unionByName(solved)
        failed = tried.where("left > 0").select("g")
        if failed.isEmpty():
            return done
        waiting = settle(waiting.join(failed, "g", "left_semi").withColumn("width", F.col("width") * 4))


def likeness(pairs: DataFrame, first_width: float = FIRST_WIDTH) -> DataFrame:
    """Likeness of pairs of digest sets by their sketches: columns g and near.

    near is twice the shared digests over all digests of both sides, 1 for two empty sides.
    The shared ones are ours without those that `recovered_digests` gives back.
    """
    total = (F.size("ours") + F.size("theirs")).cast("long")
    sizes = pairs.select("g", F.size("ours").alias("mine"), total.alias("total"))
    only = recovered_digests(pairs, first_width).select("g", F.size("plus").alias("plus"))
    near = F.when(F.col("total") == 0, 1.0).otherwise(2.0 * (F.col("mine") - F.col("plus")) / F.col("total"))
    return sizes.join(only, "g").select("g", near.alias("near"))


def _following(docs: DataFrame) -> DataFrame:
    """For each distinct (k, h), in that order, the next one, and the first after the last.

    Ids alone are dealt into ranges; the written ranges keep their numbers. Windows run
    within a range and, with one row a range, over the ranges.
    """
    ids = docs.select("k", "h", F.length("text").alias("n_chars")).distinct()
    ranged = settle(ids.repartitionByRange("k", "h").withColumn("range_no", F.spark_partition_id()))
    first = ranged.groupBy("range_no").agg(F.min(F.struct("k", "h")).alias("first"))
    order = Window.orderBy("range_no")
    start = F.min("first").over(Window.partitionBy())
    borders = first.select("range_no", F.coalesce(F.lead("first").over(order), start).alias("border"))
    within = Window.partitionBy("range_no").orderBy("k", "h")
    after = ranged.withColumn("after", F.lead(F.struct("k", "h")).over(within))
    joined = after.join(borders, "range_no")
    return joined.withColumn("after", F.coalesce("after", "border")).select(
        "k", "h", F.floor(F.col("n_chars") / 2).cast("int").alias("half"),
        F.col("after.k").alias("next_k"), F.col("after.h").alias("next_h"),
    )


def fingerprint_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and their likeness.

    Columns id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next; one row per input row. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's in the order of ids, the first after the last. Null texts count as empty.
    Rows of one id follow one another by a hash of their text; null ids come first; rows that repeat an
    id and text are one document and share its result. A single document follows itself. An
    empty table gives an empty one. Other columns are left out.
    """
    spark = df.sparkSession
    own = df.select(
        F.coalesce(long_id(df, id_column), F.lit(_NO_ID)).alias("k"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).select("k", F.xxhash64("text").alias("h"), "text")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = partitions_for(spark, size["bytes"] or 0, 32 << 20)
    following = settle(_following(own))
    docs = own.repartition(parts, "k", "h")
    if following.count() < size["n"]:  # rows that repeat others in id and text
        docs = docs.groupBy("k", "h", "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        docs = docs.withColumn("copies", F.lit(1).cast("long"))
    heads = docs.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), "text").join(
        following, ["next_k", "next_h"]
    ).select("k", "h", F.expr("substring(text, 1, half)").alias("head"), paragraph_digests(F.col("text")).alias("after"))
    both = docs.join(heads, ["k", "h"])
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(length(text) / 2))"), F.col("head"))
    made = both.select(
        "k", "copies", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "text", "after"
    ).select(
        "k", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "after",
        paragraph_digests(F.col("text")).alias("ours"), paragraph_digests(F.col("edited")).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    made = settle(made)  # written once, so that its row numbers stay
    dealt = made.select("row", "ours", "changed", "after").repartition(parts, "row")
    pairs = dealt.select("ours", F.explode(F.array(
        F.struct((F.col("row") * 2).alias("g"), F.col("changed").alias("theirs")),
        F.struct((F.col("row") * 2 + 1).alias("g"), F.col("after").alias("theirs")),
    )).alias("p")).select("p.g", "ours", "p.theirs")
    near = likeness(pairs.repartition(parts, "g"))
    sets = made.select(F.explode(F.array(
        F.struct((F.col("row") * 2).alias("g"), F.col("ours").alias("digests")),
        F.struct((F.col("row") * 2 + 1).alias("g"), F.col("changed").alias("digests")),
    )).alias("p")).select("p.*")
    marks = base_fingerprints(sets.repartition(parts, "g"))

    def by_row(table: DataFrame, value: str, even: str, odd: str) -> DataFrame:
        is_odd = F.col("g").bitwiseAND(F.lit(1).cast("long")) == 1
        return table.groupBy(F.shiftright("g", 1).alias("row")).agg(
            F.max(F.when(~is_odd, F.col(value))).alias(even), F.max(F.when(is_odd, F.col(value))).alias(odd)
        )

    nothing = F.lit("0" * 32)
    whole = made.select("row", "k", "copies", "n_chars", "edited_sha256")
    whole = whole.join(by_row(near, "near", "near_edited", "near_next"), "row")
    whole = whole.join(by_row(marks, "fingerprint", "fingerprint", "edited_fingerprint"), "row", "left")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.when(F.col("k") != _NO_ID, F.col("k")).alias("id"), "n_chars", "edited_sha256",
        F.coalesce("fingerprint", nothing).alias("fingerprint"),
        F.coalesce("edited_fingerprint", nothing).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_document_fingerprints": op8_document_fingerprints}
ORACLE: dict[str, str] = {}
