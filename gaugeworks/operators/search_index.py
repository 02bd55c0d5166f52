"""Stored indexes for search: posting lists per word, and a bitmap per facet value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted
from gaugeworks.operators.catalog import query_words
from gaugeworks.session import settle

#: Ids of one posting list block: their high bits are its number, 2**POSTING_BITS the most it holds.
POSTING_BITS = 16

# Sorted numbers without a dictionary are stored as gaps, and sorted words by what differs.
# Small row groups, so that a filter on a word leaves out most of them.
_DELTA_CODED = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
}


def _write_sorted(df: DataFrame, path: str, *order: str) -> None:
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.options(**_DELTA_CODED).mode("overwrite").parquet(path)


def add_to_keyword_index(df: DataFrame, path: str, batch: str, key: str, text: str) -> None:
    """Add the words of a batch of texts to the posting lists below a path.

    The batch has folders of its own, and the same batch again replaces them.

    Words are runs of ASCII letters and digits, in any case, as in `keyword_search`. A list
    is kept in blocks of ids, one row (word, block, ids) with rising ids, in the order of
    words; a word that every text holds is many blocks, never one group. `key` is a long
    that names one row of all that are ever added; rows without one, and texts without
    words, are not found. A text that changes takes its batch written again, or a new key.

    A second table has each word's number of texts, for the order of intersection.
    """
    words = F.array_distinct(F.split(F.lower(quoted(text)), "[^a-z0-9]+"))
    found = df.where(quoted(key).isNotNull()).select(
        quoted(key).cast("bigint").alias("key"), F.explode(words).alias("word")
    ).where("word <> ''")
    low = F.col("key").bitwiseAND((1 << POSTING_BITS) - 1).cast("int")
    postings = settle(
        found.groupBy("word", F.shiftright("key", POSTING_BITS).alias("block"))
        .agg(F.sort_array(F.collect_set(low)).alias("ids"))
    )
    _write_sorted(postings, f"{path}/postings/batch={batch}", "word", "block")
    counts = postings.groupBy("word").agg(F.sum(F.size("ids")).cast("bigint").alias("texts"))
    _write_sorted(counts, f"{path}/words/batch={batch}", "word")


def keyword_lookup(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Keys of the texts that hold every word of the query (one column: key).

    The lists are intersected block by block, from the rarest word on: blocks which that one
    lacks meet no further list. Filters on the words leave out all other row groups.
    """
    words = query_words(query)
    if not words:
        raise ValueError("the query holds no word")
    known = spark.read.parquet(f"{path}/words").where(F.col("word").isin(words))
    texts = {row["word"]: row["texts"] for row in known.groupBy("word").agg(F.sum("texts").alias("texts")).collect()}
    rarest_first = sorted(words, key=lambda word: (texts.get(word, 0), word))
    common = None
    for word in rarest_first:
        blocks = spark.read.parquet(f"{path}/postings").where(F.col("word") == word)
        # A block has a row for each batch that has texts of it.
        blocks = blocks.groupBy("block").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        if common is None:
            common = blocks
        else:
            both = common.join(blocks.withColumnRenamed("ids", "others"), "block")
            common = both.select("block", F.array_intersect("ids", "others").alias("ids"))
    return common.select("block", F.explode("ids").alias("low")).select(
        (F.shiftleft("block", POSTING_BITS) + F.col("low")).alias("key")
    )


def write_facet_index(
    entities: DataFrame, path: str, facets: Sequence[str], key: str = "key", name: str | None = None
) -> None:
    """Write a bitmap index of entities below a path, replacing what is there.

    Every entity gets a number. `bitmaps` has one row (facet, value, block, bitmap) for each
    block of numbers in which the value occurs; a facet may be a plain or an array column,
    null values are none. `names` is the sorted table of (name, number), `keys` has
    (number, key). A value that all entities share is many blocks, never one group.
    """
    numbered = settle(entities.select(
        F.monotonically_increasing_id().alias("number"), quoted(key).alias("key"),
        *[_as_array(entities, facet).alias(f"f{i}") for i, facet in enumerate(facets)],
        *([quoted(name).alias("name")] if name else []),
    ))
    pairs = F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(f"f{i}").alias("values")) for i, facet in enumerate(facets)
    ])
    values = numbered.select("number", F.inline(pairs)).select("number", "facet", F.explode("values").alias("value"))
    bitmaps = values.where("value IS NOT NULL").groupBy("facet", "value", *_block()).agg(_bits())
    _replace_sorted(bitmaps, f"{path}/bitmaps", "facet", "value", "block")
    _replace_sorted(numbered.select("number", "key"), f"{path}/keys", "number")
    if name:
        _replace_sorted(numbered.select("name", "number").where("name IS NOT NULL"), f"{path}/names", "name")


def _replace_sorted(df: DataFrame, path: str, *order: str) -> None:
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.option("parquet.block.size", str(8 << 20)).mode("overwrite").parquet(path)


def _as_array(entities: DataFrame, facet: str) -> Column:
    column = quoted(facet)
    if isinstance(entities.schema[facet].dataType, T.ArrayType):
        return F.array_distinct(column).cast("array<string>")
    return F.array(column.cast("string"))


def _block() -> list[Column]:
    return [F.bitmap_bucket_number("number").alias("block")]


def _bits() -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")


def facet_lookup(
    spark: SparkSession, path: str, facets: Mapping[str, Sequence[str]] | None = None, prefix: str | None = None
) -> DataFrame | None:
    """Bitmaps (block, bitmap) of entities with a wanted value in every facet, and the prefix.

    The values of a facet are ORed, the facets and the prefix ANDed, block by block. None
    stands for all entities, where nothing is asked for.
    """
    asked = []
    bitmaps = spark.read.parquet(f"{path}/bitmaps")
    for facet, wanted in (facets or {}).items():
        own = bitmaps.where((F.col("facet") == facet) & F.col("value").isin(list(wanted)))
        asked.append(own.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))
    if prefix is not None:
        named = spark.read.parquet(f"{path}/names").where(F.col("name").startswith(prefix))
        asked.append(named.groupBy(*_block()).agg(_bits()))
    if not asked:
        return None
    together = asked[0]
    for other in asked[1:]:
        together = together.unionByName(other)
    met = together.groupBy("block").agg(
        F.count(F.lit(1)).alias("met"), F.bitmap_and_agg("bitmap").alias("bitmap")
    )
    return met.where(F.col("met") == len(asked)).select("block", "bitmap")


def indexed_facet_counts(spark: SparkSession, path: str, found: DataFrame | None, facets: Sequence[str]) -> DataFrame:
    """Entities per value of each facet among those found, from bitmaps alone."""
    bitmaps = spark.read.parquet(f"{path}/bitmaps").where(F.col("facet").isin(list(facets)))
    if found is not None:
        # One row per block on the right side; each bitmap is paired with the found ones.
        pairs = bitmaps.join(found.withColumnRenamed("bitmap", "found"), "block")
        pairs = pairs.select("facet", "value", "block", F.explode(F.array("bitmap", "found")).alias("bitmap"))
        bitmaps = pairs.groupBy("facet", "value", "block").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    counted = bitmaps.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bitmap")).alias("entities"))
    return counted.where("entities > 0")


def indexed_keys(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Keys of the entities found (one column: key)."""
    numbers = spark.read.parquet(f"{path}/keys").withColumn("block", F.bitmap_bucket_number("number"))
    place = F.bitmap_bit_position("number").cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, place.bitwiseAND(7)) == 1
    return numbers.join(found, "block").where(is_set).select("key")
