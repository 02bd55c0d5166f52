"""Governance figures that are kept up to date by signed changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.joins import BROADCAST_ROWS, HOT_ROWS, fits_broadcast, sized_join
from gaugeworks.operators.quality import SUCCESS
from gaugeworks.session import settle

BATCH, BUCKET = "batch", "key_bucket"
FLAGS = ("owner", "tier", "description")
_SCHEMAS = {
    "entities": "key string, type string, owner boolean, tier boolean, description boolean, n bigint",
    "ends": "key string, n bigint",
    "totals": "type string, assets bigint, owner bigint, tier bigint, description bigint, lineage bigint",
    "results": "passed bigint, total bigint",
}
_KEYED = ("entities", "ends")
#: Of changed buckets, so many at most become a filter that skips folders.
FILTER_BUCKETS = 1_000


@dataclass(frozen=True)
class KpiState:
    """Counted multiplicities below a path, from which `governance_kpis` can be told.

    Four tables of signed counts, each with a folder per batch: entities by key, type and
    which fields are set; ends of edges by key; the resulting totals per type; rule results.
    What holds after a batch is the sum over all batches, and a batch that is repeated
    replaces its own folders, so it counts once. The first two are cut by hash bucket of the
    key, and only the changed keys' buckets are read. Both hold a row per batch and key, or
    key, type and flags, so no key is hot in them and `hot_rows` does not come into play.
    """

    path: str
    buckets: int = 256
    max_rows: int = BROADCAST_ROWS
    hot_rows: int = HOT_ROWS

    def apply(
        self, spark: SparkSession, batch: int, entities: DataFrame | None = None,
        edges: DataFrame | None = None, results: DataFrame | None = None,
    ) -> None:
        """Add a batch of signed changes: sign is 1 for a row that comes, -1 for one that goes.

        `entities` has key, type, owner, tier, description and sign (an update is the old row
        with -1 and the new one with 1), `edges` upstream, downstream and sign, `results`
        status and sign. Batches are numbered upwards, the last may be repeated.

        An entity counts as linked while the signed number of edge ends with its key is above
        zero, so an edge that goes takes the link away only if it was the last. For the
        changed keys alone, the rows and links before and after are compared; the difference,
        a row per type, is what the totals gain or lose.
        """
        newest = self._stored(spark, "totals").agg(F.max(BATCH)).first()[0]
        if newest is not None and batch < newest:
            raise ValueError(f"batch {batch} comes after batch {newest}")
        came = self._write(self._entity_counts(spark, entities), "entities", batch)
        ends = self._write(self._end_counts(spark, edges), "ends", batch)
        changed = came.select("key", BUCKET).unionByName(ends.select("key", BUCKET))
        old_rows, old_ends = self._before(spark, batch, changed)
        names = ["key", "type", *FLAGS]
        rows = old_rows.select(*names, F.col("n").alias("was"), F.lit(0).cast("bigint").alias("plus"))
        rows = rows.unionByName(came.select(*names, F.lit(0).cast("bigint").alias("was"), F.col("n").alias("plus")))
        rows = rows.groupBy(*names).agg(F.sum("was").alias("was"), F.sum("plus").alias("plus"))
        links = old_ends.select("key", F.col("n").alias("had"), F.lit(0).cast("bigint").alias("more"))
        links = links.unionByName(ends.select("key", F.lit(0).cast("bigint").alias("had"), F.col("n").alias("more")))
        links = links.groupBy("key").agg(F.sum("had").alias("had"), F.sum("more").alias("more"))
        both = rows.join(links, "key", "left").na.fill(0, ["had", "more"])
        now = F.col("was") + F.col("plus")
        linked = [F.col("had") > 0, F.col("had") + F.col("more") > 0]
        totals = both.groupBy("type").agg(
            F.sum("plus").alias("assets"),
            *[F.sum(F.when(F.col(flag), F.col("plus")).otherwise(0)).alias(flag) for flag in FLAGS],
            F.sum(F.when(linked[1], now).otherwise(0) - F.when(linked[0], F.col("was")).otherwise(0)).alias("lineage"),
        )
        self._write(self._result_counts(spark, results), "results", batch)
        self._write(settle(totals), "totals", batch)  # last: its number tells that the batch is there

    def kpis(self, spark: SparkSession) -> DataFrame:
        """The columns and rows of `governance_kpis`, from a row per type and batch."""
        counts = ("assets", *FLAGS, "lineage")
        stored = self._stored(spark, "totals")
        newest = stored.agg(F.max(BATCH)).scalar()
        per_type = stored.groupBy("type").agg(*[F.sum(c).alias(c) for c in counts]).where("assets <> 0")
        totals = per_type.rollup("type").agg(
            F.grouping("type").alias("_all"), *[F.sum(c).alias(c) for c in counts]
        )
        results = self._stored(spark, "results").where(F.col(BATCH) <= newest)
        rate = results.agg(F.try_divide(F.sum("passed"), F.sum("total"))).scalar()
        return totals.select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col("type")).alias("type"), "assets",
            *[F.try_divide(F.col(c), F.col("assets")).alias(f"{c}_share") for c in (*FLAGS, "lineage")],
            F.when(F.col("_all") == 1, rate).alias("dq_pass_rate"),
        )

    def _entity_counts(self, spark: SparkSession, entities: DataFrame | None) -> DataFrame:
        if entities is None:
            return spark.createDataFrame([], _SCHEMAS["entities"])
        flags = [F.col(flag).isNotNull().alias(flag) for flag in FLAGS]
        counted = entities.select("key", "type", *flags, "sign").groupBy("key", "type", *FLAGS)
        return counted.agg(F.sum("sign").cast("bigint").alias("n")).where("n <> 0")

    def _end_counts(self, spark: SparkSession, edges: DataFrame | None) -> DataFrame:
        if edges is None:
            return spark.createDataFrame([], _SCHEMAS["ends"])
        ends = edges.select(F.explode(F.array("upstream", "downstream")).alias("key"), "sign")
        counted = ends.where("key IS NOT NULL").groupBy("key").agg(F.sum("sign").cast("bigint").alias("n"))
        return counted.where("n <> 0")

    def _result_counts(self, spark: SparkSession, results: DataFrame | None) -> DataFrame:
        if results is None:
            return spark.createDataFrame([], _SCHEMAS["results"])
        passed = F.sum(F.when(F.col("status") == SUCCESS, F.col("sign")).otherwise(0))
        # As an average would, the rate leaves out results without a status.
        total = F.sum(F.when(F.col("status").isNotNull(), F.col("sign")).otherwise(0))
        counted = results.agg(passed.cast("bigint").alias("passed"), total.cast("bigint").alias("total"))
        return counted.na.fill(0)

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _before(self, spark: SparkSession, batch: int, changed: DataFrame) -> list[DataFrame]:
        """What `entities` and `ends` hold before the batch, of the changed keys at least.

        Few changed keys are broadcast and choose their rows. With many, the rows of the other
        keys in their buckets come along: choosing would cost the same shuffle as the sums, and
        a key without changes adds nothing to the difference.
        """
        seen = changed.agg(F.count(F.lit(1)).alias("rows"), F.collect_set(BUCKET).alias("buckets")).first()
        few = seen["rows"] <= self.max_rows and fits_broadcast(changed.select("key"), self.max_rows)
        found = []
        for name in _KEYED:
            stored = self._stored(spark, name).where(F.col(BATCH) < batch)
            if len(seen["buckets"]) <= FILTER_BUCKETS:
                stored = stored.where(F.col(BUCKET).isin(seen["buckets"]))
            found.append(sized_join(stored, changed.distinct(), ["key"], "left_semi", small=True) if few else stored)
        return found

    def _stored(self, spark: SparkSession, name: str) -> DataFrame:
        schema = f"{_SCHEMAS[name]}, {BATCH} int" + f", {BUCKET} int" * (name in _KEYED)
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """Write a batch's rows of a table in place of any it had; returns them as stored."""
        writer = df.write
        if name in _KEYED:
            # Buckets that are large are cut over several tasks, whatever their number.
            writer = df.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET)
        writer.mode("overwrite").parquet(f"{self.path}/{name}/{BATCH}={batch}")
        return self._stored(df.sparkSession, name).where(F.col(BATCH) == batch)
