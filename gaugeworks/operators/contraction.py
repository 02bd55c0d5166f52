"""Contraction of unbranched runs in a step table, so that long chains are walked in few rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import settle, settle_measured


@dataclass(frozen=True)
class Contracted:
    """A step table whose unbranched runs are single steps.

    `steps` has entity, next, weight (hops) and head, null for a plain step; `members` has
    entity, head and offset, the place of each entity within its run from 0 at the head.
    """

    steps: DataFrame
    members: DataFrame


def contract_runs(steps: DataFrame, fixed: DataFrame) -> Contracted:
    """Replace every run of entities with one step in and one step out by a single step.

    `steps` has distinct pairs (entity, next). Entities of `fixed` (one column: entity) stay,
    whatever their steps. Each entity of a run points to the one before it; in every round
    it takes over the pointer and the distance of the entity pointed to, so that distances
    double and a run of n entities is done after log2(n) rounds, all runs together. A ring
    without a branch never gets to a head; nothing outside leads to it, and it is left out.

    Every entity of a run has one row here, so the joins have no hot key. Each round is
    written to the shared folder.
    """
    leaving = steps.groupBy("entity").agg(F.count(F.lit(1)).alias("n_out"), F.min("next").alias("next"))
    entering = steps.groupBy(F.col("next").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("entity").alias("before")
    )
    passed = (
        leaving.where("n_out = 1").join(entering.where("n_in = 1"), "entity")
        .where("entity <> next").join(fixed, "entity", "left_anti").select("entity", "before", "next")
    )
    passed = settle(passed)
    is_passed = passed.select(F.col("entity").alias("before"), F.lit(True).alias("goes_on"))
    pointers = passed.join(is_passed, "before", "left").select(
        "entity",
        F.when(F.col("goes_on"), F.col("before")).otherwise(F.col("entity")).alias("head"),
        F.when(F.col("goes_on"), 1).otherwise(0).cast("bigint").alias("offset"),
        F.coalesce("goes_on", F.lit(False)).alias("open"),
    )
    pointers, left = _measured(pointers)
    while left:
        target = pointers.select(
            F.col("entity").alias("head"), F.col("head").alias("far"), F.col("offset").alias("further"),
            F.col("open").alias("still"),
        )
        moved = pointers.where("open").join(target, "head").select(
            "entity", F.col("far").alias("head"), (F.col("offset") + F.col("further")).alias("offset"),
            F.col("still").alias("open"),
        )
        pointers, still = _measured(pointers.where("not open").unionByName(moved))
        if still == left:
            break
        left = still
    members = pointers.where("not open").select("entity", "head", "offset")
    runs = members.join(passed, "entity").groupBy("head").agg(
        F.min_by("before", "offset").alias("entity"), F.max_by("next", "offset").alias("next"),
        (F.max("offset") + 2).alias("weight"),
    )
    within = passed.select("entity")
    plain = steps.join(within, "entity", "left_anti").join(
        within.select(F.col("entity").alias("next")), "next", "left_anti"
    )
    plain = plain.select(
        "entity", "next", F.lit(1).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("head")
    )
    return Contracted(settle(plain.unionByName(runs.select(plain.columns))), members)


def _measured(pointers: DataFrame) -> tuple[DataFrame, int]:
    settled, seen = settle_measured(pointers, open=F.count_if("open"))
    return settled, seen["open"]
