"""Lineage edges, column mappings and walks over the edge table."""

from __future__ import annotations

from itertools import count
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.contraction import contract_runs
from gaugeworks.operators.joins import (
    BROADCAST_BYTES, BROADCAST_ROWS, HOT_ROWS, hot_buckets, sized_join,
)
from gaugeworks.session import settle, settle_measured

# Types of edges.
TRANSFORMED, COPY, VIEW = "TRANSFORMED", "COPY", "VIEW"
FILTER_KEYS = 1_000
#: Rounds after which a walk counts as a deep one.
CONTRACT_AFTER = 12


def lineage_edges(inputs: DataFrame) -> DataFrame:
    """One edge per listed input, from (downstream, inputs, ts, actor).

    The input may also have type, job and description; an edge without a type is a
    transformation, and the other two stay null.
    """
    given = {
        name: F.col(name) if name in inputs.columns else F.lit(None).cast("string")
        for name in ("type", "job", "description")
    }
    return inputs.select(
        F.explode("inputs").alias("upstream"),
        "downstream",
        F.coalesce(given["type"], F.lit(TRANSFORMED)).alias("type"),
        given["job"].alias("job"),
        given["description"].alias("description"),
        "ts",
        "actor",
    )


def job_io_edges(jobs: DataFrame) -> DataFrame:
    """Edges dataset to job, job to dataset and job to job, in one pass.

    Input: (job, input_datasets, output_datasets, input_jobs).
    """

    def edges(items: str, kind: str, into_job: bool):
        def edge(item):
            ends = (item, F.col("job")) if into_job else (F.col("job"), item)
            return F.struct(
                ends[0].alias("upstream"), ends[1].alias("downstream"), F.lit(kind).alias("type")
            )

        return F.transform(F.coalesce(F.col(items), F.array().cast("array<string>")), edge)

    return jobs.select(
        F.inline(
            F.concat(
                edges("input_datasets", "consumes", True),
                edges("output_datasets", "produces", False),
                edges("input_jobs", "after", True),
            )
        )
    )


def column_lineage(mappings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(upstream column, downstream column, operation) rows from declared mappings.

    `mappings` has upstream, downstream, upstream_fields, downstream_fields, operation;
    every upstream field of a mapping feeds each of its downstream fields. With `edges`,
    only mappings along a known edge are kept. That join runs before the arrays are
    unfolded, and a hot pair of mappings is spread.
    """
    if edges is not None:
        mappings = sized_join(mappings, edges, ["upstream", "downstream"], "left_semi")
    return mappings.select(
        "upstream", "downstream", F.explode("upstream_fields").alias("upstream_column"),
        "downstream_fields", "operation",
    ).select(
        "upstream", "upstream_column", "downstream",
        F.explode("downstream_fields").alias("downstream_column"), "operation",
    )


def clustered_edges(edges: DataFrame, end: Literal["upstream", "downstream"]) -> DataFrame:
    """Distinct edges, stored in the shared folder in the order of one end.

    A filter on that end then skips files and row groups. The other end is the second part
    of the order, so the edges of a hot entity are cut over files too.
    """
    other = "downstream" if end == "upstream" else "upstream"
    return settle(
        edges.select(end, other).distinct().repartitionByRange(end, other)
        .sortWithinPartitions(end, other)
    )


def lineage_walk(
    edges: DataFrame,
    start: str,
    direction: Literal["upstream", "downstream"],
    max_hops: int | None = None,
    *,
    contract_after: int = CONTRACT_AFTER,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All entities reachable from one entity, with the fewest hops to each.

    Breadth first: each round joins the newly found entities to the edges and drops those
    seen before, so cycles end and a diamond is not walked twice. The found set is written
    to the shared folder per round and measured by that write. A frontier of up to
    `FILTER_KEYS` entities becomes a filter the scan can use to skip files and row groups,
    one of up to `max_rows` is broadcast; for a larger one the edges of hot entities are
    salted, as one may hold a large part of all edges. It ends when a round finds nothing;
    with a `max_hops`, walks that are deeper raise rather than return a part.

    A walk that goes on after `contract_after` rounds is a deep one: then runs of entities
    without a branch become single steps (see `contract_runs`), and the rest of the walk
    takes a round per step between branches, not per hop.

    Each round scans the edges, so pass a stored table: for many walks the `clustered_edges`
    by the end that is looked up. A few keys skip all but their own row groups; many skip
    what lies outside the least and the greatest of them.
    """
    here, there = ("downstream", "upstream") if direction == "upstream" else (
        "upstream", "downstream")
    steps = edges.select(F.col(here).alias("entity"), F.col(there).alias("next")).where(
        "entity IS NOT NULL AND next IS NOT NULL")
    too_deep = ValueError(f"lineage of {start} is deeper than {max_hops} hops")
    found = edges.sparkSession.range(1).select(F.lit(start).alias("entity"))
    seen = found.withColumn("hops", F.lit(0))
    rows, size, hot = 1, len(start.encode()), None
    for hop in count(1):
        if hop > contract_after:
            walked = _deep_walk(steps, seen, found, hop - 1, max_rows, hot_rows)
            if max_hops is not None and not walked.where(F.col("hops") > max_hops).isEmpty():
                raise too_deep
            return walked.where(F.col("hops") > 0)
        if rows <= min(FILTER_KEYS, max_rows):
            keys = [row["entity"] for row in found.collect()]
            matched = steps.where(F.col("entity").isin(keys))
        else:
            small = rows <= max_rows and size <= BROADCAST_BYTES
            if not small and hot is None:
                hot = hot_buckets(steps, ["entity"], hot_rows)
            matched = sized_join(steps, found, ["entity"], "left_semi", small=small, hot=hot)
        reached = matched.select(F.col("next").alias("entity"))
        found, measured = settle_measured(
            reached.distinct().join(seen.select("entity"), "entity", "left_anti"),
            n=F.count(F.lit(1)), bytes=F.sum(F.octet_length("entity")),
        )
        rows, size = measured["n"], measured["bytes"]
        if rows == 0:
            return seen.where(F.col("hops") > 0)
        if max_hops is not None and hop > max_hops:
            raise too_deep
        seen = seen.unionByName(found.withColumn("hops", F.lit(hop)))


def _deep_walk(
    steps: DataFrame, seen: DataFrame, frontier: DataFrame, hops: int, max_rows: int, hot_rows: int
) -> DataFrame:
    """Go on from a frontier over contracted steps; (entity, hops) of all that is reached.

    What was seen before is final, so steps into it are dropped. A step may stand for many
    hops, so an entity's hops can still fall after it was first reached; entities whose hops
    fell are looked at again, until none does.
    """
    seen = settle(seen)
    ahead = sized_join(
        steps, seen.select(F.col("entity").alias("next")), ["next"], "left_anti",
        max_rows=max_rows, hot_rows=hot_rows,
    )
    contracted = contract_runs(settle(ahead.select("entity", "next").distinct()), frontier)
    hot = hot_buckets(contracted.steps, ["entity"], hot_rows)
    changed = frontier.select("entity", F.lit(hops).cast("bigint").alias("hops"))
    best = changed
    while True:
        # A few columns of few entities mostly; the join measures them.
        moved = sized_join(contracted.steps, changed, ["entity"], max_rows=max_rows, hot=hot)
        offered = moved.groupBy(F.col("next").alias("entity")).agg(
            F.min(F.col("hops") + F.col("weight")).alias("offer"))
        better = offered.join(best, "entity", "left").where("hops IS NULL OR offer < hops")
        changed, measured = settle_measured(
            better.select("entity", F.col("offer").alias("hops")), n=F.count(F.lit(1)))
        if measured["n"] == 0:
            break
        best = settle(best.unionByName(changed).groupBy("entity").agg(F.min("hops").alias("hops")))
    entered = contracted.steps.where("head IS NOT NULL").join(best, "entity").select("head", "hops")
    within = sized_join(contracted.members, settle(entered), ["head"], max_rows=max_rows, hot_rows=hot_rows)
    within = within.select("entity", F.col("hops") + F.col("offset") + 1)
    later = best.unionAll(within).select("entity", F.col("hops").cast("int"))
    return seen.unionByName(later.join(frontier, "entity", "left_anti"))
