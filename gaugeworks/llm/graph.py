"""Connected components of a link table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.joins import BROADCAST_ROWS, sized_join
from gaugeworks.session import settle, settle_measured


def _to_smallest(links: DataFrame, by: str, other: str) -> DataFrame:
    """Join every row of `links` to the smallest `other` seen with its `by`."""
    least, seen = settle_measured(
        links.groupBy(by).agg(F.min(other).alias("least")), n=F.count(F.lit(1))
    )
    return sized_join(links, least, [by], small=seen["n"] <= BROADCAST_ROWS)  # 16 bytes a row


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = links.select(F.col("hi").alias("node"), F.col("lo").alias("peer")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("hi").alias("peer"))
    )
    starred = _to_smallest(both, "node", "peer")
    return starred.where(F.col("peer") > F.col("node")).select(
        F.least("least", "node").alias("lo"), F.col("peer").alias("hi")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    starred = _to_smallest(links, "hi", "lo")
    moved = starred.select(
        F.col("least").alias("lo"),
        F.explode(F.array("lo", "hi")).alias("hi"),
    )
    return moved.where(F.col("lo") < F.col("hi")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from every linked node: columns node, component.

    `links` names pairs of long node ids; rows with nulls and self links count as none,
    repeated ones once, and an empty table gives an empty one. Large-star and small-star
    steps alternate until no link moves, which takes rounds in the order of the logarithm
    of the nodes, whatever a component's shape. Each round is written to the shared
    folder, so plans stay short and a lost executor costs one round at most. A node with
    many links is split by `sized_join`.
    """
    links = links.where(F.col(a) != F.col(b)).select(
        F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi")
    ).distinct()
    links = settle(links)
    before = None
    while True:
        state = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.bit_xor(F.xxhash64("lo", "hi")), F.lit(0)).alias("mark"),
        ).first()
        if state["n"] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        links = settle(_small_star(settle(_large_star(links))))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
