"""Exact medians without sorting or shuffling the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import quoted

_ACCURACY = 10_000  # of the sketches that propose cuts: ranks are off by a share of 1/_ACCURACY


@dataclass
class _Target:
    """A wanted value: number `rank`, from 0, of the `rows` values from `low` to `high`."""

    column: str
    rank: int
    rows: int
    low: float
    high: float
    cuts: tuple[float, float] | None = None

    @property
    def known(self) -> bool:
        return self.low == self.high

    def value(self) -> Column:
        return quoted(self.column).cast("double")

    def inside(self) -> Column:
        return self.value().between(self.low, self.high)


def exact_medians(
    df: DataFrame, columns: Sequence[str], small: int = 100_000
) -> dict[str, float | None]:
    """Median of each numeric column, middle pair averaged; None without values.

    A quantile sketch of the range that holds the wanted rank proposes two cuts just below
    and above that rank (the first one comes with the scan that takes the ranges), a second
    scan counts the rows on either side of the cuts and on them, and the part with the rank
    is the next range. Cuts go by rank, so two scans thin
    the rows over a thousandfold however the values are spread, and a frequent value is
    found as a cut. The counts are exact: a sketch that misses costs a round, not the result.
    Once at most `small` rows remain they are ranked. Per column a few numbers reach the
    driver, and tasks hold sketches of bounded size; profile very wide tables in groups of
    columns.

    NaN is larger than any number here, as in Spark's ordering; infinities count.
    """
    targets = _first_ranges(df, columns)
    cuts = {t.column: t.cuts for t in targets}
    while wide := [t for t in targets if not t.known and t.rows > small]:
        _cut_ranges(df, wide, cuts)
        cuts = {}
    _rank_rest(df, [t for t in targets if not t.known])
    found = {column: [t.low for t in targets if t.column == column] for column in columns}
    return {c: sum(pair) / len(pair) if pair else None for c, pair in found.items()}


def _first_ranges(df: DataFrame, columns: Sequence[str]) -> list[_Target]:
    """Targets over the finite values, or already known where the rank falls outside them."""
    if not columns:
        return []
    infinity, margin = float("inf"), 2 / _ACCURACY
    aggregates = []
    for i, column in enumerate(columns):
        value = quoted(column).cast("double")
        finite = F.when((value > -infinity) & (value < infinity), value)
        aggregates += [
            F.count_if(value == -infinity).alias(f"below{i}"),
            F.count(finite).alias(f"rows{i}"),
            F.count_if(value == infinity).alias(f"above{i}"),
            F.count_if(F.isnan(value)).alias(f"nan{i}"),
            F.min(finite).alias(f"low{i}"),
            F.max(finite).alias(f"high{i}"),
            F.percentile_approx(finite, [0.5 - margin, 0.5 + margin], _ACCURACY).alias(f"cuts{i}"),
        ]
    seen = df.agg(*aggregates).first()
    targets = []
    for i, column in enumerate(columns):
        parts = [
            (seen[f"below{i}"], -infinity, -infinity),
            (seen[f"rows{i}"], seen[f"low{i}"], seen[f"high{i}"]),
            (seen[f"above{i}"], infinity, infinity),
            (seen[f"nan{i}"], float("nan"), float("nan")),
        ]
        total = sum(rows for rows, _, _ in parts)
        for rank in sorted({(total - 1) // 2, total // 2}) if total else []:
            targets.append(_descend(column, rank, parts))
            targets[-1].cuts = seen[f"cuts{i}"] and tuple(seen[f"cuts{i}"])
    return targets


def _descend(column: str, rank: int, parts: Sequence[tuple[int, float, float]]) -> _Target:
    """The part of (rows, low, high), in rising order, that holds the rank."""
    for rows, low, high in parts:
        if rank < rows:
            return _Target(column, rank, rows, low, high)
        rank -= rows
    raise ValueError(f"column {column} changed between two reads")


def _cut_ranges(
    df: DataFrame, targets: Sequence[_Target], known: Mapping[str, tuple[float, float] | None]
) -> None:
    """Narrow each target's range; `known` has cuts that an earlier scan proposed."""
    # The middle pair mostly shares its range; each range is cut once.
    ranges: dict[tuple[str, float, float], list[_Target]] = {}
    for t in targets:
        ranges.setdefault((t.column, t.low, t.high), []).append(t)
    cuts: list[Sequence[float] | None] = []
    proposed, margin = [], 2 / _ACCURACY
    for sharing in ranges.values():
        t, ranks = sharing[0], [each.rank for each in sharing]
        shares = [
            max(0.0, min(ranks) / t.rows - margin), min(1.0, (max(ranks) + 1) / t.rows + margin)
        ]
        cuts.append(known.get(t.column))
        if cuts[-1] is None:
            sketch = F.percentile_approx(F.when(t.inside(), t.value()), shares, _ACCURACY)
            proposed.append(sketch.alias(f"cuts{len(proposed)}"))
    if proposed:
        found = iter(df.agg(*proposed).first())
        cuts = [next(found) if pair is None else pair for pair in cuts]
    counts, widths = [], []
    for i, sharing in enumerate(ranges.values()):
        t, (lower, upper) = sharing[0], cuts[i]
        tests = [t.value() < lower, t.value() == lower]
        if lower < upper:
            tests += [(t.value() > lower) & (t.value() < upper), t.value() == upper]
        tests.append(t.value() > upper)
        widths.append(len(tests))
        for test in tests:
            held = F.when(t.inside() & test, t.value())
            counts += [
                make(held).alias(f"n{len(counts) + j}")
                for j, make in enumerate((F.count, F.min, F.max))
            ]
    seen = iter(df.agg(*counts).first())
    for sharing, width in zip(ranges.values(), widths):
        parts = [(next(seen), next(seen), next(seen)) for _ in range(width)]
        for t in sharing:
            narrowed = _descend(t.column, t.rank, parts)
            t.rank, t.rows, t.low, t.high = (
                narrowed.rank, narrowed.rows, narrowed.low, narrowed.high
            )


def _rank_rest(df: DataFrame, targets: Sequence[_Target]) -> None:
    """Rank the few rows left per target, equal values merged before the shuffle."""
    if not targets:
        return
    merged = (
        df.select(F.inline(F.array(*[
            F.when(t.inside(), F.struct(F.lit(i).alias("target"), t.value().alias("value")))
            for i, t in enumerate(targets)
        ])))
        .where(F.col("target").isNotNull())
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    up_to = Window.partitionBy("target").orderBy("value")
    wanted = F.element_at(F.array(*[F.lit(t.rank) for t in targets]), F.col("target") + 1)
    rows = (
        merged.withColumn("upto", F.sum("n").over(up_to))
        .where((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
        .select("target", "value")
        .collect()
    )
    for row in rows:
        targets[row["target"]].low = targets[row["target"]].high = row["value"]
