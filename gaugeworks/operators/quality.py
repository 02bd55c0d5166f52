"""Data-quality rules, their results, and the series and incidents built on results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import quoted, stamp

# Status words and operator names.
SUCCESS, FAILED = "SUCCESS", "FAILED"
NOT_NULL, BETWEEN, EQUAL_TO = "NOT_NULL", "BETWEEN", "EQUAL_TO"


@dataclass(frozen=True)
class DqRule:
    """One rule on one column. Null values only ever violate NOT_NULL."""

    test: str
    column: str
    operator: str
    min_value: float | None = None
    max_value: float | None = None
    value: object = None
    suite: str = ""

    def broken(self) -> Column:
        """True on rows that violate the rule."""
        column = quoted(self.column)
        if self.operator == NOT_NULL:
            return column.isNull()
        if self.operator == BETWEEN:
            below = F.lit(False) if self.min_value is None else column < self.min_value
            above = F.lit(False) if self.max_value is None else column > self.max_value
            return below | above
        if self.operator == EQUAL_TO:
            return column != F.lit(self.value)
        raise ValueError(f"unknown operator {self.operator}")

    def finding(self, violations: Column, total: Column, low: Column, high: Column) -> Column:
        """What the check saw, as text; observed values with two decimals."""
        if self.operator == NOT_NULL:
            return F.format_string(
                "%d null in %s, rows checked: %d", violations, F.lit(self.column), total
            )
        if self.operator == EQUAL_TO:
            return F.format_string(
                "%d values of %s differ from %s, rows checked: %d",
                violations, F.lit(self.column), F.lit(str(self.value)), total,
            )
        return F.format_string(
            "%d values of %s not within %s to %s, observed %s to %s",
            violations, F.lit(self.column), F.lit(_bound(self.min_value)),
            F.lit(_bound(self.max_value)), _seen(low), _seen(high),
        )


def _bound(value: float | None) -> str:
    """A bound in full; any for a missing one."""
    if value is None:
        return "any"
    return str(int(value)) if float(value).is_integer() else str(value)


def _seen(value: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%.2f", value)), F.lit("none"))


def dq_suite_run(
    df: DataFrame,
    rules: Sequence[DqRule],
    table: str,
    ts: datetime | Column | None = None,
) -> DataFrame:
    """Check every rule in one pass over the table; one result row per rule.

    All rules share a single global aggregate: each task sends one row of counts, and
    the scan reads only the columns the rules name.
    """
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, rule in enumerate(rules):
        aggregates.append(F.count_if(rule.broken()).alias(f"broken_{i}"))
        if rule.operator == BETWEEN:
            aggregates.append(F.min(quoted(rule.column)).cast("double").alias(f"low_{i}"))
            aggregates.append(F.max(quoted(rule.column)).cast("double").alias(f"high_{i}"))
    results = []
    for i, rule in enumerate(rules):
        broken, total = F.col(f"broken_{i}"), F.col("total")
        ranged = rule.operator == BETWEEN
        low = F.col(f"low_{i}") if ranged else F.lit(None).cast("double")
        high = F.col(f"high_{i}") if ranged else F.lit(None).cast("double")
        results.append(
            F.struct(
                F.lit(rule.suite).alias("suite"),
                F.lit(rule.test).alias("test"),
                F.lit(table).alias("table"),
                F.lit(rule.column).alias("column"),
                stamp(ts).alias("ts"),
                F.when(broken == 0, SUCCESS).otherwise(FAILED).alias("status"),
                rule.finding(broken, total, low, high).alias("message"),
                total.alias("total"),
                broken.alias("violations"),
                low.alias("observed_min"),
                high.alias("observed_max"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*results)))


def dq_not_null(df: DataFrame, column: str, table: str) -> DataFrame:
    """Status, null count and rows checked for one column."""
    rule = DqRule(f"{column}_not_null", column, NOT_NULL)
    return dq_suite_run(df, [rule], table).select(
        "test", "status",
        F.col("violations").alias("null_count"), F.col("total").alias("total_rows"),
    )


def dq_between(df: DataFrame, column: str, low: float, high: float, table: str) -> DataFrame:
    """Status, rows outside [low, high] and observed range; bounds count as inside."""
    rule = DqRule(f"{column}_in_range", column, BETWEEN, low, high)
    return dq_suite_run(df, [rule], table).select(
        "test", "status", "violations", "observed_min", "observed_max"
    )


def dq_equal_to(df: DataFrame, column: str, value: object, table: str) -> DataFrame:
    """Status and number of values that differ from the given one."""
    rule = DqRule(f"{column}_equal_to", column, EQUAL_TO, value=value)
    return dq_suite_run(df, [rule], table).select(
        "test", "status", "violations", F.col("total").alias("total_rows")
    )


def dq_pass_rate_daily(results: DataFrame, ts: str = "ts") -> DataFrame:
    """Runs and share of passed runs per day (tumbling one-day window)."""
    return (
        results.groupBy(F.window(ts, "1 day"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.avg((F.col("status") == SUCCESS).cast("double")).alias("pass_rate"),
        )
        .select(F.col("window.start").alias("day"), "runs", "pass_rate")
    )


def dq_incidents(results: DataFrame) -> DataFrame:
    """One incident per failed run; repeated failures are not merged."""
    return results.where(F.col("status") == FAILED).select(
        F.concat_ws("/", "test", "run_id").alias("incident"),
        "test", "entity", "run_id", "ts", "message",
    )


def union_results(native: DataFrame, *external: tuple[str, DataFrame]) -> DataFrame:
    """Native and external results in one shape, each row named by its source.

    Columns only some producers deliver are null for the others.
    """
    merged = native.withColumn("source", F.lit("NATIVE"))
    for source, results in external:
        merged = merged.unionByName(
            results.withColumn("source", F.lit(source)), allowMissingColumns=True
        )
    return merged


def latest_status(results: DataFrame, keys: Iterable[str] = ("entity", "test")) -> DataFrame:
    """Status of each test's latest run; ties on time go to the larger run id."""
    return results.groupBy(*keys).agg(
        F.max_by("status", F.struct("ts", "run_id")).alias("status")
    )


def lineage_dq_badge(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Badge of each lineage node: red if any test's latest run failed, green if all passed,
    error if none failed but some did not come to a result.

    Both sides have one row per entity before they meet, so the join has no hot key.
    """
    per_entity = latest_status(results).groupBy("entity").agg(
        F.count_if(F.col("status") == FAILED).alias("failed_tests"),
        F.count_if(F.col("status") == SUCCESS).alias("passed_tests"),
        F.count(F.lit(1)).alias("tests"),
    )
    return (
        nodes.select(F.col("entity")).distinct()
        .join(per_entity, "entity", "left")
        .select(
            "entity",
            F.when(F.col("failed_tests") > 0, "red")
            .when(F.col("tests") == F.col("passed_tests"), "green")
            .when(F.col("tests") > 0, "error")
            .otherwise("none")
            .alias("badge"),
            F.coalesce("failed_tests", F.lit(0)).alias("failed_tests"),
            F.coalesce("tests", F.lit(0)).alias("tests"),
        )
    )
