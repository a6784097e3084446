"""KPI roll-ups and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def argmax_by_count(df: DataFrame, group: str, value: str, into: str) -> DataFrame:
    """Per group the most frequent value, ties to the largest: two partial aggregations."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias(into))


def segment_kpis(df: DataFrame, group: list[str], target: str, means: dict[str, str]) -> DataFrame:
    """Per segment: contacts, successes, their rate, and the means asked for (output name: column)."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("contacts"), F.sum(target).alias("subscribed"), F.avg(target).alias("subscribe_rate"), *[F.avg(c).alias(n) for n, c in means.items()])


def monthly_kpis(df: DataFrame, month: str, target: str, distinct: str, sector: str, means: dict[str, str]) -> DataFrame:
    base = df.groupBy(month).agg(F.count(F.lit(1)).alias("contacts"), F.countDistinct(distinct).alias("unique_values"), F.sum(target).alias("subscribed"), F.avg(target).alias("subscribe_rate"), *[F.avg(c).alias(n) for n, c in means.items()])
    return base.join(argmax_by_count(df, month, sector, "top_sector"), month, "left")


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """Means by row and declared column value; declaring the values saves a pass and keeps absent ones."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure))


def pivot_count(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and declared column value, 0 where a value is absent."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, subset=[str(v) for v in values])
