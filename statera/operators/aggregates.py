"""Aggregates of the roll-ups: filtered, distinct, ordered-set, guarded, gap-filled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import guarded_int


def counted(**when: Column) -> list[Column]:
    """count(*) filter (where ...) for each name, all in one pass."""
    return [F.count_if(c).alias(name) for name, c in when.items()]


def percent(part: str | Column, total: str | Column) -> Column:
    """100 part / total, null where the total is 0."""
    return F.try_divide(F.lit(100.0) * part, F.nullif(F.col(total) if isinstance(total, str) else total, F.lit(0)))


def distinct_values(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def guarded_sum(text: Column) -> Column:
    """Sum of the texts that are digits only; anything else counts as 0."""
    return F.coalesce(F.sum(F.coalesce(guarded_int(text), F.lit(0))), F.lit(0))


def month_spine(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)")).alias("month"))


def totals(**frames: DataFrame) -> DataFrame:
    """One row with the count of every frame: the counts are put together, then turned into columns."""
    counts = union_counts(**frames)
    return counts.agg(*[F.max(F.when(F.col("relation") == n, F.col("rows"))).alias(n) for n in frames])


def union_counts(**frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows") for n, f in frames.items()])


def age_buckets(rows: DataFrame, at: str, as_of: str) -> DataFrame:
    days = F.datediff(F.lit(as_of).cast("date"), F.col(at).cast("date"))
    return rows.agg(*counted(under_1d=days < 1, under_7d=(days >= 1) & (days < 7), under_30d=(days >= 7) & (days < 30), older=days >= 30))


def half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)
