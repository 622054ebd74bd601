"""Ordered logic as window functions, each partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(rows: DataFrame, document: str, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """0-based number of a row among identical ones of its document, so that repeats never merge."""
    w = Window.partitionBy(document, *keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w) - 1)


def seeded_sample(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """Per group the n rows whose digest of the seed (8 bytes, big-endian), a colon and the key ranks first.

    The same rows on every run and in any input order.

    The digest's bytes are a random key, so each group is first cut down by leading hex digits of it in parallel: the
    rank is only taken among the n smallest of each of 256 slices.
    """
    digest = F.sha2(F.concat(F.lit(seed.to_bytes(8, "big") + b":"), F.col(key).cast("binary")), 256)
    rows = rows.withColumn("_digest", digest).withColumn("_slice", F.substring("_digest", 3, 2))
    inner = Window.partitionBy(by, "_slice").orderBy("_digest", key)
    outer = Window.partitionBy(by).orderBy("_digest", key)
    rows = rows.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= n)
    return rows.withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= n).drop("_digest", "_slice", "_rank")


def carried(value: Column, by: str, order: list[Column], inclusive: bool = True) -> Column:
    """The last value that is set, up to this row or to the one before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.last(value, ignorenulls=True).over(w)


def descending_numbers(rows: DataFrame, document: str, printed: str, order: list[str]) -> DataFrame:
    """Whether a document's rows are numbered n, n - 1, ... 1 in their order."""
    w = Window.partitionBy(document)
    rows = rows.withColumn("_expected", F.count("*").over(w) - F.row_number().over(w.orderBy(*order)) + 1)
    return rows.groupBy(document).agg(F.bool_and(F.col(printed) == F.col("_expected")).alias("numbered"))
