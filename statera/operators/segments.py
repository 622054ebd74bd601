"""Values carried along groups of any size: a segmented prefix scan.

The rows are cut into ranges of (group, order), so a long group spreads over many of them.  Windows look back inside a
range only; the last value of each group in each range is scanned over the ranges, one row a range; and a row that finds
nothing in its own range takes what its group brought into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

RANGE_ROWS = 1 << 20


def running(rows: DataFrame, by: str, order: list[str], values: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each name: the sum or max (value: (kind, column)) over the rows of its group before this one.

    Null where there is no value before.  ``order`` must order the rows of a group without ties.
    """
    fold = {"sum": F.sum, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest}
    rows = rows.withColumns({f"_{n}": v for n, (_, v) in values.items()})
    cut = _ranges(rows, by, order, ranges)
    within = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(*[fold[k](f"_{n}").alias(f"_{n}_end") for n, (k, _) in values.items()])
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select("_by", "_of", *[fold[k](f"_{n}_end").over(before).alias(f"_{n}_in") for n, (k, _) in values.items()])
    local = cut.withColumns({f"_{n}_own": fold[k](f"_{n}").over(within) for n, (k, _) in values.items()})
    out = local.join(brought, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    kept = [c for c in rows.columns if c not in {f"_{n}" for n in values}]
    return out.select(*kept, *[both[k](F.col(f"_{n}_own"), F.col(f"_{n}_in")).alias(n) for n, (k, _) in values.items()])


def _ranges(rows: DataFrame, by: str, order: list[str], ranges: int | None) -> DataFrame:
    """The rows, stored, with the number of their range of (group, order)."""
    n = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    return stored(rows.repartitionByRange(n, by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def carried(rows: DataFrame, by: str, order: list[str], values: dict[str, tuple[Column, Column]], inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each name: of (value, when), the value of the last row of its group for which ``when`` holds.

    Rows before this one count, with ``inclusive`` this one too.  A lag is a value carried whenever there is a row.
    ``order`` must order the rows of a group without ties.
    """
    packed = {f"_{n}": F.when(when, F.struct(value.alias("value"))) for n, (value, when) in values.items()}
    rows = rows.withColumns(packed)
    cut = _ranges(rows, by, order, ranges)
    within = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = cut.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"{c}_end") for c in packed])
    before = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select("_by", "_of", *[F.last(f"{c}_end", ignorenulls=True).over(before).alias(f"{c}_in") for c in packed])
    local = cut.withColumns({f"{c}_own": F.last(c, ignorenulls=True).over(within) for c in packed})
    out = local.join(brought, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    kept = [c for c in rows.columns if c not in packed]
    return out.select(*kept, *[F.coalesce(f"_{n}_own", f"_{n}_in")["value"].alias(n) for n in values])
