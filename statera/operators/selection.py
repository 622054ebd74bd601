"""Exact percentiles of groups of any size, by selection.

Small groups take Spark's own exact aggregate.  Where a group has more rows than ``most``, each wanted rank is enclosed
by two cuts of an approximate quantile grid, whose state is small and merges before the shuffle; one pass counts what
lies below and inside; and as long as too many rows are inside, the grid is taken anew over those alone.  What is left
is counted by distinct value, so ties never pile up, and the wanted order statistics are read off a running sum.  Cuts
that do not enclose their rank are not trusted: the wider bracket stays, so the grid's errors cost time only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

MOST = 1 << 20  # rows of a group, or inside a bracket, that one task may hold
GRID = 128
ACCURACY = 4096


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Equality of key columns, null equal to null; the right ones are named with a leading underscore."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def percentiles(rows: DataFrame, by: list[str], value: str, points=(0.5, 0.95), where: str | None = None, most: int = MOST, grid: int = GRID) -> DataFrame:
    """Per group the interpolated percentiles p50, p95 ... of the values that are set, optionally of the rows of ``where`` only.

    A group without such rows has nulls.
    """
    data = (rows.where(where) if where else rows).where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    names = [f"p{round(p * 100)}" for p in points]
    largest = data.groupBy(*by).count().agg(F.max("count")).collect()[0][0] or 0
    if largest <= most:
        f = f" FILTER (WHERE {where})" if where else ""
        return rows.groupBy(*by).agg(*[F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {value}){f}").alias(n) for p, n in zip(points, names)])
    found = _selected(data, by, points, most, grid).select(*[F.col(k).alias(f"_{k}") for k in by], *names)
    groups = rows.select(*by).distinct()
    return groups.join(found, _same(groups, found, by), "left").select(*[groups[k] for k in by], *names)


def _selected(data: DataFrame, by: list[str], points, most: int, grid: int) -> DataFrame:
    cuts = F.percentile_approx("v", [k / grid for k in range(grid + 1)], ACCURACY)
    whole = data.groupBy(*by).agg(F.count("*").alias("inside"), cuts.alias("cuts"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("inside") - 1)).alias("place")) for k, p in enumerate(points)]))
    brackets = whole.withColumn("w", wanted).select(*by, "w.k", "w.place", F.lit(0).cast("long").alias("below"), "inside", "low", "high", "cuts")
    brackets = stored(brackets, "brackets")
    while True:
        narrower = _counted(data, _narrowed(brackets, grid), by)
        # a bracket that does not hold both ranks around its place is not taken
        right = narrower.where((F.col("below") <= F.floor("place")) & (F.ceil("place") < F.col("below") + F.col("inside"))).select(*[F.col(c).alias(f"_{c}") for c in (*by, "k", "below", "inside", "low", "high")])
        both = brackets.join(right, _same(brackets, right, [*by, "k"]), "left")
        taken = [F.coalesce(f"_{c}", brackets[c]).alias(c) for c in ("below", "inside", "low", "high")]
        fewer = (F.coalesce("_inside", brackets["inside"]) < brackets["inside"]).alias("fewer")
        brackets = stored(both.select(*[brackets[c] for c in (*by, "k", "place")], *taken, fewer), "brackets")
        if brackets.where(F.col("fewer") & (F.col("inside") > most) & (F.col("low") < F.col("high"))).isEmpty():
            break
        inner = _inside(data, brackets, by).groupBy(*by, "k").agg(cuts.alias("cuts")).select(*[F.col(c).alias(f"_{c}") for c in (*by, "k")], "cuts")
        brackets = stored(brackets.join(inner, _same(brackets, inner, [*by, "k"])).select(*[brackets[c] for c in (*by, "k", "place", "below", "inside", "low", "high")], "cuts"), "brackets")
    values = _inside(data, brackets, by).groupBy(*by, "k", "place", "below", "v").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*by, "k").orderBy("v"))
    values = values.withColumn("upto", upto).groupBy(*by, "k", "place")
    low, high = (F.min(F.when(F.col("upto") > edge("place"), F.col("v").cast("double"))) for edge in (F.floor, F.ceil))
    one = values.agg((low + (high - low) * (F.col("place") - F.floor("place"))).alias("value"))
    return one.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"p{round(p * 100)}") for k, p in enumerate(points)])


def _narrowed(brackets: DataFrame, grid: int) -> DataFrame:
    """Brackets between the cuts two before and two after the wanted place; the ends stay where there are none."""
    at = F.floor((F.col("place") - F.col("below")) / F.col("inside") * grid).cast("int")
    low = F.when(at >= 2, F.greatest("low", F.get("cuts", at - 2))).otherwise(F.col("low"))
    high = F.when(at + 3 <= grid, F.least("high", F.get("cuts", at + 3))).otherwise(F.col("high"))
    return brackets.withColumns({"low": low, "high": high}).drop("below", "inside", "cuts")


def _joined(data: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    some = brackets.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in brackets.columns if c not in by])
    return data.join(some, _same(data, some, by)).drop(*[f"_{k}" for k in by])


def _counted(data: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "k", "place", "low", "high"]
    return _joined(data, brackets, by).where("v <= high").groupBy(*keys).agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") >= F.col("low")).alias("inside"))


def _inside(data: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    return _joined(data, brackets, by).where("v BETWEEN low AND high")
