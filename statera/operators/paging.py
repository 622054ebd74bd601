"""Keyset pages and ranked lists with every null placement stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limit_of(limit: int | None) -> int:
    if limit is None:
        return 50
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1..200")
    return limit


def page(rows: DataFrame, limit: int | None = None, after: str | None = None, key: str = "id", descending: bool = False) -> DataFrame:
    """limit + 1 rows past the cursor in key order; the surplus row only says that another page follows."""
    k = F.col(key)
    if after is not None:
        rows = rows.where(k < after if descending else k > after)
    return rows.orderBy(k.desc() if descending else k.asc()).limit(limit_of(limit) + 1)


def next_cursor(found: list, limit: int, key: str = "id") -> str | None:
    """The cursor of the following page, or None after the last one."""
    return found[limit - 1][key] if len(found) > limit else None


def anchor(rows: DataFrame, cursor: str, columns: list[str], key: str = "id") -> dict:
    """The row that a cursor names; an unknown cursor is the caller's mistake."""
    found = rows.where(F.col(key) == cursor).select(*columns).limit(1).collect()
    if not found:
        raise ValueError(f"unknown cursor: {cursor}")
    return found[0].asDict()


def mixed_page(rows: DataFrame, order: list[tuple[str, bool]], anchor: dict | None, limit: int | None = None) -> DataFrame:
    """A page over keys of mixed direction, (name, descending) each, nulls last, after the row with the anchor's keys.

    Row values cannot be compared in mixed directions, so the bound is the disjunction over the first differing key.
    """
    if anchor is not None:
        types, arms = dict(rows.dtypes), [F.lit(False)]
        at = {n: F.lit(anchor[n]).cast(types[n]) for n, _ in order}
        for k, (name, descending) in enumerate(order):
            if anchor[name] is None:
                continue  # nothing comes after a null but by the keys that follow
            past = F.col(name).isNull() | (F.col(name) < at[name] if descending else F.col(name) > at[name])
            arms.append(reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(at[n]) for n, _ in order[:k]], past))
        rows = rows.where(reduce(lambda a, b: a | b, arms))
    keys = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in order]
    return rows.orderBy(*keys).limit(limit_of(limit) + 1)


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def search(arms: dict[str, DataFrame], cap: int = 20, key: str = "id") -> DataFrame:
    """Arms with the same columns, each capped by itself, tagged and put together."""
    parts = [df.orderBy(key).limit(cap).withColumn("arm", F.lit(name)) for name, df in arms.items()]
    return reduce(DataFrame.unionByName, parts)
