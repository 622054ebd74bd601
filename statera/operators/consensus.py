"""Agreement of repeated extractions: content keys of rows, the closed set of confidences, and differences of two results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Confidence of a row that all samples agree on, that failed a sanity check, or that was escalated.
AGREED, SANITY_CAPPED, ESCALATED = 0.9, 0.79, 0.75
MOST_PATHS = 8


def row_keys(rows: DataFrame, document: str, payload: str, fields: list[str], order: list[str]) -> DataFrame:
    """``rows`` with row_key, the JSON texts of the key fields (null where absent), and occurrence among equal keys of a document."""
    value = lambda f: F.to_json(F.try_variant_get(F.parse_json(payload), f"$.{f}", "variant"))
    key = F.array_join(F.array(*[F.coalesce(value(f), F.lit("null")) for f in fields]), "\u001f")
    rows = rows.withColumn("row_key", key)
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, "row_key").orderBy(*order)) - 1)


def confidence(agreed: Column, sane: Column, escalated: Column) -> Column:
    """Null where samples disagree and nothing settled it: such a row is held."""
    return F.when(agreed & sane, AGREED).when(agreed, SANITY_CAPPED).when(escalated, ESCALATED)


def _paths(a, b, at: str):
    """Depth first; values of different JSON types differ: 1 is neither 1.0 nor true."""
    if isinstance(a, dict) and isinstance(b, dict):
        for key in sorted(a.keys() | b.keys()):
            if key in a and key in b:
                yield from _paths(a[key], b[key], f"{at}.{key}")
            else:
                yield f"{at}.{key}"
    elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        for k, (x, y) in enumerate(zip(a, b)):
            yield from _paths(x, y, f"{at}[{k}]")
    elif isinstance(a, list) and isinstance(b, list):
        yield f"{at}.length"
    elif type(a) is not type(b) or a != b:
        yield at


@F.pandas_udf(T.ArrayType(T.StringType()))
def differing_paths(left: pd.Series, right: pd.Series) -> pd.Series:
    """Where two JSON texts differ: the first eight paths, keys in order; nothing where either is no JSON."""

    def of(a, b):
        try:
            found = _paths(json.loads(a), json.loads(b), "$")
            return [p for p, _ in zip(found, range(MOST_PATHS))]
        except (TypeError, ValueError):
            return None

    return pd.Series([of(a, b) for a, b in zip(left, right)])
