"""Conformance of an adapter: what it makes of documents against the rows that are expected of them, as one report.

Rows of a case are compared by position as the reader of a document sees them: ``key`` numbers them, equal keys are told
apart by the order of their contents.  A difference is a path into the row, typed as the columns are; null equals null.

Defined results: a case with rows on one side only reports each row; a case whose silver is empty though rows are
expected also reports ``zero_rows``; where nothing is expected and nothing comes, the case conforms.  A run without any
expected row or document is refused: nothing would be tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.base import SourceAdapter
from . import contracts


def paths(left: Column, right: Column, kind: T.DataType, at: Column) -> Column:
    """Paths at which two values of a type differ, in the order of its fields, as an array; one expression for the whole type."""
    if isinstance(kind, T.StructType):
        inner = [paths(left[f.name], right[f.name], f.dataType, F.concat(at, F.lit(f".{f.name}"))) for f in kind]
        deeper = F.flatten(F.array(*inner)) if inner else F.array().cast("array<string>")
    elif isinstance(kind, T.ArrayType):
        each = F.transform(F.sequence(F.lit(0), F.size(left) - 1), lambda k: paths(F.get(left, k), F.get(right, k), kind.elementType, F.concat(at, F.lit("["), k.cast("string"), F.lit("]"))))
        deeper = F.when(F.size(left) != F.size(right), F.array(F.concat(at, F.lit(".length")))).when(F.size(left) > 0, F.flatten(each)).otherwise(F.array().cast("array<string>"))
    elif isinstance(kind, T.MapType):
        a, b = (F.array_sort(F.map_entries(m)) for m in (left, right))
        return F.when(~a.eqNullSafe(b), F.array(at)).otherwise(F.array().cast("array<string>"))
    else:
        return F.when(~left.eqNullSafe(right), F.array(at)).otherwise(F.array().cast("array<string>"))
    # a null against a value, or nothing on either side
    return F.when(left.isNull() != right.isNull(), F.array(at)).when(left.isNull(), F.array().cast("array<string>")).otherwise(deeper)


def differences(actual: DataFrame, expected: DataFrame, case: str, key: str, stage: str) -> DataFrame:
    """case, stage, position, problem (missing, unexpected, differs) and paths of rows that are not as expected.

    Columns must be the same on both sides, by name and type; the columns of ``expected`` give their order.
    """
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
    if kinds(actual) != kinds(expected):
        raise ValueError(f"columns differ: {sorted(set(kinds(actual).items()) ^ set(kinds(expected).items()))}")
    names = [c for c in expected.columns if c not in (case, key)]
    row = F.struct(*names) if names else F.struct(F.lit(None).cast("string").alias("none"))
    content = F.to_json(row, {"ignoreNullFields": "false"})
    again = F.row_number().over(Window.partitionBy("_case", "_key").orderBy("_content"))
    side = lambda df, name: df.select(F.col(case).alias("_case"), F.col(key).cast("long").alias("_key"), row.alias(name), content.alias("_content")).withColumn("_again", again).drop("_content").withColumn(f"_has{name}", F.lit(True))
    a, b = side(actual, "_a"), side(expected, "_b")
    met = a.alias("x").join(b.alias("y"), F.col("x._case").eqNullSafe(F.col("y._case")) & F.col("x._key").eqNullSafe(F.col("y._key")) & (F.col("x._again") == F.col("y._again")), "full_outer")
    kind = b.schema["_b"].dataType
    problem = F.when(F.col("_has_a").isNull(), "missing").when(F.col("_has_b").isNull(), "unexpected")
    out = met.select(
        F.coalesce("x._case", "y._case").cast("string").alias("case"),
        F.lit(stage).alias("stage"),
        F.coalesce("x._key", "y._key").alias("position"),
        problem.alias("problem"),
        F.when(problem.isNull(), paths(F.col("_a"), F.col("_b"), kind, F.lit("$"))).otherwise(F.array().cast("array<string>")).alias("paths"),
    )
    out = out.where(F.col("problem").isNotNull() | (F.size("paths") > 0))
    return out.withColumn("problem", F.coalesce("problem", F.lit("differs")))


def empty_cases(actual: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """Cases of which rows are expected and none came."""
    lacking = expected.select(case).distinct().join(actual.select(case).distinct(), case, "left_anti")
    return lacking.select(F.col(case).cast("string").alias("case"), F.lit("silver").alias("stage"), F.lit(None).cast("long").alias("position"), F.lit("zero_rows").alias("problem"), F.array().cast("array<string>").alias("paths"))


def breaches(gold: DataFrame, schemas: dict, regime: str, case: str, key: str) -> DataFrame:
    """Gold rows whose details (JSON text) breach the contract of their regime and type, or that have no contract."""
    found = gold.select(F.col(case).cast("string").alias("case"), F.lit("contract").alias("stage"), F.col(key).cast("long").alias("position"), contracts.checked(schemas, F.lit(regime), F.col("record_type"), F.col("details")).alias("problem"))
    return found.where("problem <> 'ok'").withColumn("paths", F.array(F.split_part("problem", F.lit(" "), F.lit(1)))).withColumn("problem", F.lit("breach"))


def run(adapter: SourceAdapter, bronze: DataFrame, silver: DataFrame, gold: DataFrame, key: str, gold_key: str, case: str = "sha256", schemas: dict | None = None, details: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The report of an adapter over documents and their expected silver and gold rows; no row means that it conforms.

    ``details`` adds the details of gold rows as JSON text for the contracts in ``schemas``.
    """
    if bronze.isEmpty():
        raise ValueError("no documents: nothing would be tested")
    got = adapter.parse(bronze)
    made = adapter.normalize(got)
    report = differences(got, silver, case, key, "silver").unionByName(empty_cases(got, silver, case)).unionByName(differences(made, gold, case, gold_key, "gold"))
    if schemas is not None:
        report = report.unionByName(breaches(details(made) if details else made, schemas, adapter.regime, case, gold_key))
    return report
