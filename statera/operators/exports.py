"""Snapshot exports with a manifest, and copies scoped to one regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .idempotent import insert_if_absent


def _text(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(name)
    if kind.startswith("decimal"):
        return c.cast("string").alias(name)
    return c


def export_csv(rows: DataFrame, path: str) -> None:
    """Gzip CSV with a header: nulls are empty cells, nested columns JSON text, times RFC 3339."""
    nested = ("struct", "map", "array")
    columns = [F.to_json(F.col(c)).alias(c) if k.startswith(nested) else _text(c, k) for c, k in rows.dtypes]
    rows.select(*columns).write.option("compression", "gzip").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_jsonl(rows: DataFrame, path: str) -> None:
    """Gzip JSON lines: decimals are strings, nested columns nested, nulls kept."""
    rows.select(*[_text(c, k) for c, k in rows.dtypes]).write.option("compression", "gzip").option("ignoreNullFields", False).json(path)


def manifest(spark: SparkSession, path: str, bound: str, licence: str) -> DataFrame:
    """name, bytes, sha256, bound and licence of every data file of an export."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(bound).alias("bound"), F.lit(licence).alias("licence"))


def scoped_copy(source: dict[str, DataFrame], target: dict[str, DataFrame], parents: dict[str, tuple[str, str]], root: str, scope: Column) -> dict[str, DataFrame]:
    """Rows to append per table, in the order of ``source``: the root's rows in scope, then the children of what is in scope.

    parents[table] is (column, parent table); tables have an id.  Rows that the target has are left out, not their children.
    """
    inside, out = {}, {}
    for name, rows in source.items():
        if name == root:
            inside[name] = rows.where(scope)
        else:
            column, parent = parents[name]
            inside[name] = rows.join(inside[parent].select(F.col("id").alias(column)), column, "left_semi")
        out[name] = insert_if_absent(target[name], inside[name], ["id"], "id")
    return out


def signed(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 of a payload in lowercase hex, from two digests; the key is at most 64 bytes."""
    key = secret.encode()
    if len(key) > 64:
        raise ValueError("key longer than a block")
    inner, outer = (bytes(b ^ p for b in key.ljust(64, b"\0")) for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), payload.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
