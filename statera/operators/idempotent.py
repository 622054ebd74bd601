"""Writes that may run twice: append what is absent, upsert by sequence, publish several tables at one instant."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch to append: the first of each key in ``order``, if the target has no such key."""
    cols = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return first.join(target.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Target and batch as one relation in which each key has its row of the highest sequence."""
    cols = [c for c in target.columns if c not in keys]
    both = target.unionByName(batch)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(sequence)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert_open(existing: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """An open row per key gains the detections of its key; keys without one get a new row; ``inserted`` tells which."""
    counts = detected.groupBy(key).agg(F.count("*").alias("found"))
    both = existing.where("status = 'open'").select(key, "detections").join(counts, key, "full_outer")
    total = F.coalesce("detections", F.lit(0)) + F.coalesce("found", F.lit(0))
    return both.select(key, total.cast("long").alias("detections"), F.col("detections").isNull().alias("inserted"))


def publish(tables: dict[str, DataFrame], root: str, batch: str, check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
    """Write all tables under a batch folder, then point ``CURRENT`` at it by one replacing rename: readers see all or nothing.

    One writer at a time is assumed.  A batch that is written again replaces its own folder only.  ``check`` gets the
    tables as they were written; what it raises leaves the pointer where it was.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{batch}/{name}")
    if check is not None:
        check({name: spark.read.schema(df.schema).parquet(f"{root}/{batch}/{name}") for name, df in tables.items()})
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    draft, pointer = hadoop.Path(f"{root}/CURRENT.{batch}"), hadoop.Path(f"{root}/CURRENT")
    out = draft.getFileSystem(conf).create(draft, True)
    out.write(bytearray(json.dumps({"batch": batch, "tables": sorted(tables)}).encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, replace)


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as of the last batch that was published whole."""
    manifest = spark.read.text(f"{root}/CURRENT").collect()[0][0]
    return spark.read.parquet(f"{root}/{json.loads(manifest)['batch']}/{table}")


def put_blobs(store: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content-addressed blobs to append: (sha256, content), each content once, none that the store has."""
    addressed = blobs.select(F.sha2("content", 256).alias("sha256"), "content")
    first = addressed.groupBy("sha256").agg(F.any_value("content").alias("content"))
    return first.join(store.select("sha256"), "sha256", "left_anti")
