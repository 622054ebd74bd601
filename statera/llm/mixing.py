"""Mixing sources to target weights, DataFrame functions only.

Every source gets a target number of words: shares of the total by weight, where a source whose share exceeds
``max_epochs`` times its own size is held there and the excess is shared again by weight.  Which documents are taken
follows from a hash-random order: the MD5 of ``doc_id`` is the key, documents are range-split by the leading hex
digits of that key within each source, sorted inside each range, and a distributed prefix sum (range totals, their
running sums, running sums inside the range) finds the document at which the source's budget is used up.  Only that
cut, one row per source, goes back to the documents: whole epochs first, then everything before the cut once more, the
document at the cut in part.  No document text is shuffled.

Defined results: null sources are one source, ordered last; null and empty texts have size 0 and take 0 words; ties
(repeated rows of one id and size) at the cut share what is left evenly, rounded down; a null ``doc_id`` has the key
of the empty string; a table without words takes nothing; other columns are ignored by :func:`plan` and carried by
:func:`take`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
ROWS_PER_RANGE = 50_000


def key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target.  Windows run over the sources, not the documents."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_source) - 1) % len(weights) + 1)
    s = s.select("source", "source_size", w.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    fits = F.col("left").cast("decimal(38,0)") * F.col("weight") <= F.col("cap").cast("decimal(38,0)") * F.col("open_weight")
    level = lambda c: F.first(F.when(fits, F.col(c)), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    )
    s = s.select("*", level("left").alias("l"), level("open_weight").alias("o"))
    share = (F.col("weight") * F.col("l")).cast("double") / F.col("o").cast("double")
    return s.select("source", "source_size", "weight", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: what it holds, its target, whole epochs, and where the last epoch is cut.

    ``sized`` has doc_id, source, size and should be a stored table; it is read three times.
    """
    goals = targets(sized, weights, max_epochs)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    goals = goals.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("source_size") > 0, whole % F.greatest("source_size", F.lit(1))).otherwise(0).cast("long").alias("rest"),
    )
    goals = shared.stored(goals, "targets")
    ranges = max(1, sized.count() // ROWS_PER_RANGE)
    digits = max(2, len(f"{ranges - 1:x}"))
    keyed = sized.where("size > 0").select("source", key().alias("key"), "doc_id", "size").withColumn("part", F.substring("key", 1, digits))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", "words", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    open_parts = parts.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    # the one range of each source in which its budget ends
    open_parts = shared.stored(
        open_parts.where("rest > offset AND rest <= offset + words").select("p.source", "part", (F.col("rest") - F.col("offset")).alias("left")), "ranges"
    )
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    cut = (
        keyed.alias("r")
        .join(open_parts.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.part") == F.col("o.part")))
        .groupBy("r.source", "key", "doc_id", "size", "left")
        .agg(F.count("*").alias("copies"))
        .withColumn("words", F.col("size") * F.col("copies"))
        .withColumn("upto", F.sum("words").over(inside))
        .where("upto >= left AND upto - words < left")
        .select(
            F.col("source").alias("cut_source"),
            F.struct("key", "doc_id", "size").alias("cut"),
            F.floor((F.col("left") - F.col("upto") + F.col("words")) / F.col("copies")).cast("long").alias("at_cut"),
        )
    )
    out = goals.join(cut, goals["source"].eqNullSafe(cut["cut_source"]), "left").drop("cut_source", "rest")
    return shared.stored(out, "mix")


def taken(docs: DataFrame, mix: DataFrame, size: str = "size") -> DataFrame:
    """``docs`` with source_size, target and taken; ``mix`` is small, so Spark broadcasts it while its size allows."""
    m = mix.select(F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut", "at_cut")
    me = F.struct(key().alias("key"), "doc_id", F.col(size).alias("size"))
    part = F.when(F.col("cut").isNull() | (F.col(size) == 0), 0).when(me < F.col("cut"), F.col(size)).when(me == F.col("cut"), F.col("at_cut")).otherwise(0)
    return docs.join(m, docs["source"].eqNullSafe(m["mix_source"])).select(
        *[docs[c] for c in docs.columns], "source_size", "target", (F.col("epochs") * F.col(size) + part).cast("long").alias("taken")
    )


def take(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed documents: each as many times as epochs reach it, the document at the cut whole."""
    narrow = shared.stored(docs.select("doc_id", "source", shared.n_words().alias("size")), "sized")
    mix = plan(narrow, weights, max_epochs)
    size = shared.fresh("size", docs, mix)
    inner = docs.select(F.struct(*docs.columns).alias("d"), "doc_id", "source", shared.n_words().alias(size))
    out = taken(inner, mix, size).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col(size)).cast("int")
    return out.select("d", F.explode(F.sequence(F.lit(1), copies))).select("d.*")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    sized = shared.documents(spark, sf_dir).select("doc_id", "source", shared.n_words().alias("size"))
    sized = shared.stored(sized, "sized")
    return taken(sized, plan(sized)).select("doc_id", "size", "source_size", "target", "taken", "source")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
f AS (
  SELECT rest AS l, open_weight AS ow, CAST(cap AS DOUBLE) / weight AS ratio, source FROM o
  WHERE rest * weight <= cap * open_weight ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.rest * o.weight <= o.cap * o.open_weight
              THEN CAST(o.weight * f.l AS DOUBLE) / CAST(f.ow AS DOUBLE) ELSE CAST(o.cap AS DOUBLE) END AS target
  FROM o CROSS JOIN f),
b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
c AS (
  SELECT d.*, b.source_size, b.target, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken,
       source
FROM c
"""
