"""Exact dedup with a heavy-hitter split, DataFrame functions only.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; equality is decided on the SHA-256 of that
normalised text.  A Misra-Gries style frequent-items sketch (``approx_top_k``) runs over the digests, first per group
of partitions, then over those few sketches.  The at most ``tracked`` digests it names are verified: their exact
counts and winners are aggregated with map-side combine and broadcast (at most ``tracked`` rows, whatever the input),
so copies of frequent texts are settled where they are read.  All other digests, each of which holds at most about
``rows / tracked`` rows, go through one ordinary shuffle.  The sketch never decides a result: a digest that it misses
or names wrongly only takes the other path.

Defined results: null texts count as empty, so all empty, blank and null texts are one group; of equal texts the one
with most code points stays, then the smallest ``doc_id`` (null ids last); rows repeated with the same id and length
count as several members of the group and exactly one of them stays; an empty table gives an empty result; other
columns of the input are ignored by :func:`decide` and carried by :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

TRACKED = 4096
SKETCH_GROUPS = 64


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One narrow row per document: row_id, unique in this frame (column ``row`` if given), doc_id, code points, digest."""
    text = shared.whole_text()
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"),
        "doc_id",
        F.char_length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, shared.SPACE + "+", ""), 256).alias("text_sha256"),
    )


def heavy_digests(narrow: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """At most ``tracked`` digests that the frequent-items sketch reports more than once."""
    part = narrow.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {int(tracked)})").alias("sketch")
    )
    # grouped by a constant that is no literal: tasks without a sketch then have no buffer to merge
    top = part.groupBy(F.col("part").isNull()).agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"))
    top = top.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(tracked)})")).alias("t"))
    return top.where("t.count > 1").select(F.col("t.item").alias("text_sha256"))


def decide(narrow: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Add keep_id, group_size and kept to the rows of :func:`digests`; ``narrow`` should be a stored table."""
    rank = F.struct("n_points", F.bitwise_not("doc_id").alias("i"), F.bitwise_not("row_id").alias("r"))
    heavy = shared.stored(heavy_digests(narrow, tracked), "heavy")
    winners = (
        narrow.join(F.broadcast(heavy), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    )
    winners = shared.stored(winners, "winners")
    frequent = narrow.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    others = narrow.join(F.broadcast(heavy), "text_sha256", "left_anti").select(
        "*", F.max(rank).over(group).alias("best"), F.count("*").over(group).alias("group_size")
    )
    return frequent.unionByName(others).select(
        "row_id",
        "doc_id",
        F.bitwise_not("best.i").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.bitwise_not("best.r") == F.col("row_id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = shared.fresh("row_id", docs)
    tagged = shared.stored(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    narrow = shared.stored(digests(tagged, row), "digests")
    # what goes is narrow and rarely much, so texts stay where they are unless it is too much to broadcast
    dropped = shared.stored(decide(narrow, tracked).where("NOT kept").select(F.col("row_id").alias(row)), "dropped")
    return tagged.join(dropped, row, "left_anti").select(*docs.columns)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    narrow = shared.stored(digests(shared.documents(spark, sf_dir)), "digests")
    return decide(narrow).drop("row_id")


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, first(doc_id ORDER BY n_points DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
