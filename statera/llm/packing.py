"""Packing into optimal length buckets.

Lengths are rounded up to ``align``; a dynamic program over the global histogram of those lengths chooses at most
``buckets`` upper bounds so that the total padding, every document padded to its bucket's bound, is least.  The
histogram has at most ``budget / align`` cells whatever the input, because a document longer than the token budget of
a batch gets a batch of its own and needs no bucket.  Inside a bucket, documents in hash-random order fill batches of
``budget // bound`` documents.  Positions are a distributed prefix count over ranges of the hash key, so a bucket with
a third of all documents is spread over many tasks.

Defined results: null and empty texts have length 0 and are padded to ``align``; ties of the hash key go by doc_id
(null first), then length; repeated rows get positions of their own; an empty table gives an empty result; other
columns are ignored by :func:`pack`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .mixing import key

BUCKETS = 16
ALIGN = 8
BUDGET = 65_536
ROWS_PER_RANGE = 50_000


def bucket_bounds(lengths, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padded length; ``lengths`` ascend.

    best[i] after k rounds is the least total for the first i cells in k buckets; ties take the earliest split.
    """
    lengths, upto = np.asarray(lengths, np.int64), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    m = len(lengths)
    far = np.int64(2**62)
    best = np.full(m + 1, far)
    best[0] = 0
    splits = []
    for _ in range(min(buckets, m)):
        new, split = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        for lo in range(0, m, 256):  # cells i = lo + 1 .. hi at once against all j < i
            hi = min(m, lo + 256)
            i = np.arange(lo + 1, hi + 1)
            j = np.arange(hi)
            cost = np.where((j[None, :] < i[:, None]) & (best[:hi] < far)[None, :], best[None, :hi] + lengths[i - 1][:, None] * (upto[i][:, None] - upto[None, :hi]), far)
            split[i] = cost.argmin(1)
            new[i] = cost.min(1)
        best = new
        splits.append(split)
    bounds, i = [], m
    for split in reversed(splits):
        bounds.append(int(lengths[i - 1]))
        i = int(split[i])
    return bounds[::-1]


def pack(sized: DataFrame, length: str = "n_tokens", buckets: int = BUCKETS, align: int = ALIGN, budget: int = BUDGET) -> DataFrame:
    """doc_id, length, bucket, padded_length, batch, slot for each row of ``sized`` (doc_id and a length; a stored table)."""
    spark = sized.sparkSession
    n = F.col(length)
    aligned = F.greatest(F.ceil(n / align) * align, F.lit(align)).cast("long")
    cells = sized.select(aligned.alias("cell")).where(F.col("cell") <= budget).groupBy("cell").count().orderBy("cell").collect()
    bounds = bucket_bounds([r["cell"] for r in cells], [r["count"] for r in cells], buckets) if cells else []
    bound = F.coalesce(*[F.when(F.col("cell") <= b, F.lit(b).cast("long")) for b in bounds], F.col("cell"))
    bucket = F.coalesce(*[F.when(F.col("cell") <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(len(bounds)))
    ranges = max(1, sized.count() // ROWS_PER_RANGE)
    digits = max(2, len(f"{ranges - 1:x}"))
    keyed = sized.select("doc_id", n.alias("n_tokens"), key().alias("key"), aligned.alias("cell")).select(
        "*", bucket.alias("bucket"), bound.alias("padded_length"), F.substring("key", 1, digits).alias("part")
    )
    parts = keyed.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shared.stored(parts.select("bucket", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")), "parts")
    inside = Window.partitionBy("bucket", "part").orderBy("key", "doc_id", "n_tokens")
    placed = keyed.withColumn("rank", F.row_number().over(inside).cast("long")).join(parts, ["bucket", "part"])
    place = F.col("rank") + F.col("offset") - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded_length")), F.lit(1)).cast("long")
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_length", F.floor(place / room).cast("long").alias("batch"), (place % room).alias("slot")
    )


def op3_length_buckets(spark, sf_dir: str) -> DataFrame:
    """Length: words of the text."""
    sized = shared.documents(spark, sf_dir).select("doc_id", shared.n_words().alias("n_tokens"))
    return pack(shared.stored(sized, "sized"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
a AS (
  SELECT *, greatest((n_tokens + {ALIGN - 1}) // {ALIGN} * {ALIGN}, {ALIGN}) AS cell FROM d),
h AS (
  SELECT cell, row_number() OVER (ORDER BY cell) AS i, CAST(sum(count(*)) OVER (ORDER BY cell) AS BIGINT) AS upto
  FROM a WHERE cell <= {BUDGET} GROUP BY cell),
best AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS upto, CAST(0 AS BIGINT) AS cost, CAST([] AS BIGINT[]) AS bounds
  UNION ALL
  SELECT any_value(b.k) + 1, h.i, any_value(h.upto), min(b.cost + h.cell * (h.upto - b.upto)),
         first(list_append(b.bounds, h.cell) ORDER BY b.cost + h.cell * (h.upto - b.upto), b.i)
  FROM best b JOIN h ON h.i > b.i
  WHERE b.k < {BUCKETS} GROUP BY h.i),
chosen AS (
  SELECT bounds FROM best WHERE i = (SELECT coalesce(max(i), 0) FROM h) ORDER BY k DESC LIMIT 1),
p AS (
  SELECT a.*, len(list_filter(bounds, lambda x: x < cell)) AS bucket, coalesce(list_min(list_filter(bounds, lambda x: x >= cell)), cell) AS padded_length
  FROM a CROSS JOIN chosen),
r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id, n_tokens) - 1 AS place, greatest({BUDGET} // padded_length, 1) AS room FROM p)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(padded_length AS BIGINT) AS padded_length,
       CAST(place // room AS BIGINT) AS batch, CAST(place % room AS BIGINT) AS slot
FROM r
"""
