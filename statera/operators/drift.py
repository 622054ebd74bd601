"""Drift of watched sources: what each pass found, reports with their detections, freezing and recovery.

A pass is judged against its source's baseline, the last healthy page.  A healthy page has the layout of the first one
and never fewer entries than the baseline, so the baseline before a pass is that layout and a running maximum: a scan,
not a loop, and sources of any number of passes split over ranges.

A drift is filed once while its report is open; seen again it only counts.  A report that freezes publication is
resolved by the next pass without drift, and the same drift later is a new report; other reports stay open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments, trust


def classified(passes: DataFrame) -> DataFrame:
    """``passes`` (source, pass, status, markers, entries, layout) with kind, score, freeze and dedup_key; kind is none for a healthy or unchanged page."""
    seen = (F.col("status") >= 200) & (F.col("status") <= 299) & F.col("markers")
    first = passes.where(seen).groupBy(F.col("source").alias("_source")).agg(F.min_by("layout", "pass").alias("base_layout"), F.min("pass").alias("base_from"))
    rows = passes.join(first, F.col("source") == F.col("_source"), "left").drop("_source")
    alike = F.coalesce(seen & (F.col("layout") == F.col("base_layout")), F.lit(False))
    rows = segments.running(rows, "source", ["pass"], {"base_entries": ("max", F.when(alike, F.col("entries")))})
    layout = F.when(F.col("pass") > F.col("base_from"), F.col("base_layout"))
    kind = trust.drift(F.col("status"), F.col("markers"), F.col("entries"), F.col("layout"), F.col("base_entries"), layout)
    rows = rows.withColumn("kind", kind)
    return rows.select(*passes.columns, "kind", *trust.drift_report(F.col("kind"), F.col("source"), F.col("status"), F.col("layout")))


def reports(passes: DataFrame) -> DataFrame:
    """One row a report: source, dedup_key, opened, kind, score, freeze, detections, last_pass, resolved (the pass that did, or null)."""
    healthy = F.col("kind") == "none"
    rows = segments.running(classified(passes), "source", ["pass"], {"before": ("sum", F.when(healthy, 1).otherwise(0))})
    rows = rows.withColumn("episode", F.coalesce("before", F.lit(0)))
    # between two healthy passes lies one episode; reports that do not freeze run through all of them
    found = rows.where(~healthy).groupBy("source", "dedup_key", F.when(F.col("freeze"), F.col("episode")).alias("episode")).agg(
        F.min("pass").alias("opened"), F.first("kind").alias("kind"), F.first("score").alias("score"), F.first("freeze").alias("freeze"), F.count("*").alias("detections"), F.max("pass").alias("last_pass")
    )
    recovered = rows.where(healthy).select("source", "episode", F.col("pass").alias("resolved"))
    out = found.join(recovered, ["source", "episode"], "left")
    return out.select("source", "dedup_key", "opened", "kind", "score", "freeze", "detections", F.coalesce("resolved", "last_pass").alias("last_pass"), "resolved")
