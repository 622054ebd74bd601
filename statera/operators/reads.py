"""What readers ask for, composed: a record with provenance and chain, a politician's profile, the review queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins
from .filters import RecordFilter
from .staging import stored


def chain_of_few(records: DataFrame, starts: DataFrame, up: bool = True) -> DataFrame:
    """(start_id, id, depth) of the chains of a few records, hop by hop: each hop is one pass over ``records``, two narrow columns.

    For all records ``chains.chain_up`` and ``chain_down`` need fewer passes.  A chain that comes back is refused.
    """
    links = records.where("supersedes_record_id IS NOT NULL").select(F.col("id").alias("newer"), F.col("supersedes_record_id").alias("older"))
    at, to = ("newer", "older") if up else ("older", "newer")
    known = [stored(starts.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("depth")), "starts")]
    while not known[-1].isEmpty():
        last = known[-1]
        step = last.join(links, last["id"] == links[at]).select("start_id", F.col(to).alias("id"), (F.col("depth") + 1).alias("depth"))
        so_far = reduce(DataFrame.unionByName, known)
        known.append(stored(step.join(records.select("id"), "id", "left_semi").select("start_id", "id", "depth"), "hop"))
        if not known[-1].join(so_far, ["start_id", "id"], "left_semi").isEmpty():
            raise ValueError("a chain of records comes back to one of its own")
    return reduce(DataFrame.unionByName, known)


def record_details(records: DataFrame, starts: DataFrame, filings: DataFrame, documents: DataFrame, regimes: DataFrame, reader: RecordFilter) -> DataFrame:
    """The records ``starts`` that the reader may see, each with its filing, document and regime, and the visible records of its chain.

    ``supersedes`` and ``superseded_by`` are arrays of (depth, id), nearest first; hidden members are walked through, not
    shown.  A record whose filing, document or regime is missing is not shown with a hole: the query fails.
    """
    seen = stored(reader.apply(starts), "seen")
    visible = stored(reader.apply(records).select("id"), "visible")
    links = stored(records.select("id", "supersedes_record_id"), "links")

    def members(up: bool, name: str) -> DataFrame:
        chain = chain_of_few(links, seen, up).where("depth > 0").join(visible, "id", "left_semi")
        return chain.groupBy(F.col("start_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("depth", "id"))).alias(name))

    f = filings.select(F.col("id").alias("filing_id"), F.struct("id", "filed_date", "raw_document_id").alias("filing"))
    doc = documents.select(F.col("id").alias("document_id"), F.struct("id", "url", "sha").alias("document"))
    g = regimes.select(F.col("id").alias("regime_id"), F.struct("id", "code").alias("regime"))
    out = seen.join(f, "filing_id", "left").join(doc, F.col("filing.raw_document_id") == F.col("document_id"), "left").drop("document_id").join(g, "regime_id", "left")
    whole = F.col("filing").isNotNull() & F.col("document").isNotNull() & F.col("regime").isNotNull()
    out = out.withColumn("filing", F.when(whole, F.col("filing")).otherwise(F.raise_error(F.concat(F.lit("record without provenance: "), "id"))))
    none = F.array().cast("array<struct<depth:int,id:string>>")
    for up, name in ((True, "supersedes"), (False, "superseded_by")):
        out = out.join(members(up, name), "id", "left").withColumn(name, F.coalesce(name, none))
    return out


def profiles(politicians: DataFrame, aliases: DataFrame, filings: DataFrame, records: DataFrame) -> DataFrame:
    """Politicians with their aliases (sorted), numbers of filings and records, and the day of the latest filing."""
    named = joins.nest(politicians, aliases.select(F.col("politician_id").alias("id"), "alias").distinct(), ["id"], ["alias"], [], "aliases")
    named = named.withColumn("aliases", F.transform("aliases", lambda a: a["alias"]))
    filed = filings.groupBy(F.col("politician_id").alias("id")).agg(F.count("*").alias("filings"), F.max("filed_date").alias("last_filed"))
    held = records.groupBy(F.col("politician_id").alias("id")).agg(F.count("*").alias("records"))
    return named.join(filed, "id", "left").join(held, "id", "left").fillna(0, ["filings", "records"])


def review_queue(tasks: DataFrame, records: DataFrame, filings: DataFrame, regimes: DataFrame, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """Open tasks with the regime they concern, most urgent first, then oldest, then by id; the page after (priority, created_at, id).

    limit + 1 rows: the surplus one only says that another page follows.  A task whose target is gone has no regime.
    """
    open_ = tasks.where("status = 'open'")
    if after is not None:
        priority, at, last = after
        at = F.lit(at).cast(dict(tasks.dtypes)["created_at"])
        same = F.col("priority") == priority
        open_ = open_.where((F.col("priority") < priority) | (same & (F.col("created_at") > at)) | (same & (F.col("created_at") == at) & (F.col("id") > last)))
    page = stored(open_.orderBy(F.desc("priority"), "created_at", "id").limit(limit + 1), "page")
    lines = records.select("id", "regime_id")
    arms = joins.routed(page, {"disclosure_record": (lines, "id"), "filing": (filings, "id")})
    codes = page.where("target_kind = 'regime'").select("id", F.split_part("target_id", F.lit(":"), F.lit(1)).alias("regime_id"))
    found = arms.unionByName(codes).join(regimes.select(F.col("id").alias("regime_id"), "code"), "regime_id")
    return page.join(found.select("id", "regime_id", F.col("code").alias("regime_code")), "id", "left").orderBy(F.desc("priority"), "created_at", "id")
