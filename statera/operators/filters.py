"""The record filter: a conjunction of optional clauses, and the predicates it is made of."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecordFilter:
    """Unset slots add no clause, so the plan holds only what was asked for and all of it can reach the scan."""

    jurisdiction: str | None = None
    record_type: str | None = None
    asset_class: str | None = None
    politician: str | None = None
    instrument: str | None = None
    event_from: dt.date | None = None
    event_to: dt.date | None = None
    min_cents: int | None = None
    max_cents: int | None = None
    verification_state: str | None = None
    visible_until: dt.datetime | None = None

    def __post_init__(self):
        if self.min_cents is not None and self.max_cents is not None and self.min_cents > self.max_cents:
            raise ValueError("min_cents exceeds max_cents")

    def column(self) -> Column:
        clauses = [F.col(c) == v for c, v in (("record_type", self.record_type), ("asset_class", self.asset_class), ("politician_id", self.politician), ("instrument_id", self.instrument), ("verification_state", self.verification_state)) if v is not None]
        if self.event_from is not None:
            clauses.append(F.col("event_date") >= F.lit(self.event_from))
        if self.event_to is not None:
            clauses.append(F.col("event_date") <= F.lit(self.event_to))
        if self.min_cents is not None:
            clauses.append(at_least(self.min_cents))
        if self.max_cents is not None:
            clauses.append(at_most(self.max_cents))
        if self.visible_until is not None:
            clauses.append(visible(self.visible_until))
        return reduce(lambda a, b: a & b, clauses, F.lit(True))

    def apply(self, records: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
        out = records.where(self.column())
        if self.jurisdiction is not None:
            inside = regimes.where(F.col("jurisdiction_id") == self.jurisdiction).select(F.col("id").alias("regime_id"))
            out = out.join(inside, "regime_id", "left_semi")
        return out


def at_least(cents: int | Column) -> Column:
    """The value interval reaches ``cents``; an open interval reaches everything, no value nothing."""
    return F.col("low_cents").isNotNull() & (F.col("high_cents").isNull() | (F.col("high_cents") >= cents))


def at_most(cents: int | Column) -> Column:
    return F.col("low_cents").isNotNull() & (F.col("low_cents") <= cents)


def visible(until: dt.datetime) -> Column:
    """Discovered by the bound of the reader's tier; the bound is a parameter, never the clock."""
    return F.col("discovered_at") <= F.lit(until).cast("timestamp_ntz")


def contains_text(column: str | Column, needle: str) -> Column:
    """Case-insensitive literal substring: pattern characters in the needle stand for themselves."""
    return F.contains(F.lower(F.col(column) if isinstance(column, str) else column), F.lit(needle.lower()))


def documents_of(filings: DataFrame, documents: DataFrame, records: DataFrame, reader: RecordFilter) -> DataFrame:
    """Filings with their archived document, those only of which the reader sees a record."""
    seen = reader.apply(records).select(F.col("filing_id").alias("id"))
    return filings.join(seen, "id", "left_semi").join(documents.withColumnRenamed("id", "raw_document_id"), "raw_document_id")


def name_or_alias(politicians: DataFrame, aliases: DataFrame, needle: str) -> DataFrame:
    """Entities whose name or any alias contains the needle, each once."""
    hit = aliases.where(contains_text("alias", needle)).select(F.col("politician_id").alias("id"), F.lit(True).alias("by_alias")).distinct()
    return politicians.join(hit, "id", "left").where(contains_text("canonical_name", needle) | F.coalesce("by_alias", F.lit(False))).drop("by_alias")


def guarded_int(text: Column) -> Column:
    """The number if the text is digits only, else null; no cast of anything else is tried."""
    return F.when(text.rlike("^[0-9]+$"), text.cast("long"))


def claimable(tasks: DataFrame, leases: DataFrame) -> DataFrame:
    """Open tasks that nobody holds: no live lease, and no lease on another task of the same target."""
    live = leases.where("live").select("task_id", "target_id")
    out = tasks.where("status = 'open'").join(live.select(F.col("task_id").alias("id")), "id", "left_anti")
    return out.join(live.select("target_id").distinct(), "target_id", "left_anti")
