"""Usage billing: unbilled events rolled into reports and stamped, published together or not at all, then sent until accepted.

``publish`` writes reports and stamped events, reads both back and compares them report by report: a report that counts
other than the events that bear its id stops the batch before the pointer moves, so readers stay with the last one.  A
report's id follows from its user and first and last event; sending it again is the same report to the receiver.

Defined results: users without an open subscription or customer id, and events after the cutoff, without a time or
without a user, stay unbilled.  An event that has a report keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idempotent

#: fixed values of the domain: subscriptions whose usage is billed
BILLED = ("active", "trialing")


class Mismatch(ValueError):
    """Reports and stamped events of a batch do not agree."""


def billable_users(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """user_id and customer_id of users with a customer id and an open subscription, each once."""
    opened = subscriptions.where(F.col("status").isin(*BILLED))
    known = users.where("customer_id is not null").select("user_id", "customer_id")
    return known.join(opened.select("user_id"), "user_id", "left_semi")


def _open(events: DataFrame, cutoff) -> DataFrame:
    return events.where(F.col("report_id").isNull() & (F.col("at") <= F.lit(cutoff)))


def reports(events: DataFrame, billable: DataFrame, cutoff) -> DataFrame:
    """report_id, user_id, period_start, period_end and quantity of each billable user's unbilled events (id, user_id, at, report_id)."""
    rolled = _open(events, cutoff).groupBy("user_id").agg(F.min("at").alias("period_start"), F.max("at").alias("period_end"), F.count("*").alias("quantity"), F.min("id").alias("_first"), F.max("id").alias("_last"))
    rolled = rolled.join(billable.select("user_id"), "user_id", "left_semi")
    name = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("user_id", "_first", "_last")]), 256)
    return rolled.select(name.alias("report_id"), "user_id", "period_start", "period_end", "quantity")


def stamped(events: DataFrame, made: DataFrame, cutoff) -> DataFrame:
    """All events, those that reports count with the report's id."""
    ids = made.select("user_id", F.col("report_id").alias("_report"))
    fresh = F.when(F.col("at") <= F.lit(cutoff), F.col("_report"))
    return events.join(ids, "user_id", "left").withColumn("report_id", F.coalesce("report_id", fresh)).select(*events.columns)


def disagreements(made: DataFrame, events: DataFrame) -> DataFrame:
    """report_id, quantity and stamped of reports that count other than the events that bear their id."""
    found = events.where("report_id is not null").groupBy("report_id").agg(F.count("*").alias("stamped"))
    both = made.select("report_id", "quantity").join(found, "report_id", "left").withColumn("stamped", F.coalesce("stamped", F.lit(0)))
    return both.where("stamped <> quantity")


def _gate(tables: dict[str, DataFrame]) -> None:
    wrong = disagreements(tables["reports"], tables["events"]).limit(5).collect()
    if wrong:
        raise Mismatch("; ".join(f"report {r.report_id}: counted {r.quantity}, stamped {r.stamped}" for r in wrong))


def publish(events: DataFrame, billable: DataFrame, cutoff, root: str, batch: str, earlier: DataFrame | None = None) -> None:
    """Reports (those of ``earlier`` kept) and stamped events as one batch; raises ``Mismatch`` and publishes nothing if they disagree.

    A batch that runs again after its events were stamped finds nothing more to bill and writes the same tables.
    """
    made = reports(events, billable, cutoff).withColumn("reported_at", F.lit(None).cast("timestamp"))
    kept = made if earlier is None else earlier.unionByName(made)
    idempotent.publish({"reports": kept, "events": stamped(events, made, cutoff)}, root, batch, _gate)


def pending(made: DataFrame, users: DataFrame) -> DataFrame:
    """report_id, customer_id and quantity to send: reports not accepted so far, of earlier batches too."""
    known = users.where("customer_id is not null").select("user_id", "customer_id")
    return made.where("reported_at is null").join(known, "user_id").select("report_id", "customer_id", "quantity")


def settled(made: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reports with the time of the first acceptance (report_id, at); one already accepted keeps its time, a refused one stays open."""
    first = accepted.groupBy("report_id").agg(F.min("at").alias("_at"))
    return made.join(first, "report_id", "left").withColumn("reported_at", F.coalesce("reported_at", "_at")).select(*made.columns)

