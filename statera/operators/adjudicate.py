"""Verdicts of reviewers on records, as one plan: what each attempt does, states, superseding rows, events, audit.

A confirmation makes an unverified record verified, a rejection makes it disputed; neither applies to a record in any
other state.  An edit never touches the record: it appends a row in state corrected that supersedes it, whatever the
record's state, after redaction, checks and its own fingerprint.  A task is resolved by its first attempt that applies.
Attempts are taken in the order of (at, attempt_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import publish, trust

# Fixed values of the domain: what a verdict makes of an unverified record, and the state of a superseding row.
MOVES = {"confirm": "verified", "reject": "disputed"}
CORRECTED = "corrected"


@dataclass
class Adjudicated:
    states: DataFrame  #: id, verification_state of all records after all attempts
    audit: DataFrame  #: attempt_id, task_id, record_id, verdict, outcome (applied, conflict or failed), reason
    corrections: DataFrame  #: rows to append, with fingerprint, supersedes_record_id and verification_state
    events: DataFrame  #: record_fingerprint, superseded, task_id: one for each row appended
    resolved: DataFrame  #: task_id, verdict of the attempt that resolved it


def adjudicate(records: DataFrame, attempts: DataFrame, known: DataFrame, columns: list[str], checks: list[tuple[Column, str]], pinned: tuple[str, ...] = ("filing_id", "politician_id", "regime_id")) -> Adjudicated:
    """What these attempts would write.

    ``records``: id, verification_state and the ``pinned`` columns, which a superseding row takes from its original.
    ``attempts``: attempt_id, task_id, task_status, record_id, verdict (confirm, reject or edit), at, and for edits
    regime_code, details (map) and ``columns``, the corrected content.  ``known``: fingerprints that exist; a correction
    with one of them is applied but appends nothing and tells nobody.
    """
    order = F.struct("at", "attempt_id")
    own = records.select(F.col("id").alias("record_id"), F.col("verification_state").alias("was"), *pinned)
    a = attempts.join(own, "record_id", "left").withColumn("order", order)
    edit = F.col("verdict") == "edit"
    a = a.withColumn("suppress", F.when(edit, publish.kept_back())).withColumn("details", publish.public_details())
    breach = F.coalesce("suppress", F.nullif(trust.verdict(checks), F.lit("ok")))
    a = a.withColumn("invalid", F.when(F.col("was").isNull(), "missing_record").when(edit, breach))
    open_ = F.col("task_status") == "open"
    # the first valid edit resolves its task unless a verdict on the record, of the same task, came before it
    edits = a.where(open_ & edit & F.col("invalid").isNull()).groupBy("task_id").agg(F.min("order").alias("edited"))
    a = a.join(edits, "task_id", "left")
    moving = open_ & ~edit & (F.col("was") == "unverified") & (F.col("edited").isNull() | (F.col("order") < F.col("edited")))
    moved = a.where(moving).groupBy("record_id").agg(F.min("order").alias("moved"), F.min_by("task_id", "order").alias("moved_by"), F.min_by("verdict", "order").alias("move"))
    a = a.join(moved, "record_id", "left")
    closed = (F.col("edited") < F.col("order")) | ((F.col("moved_by") == F.col("task_id")) & (F.col("moved") < F.col("order")))
    outcome = (
        F.when(~open_ | F.coalesce(closed, F.lit(False)), "conflict").when(F.col("invalid").isNotNull(), "failed")
        .when(edit | F.coalesce(F.col("order") == F.col("moved"), F.lit(False)), "applied").otherwise("failed")
    )
    a = a.withColumn("outcome", outcome)
    a = a.withColumn("reason", F.when(F.col("outcome") == "conflict", "task_resolved").when(F.col("outcome") == "failed", F.coalesce("invalid", F.lit("not_unverified"))))
    states = records.join(moved.select(F.col("record_id").alias("id"), "move"), "id", "left")
    move = F.lit(None).cast("string")
    for verdict, state in MOVES.items():
        move = F.when(F.col("move") == verdict, state).otherwise(move)
    states = states.select("id", F.coalesce(move, "verification_state").alias("verification_state"))
    rows = a.where((F.col("outcome") == "applied") & edit)
    body = publish.content([*pinned, *columns])
    rows = rows.withColumn("fingerprint", publish.correction_fingerprint(F.col("record_id"), body))
    # equal corrections of one record are one row, told by the first of them
    first = rows.groupBy("fingerprint").agg(F.min("order").alias("first"))
    rows = rows.join(first, "fingerprint").where(F.col("order") == F.col("first")).join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    corrections = rows.select("attempt_id", "task_id", *pinned, *columns, "details", "fingerprint", F.col("record_id").alias("supersedes_record_id"), F.lit(CORRECTED).alias("verification_state"))
    resolved = a.where("outcome = 'applied'").select("task_id", "verdict")
    audit = a.select("attempt_id", "task_id", "record_id", "verdict", "outcome", "reason")
    return Adjudicated(states, audit, corrections, corrections.select(F.col("fingerprint").alias("record_fingerprint"), F.col("supersedes_record_id").alias("superseded"), "task_id"), resolved)
