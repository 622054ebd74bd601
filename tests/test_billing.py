"""Usage billing: what is billed, the gate, resending."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statera.operators import billing, idempotent

T0 = dt.datetime(2024, 1, 1)
CUTOFF = dt.datetime(2024, 1, 10)


def tables(spark):
    hour = lambda k: T0 + dt.timedelta(hours=k)
    rows = [(1, 1, hour(1), None), (2, 1, hour(5), None), (3, 1, CUTOFF, None), (4, 1, CUTOFF + dt.timedelta(seconds=1), None), (5, 2, hour(2), None), (6, 3, hour(2), None), (7, 4, hour(2), "old"), (8, 4, hour(3), None), (9, None, hour(3), None), (10, 1, None, None)]
    events = spark.createDataFrame(rows, "id long, user_id long, at timestamp, report_id string")
    users = spark.createDataFrame([(1, "c1"), (2, None), (3, "c3"), (4, "c4"), (5, "c5")], "user_id long, customer_id string")
    subscriptions = spark.createDataFrame([(1, "active"), (1, "trialing"), (2, "active"), (3, "ended"), (4, "trialing"), (5, "active")], "user_id long, status string")
    return events, users, subscriptions


def test_reports_and_stamps(spark, tmp_path):
    events, users, subscriptions = tables(spark)
    billable = billing.billable_users(users, subscriptions)
    root = f"file://{tmp_path}/b"
    billing.publish(events, billable, CUTOFF, root, "one")
    made = idempotent.current(spark, root, "reports")
    assert sorted((r.user_id, r.quantity, r.period_start, r.period_end) for r in made.collect()) == [(1, 3, T0 + dt.timedelta(hours=1), CUTOFF), (4, 1, T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=3))]
    after = idempotent.current(spark, root, "events")
    by_id = {r.id: r.report_id for r in after.collect()}
    names = {r.user_id: r.report_id for r in made.collect()}
    assert by_id == {1: names[1], 2: names[1], 3: names[1], 4: None, 5: None, 6: None, 7: "old", 8: names[4], 9: None, 10: None}

    # another pass bills nothing twice, and what was refused goes out again under its id
    billing.publish(after, billable, CUTOFF, root, "two", made)
    again = idempotent.current(spark, root, "reports")
    assert sorted(r.report_id for r in again.collect()) == sorted(names.values())
    accepted = spark.createDataFrame([(names[1], CUTOFF), (names[1], T0)], "report_id string, at timestamp")
    open_ = billing.settled(again, accepted)
    assert [(r.report_id, r.customer_id, r.quantity) for r in billing.pending(open_, users).collect()] == [(names[4], "c4", 1)]
    later = billing.settled(open_, accepted.withColumn("at", F.lit(CUTOFF)))
    assert later.where("user_id = 1").collect()[0].reported_at == T0


def test_mismatch_publishes_nothing(spark, tmp_path, monkeypatch):
    events, users, subscriptions = tables(spark)
    billable = billing.billable_users(users, subscriptions)
    root = f"file://{tmp_path}/b"
    billing.publish(events, billable, CUTOFF, root, "one")
    before = sorted(map(str, idempotent.current(spark, root, "events").collect()))
    real = billing.stamped
    # an event that came between counting and stamping
    late = spark.createDataFrame([(11, 1, T0, None)], events.schema)
    monkeypatch.setattr(billing, "stamped", lambda e, made, cutoff: real(e.unionByName(late), made, cutoff))
    with pytest.raises(billing.Mismatch, match="counted 3, stamped 4"):
        billing.publish(events, billable, CUTOFF, root, "two")
    monkeypatch.setattr(billing, "stamped", lambda e, made, cutoff: real(e.where("id <> 8"), made, cutoff))
    with pytest.raises(billing.Mismatch, match="counted 1, stamped 0"):
        billing.publish(events, billable, CUTOFF, root, "three")
    assert sorted(map(str, idempotent.current(spark, root, "events").collect())) == before


def test_empty(spark, tmp_path):
    events, users, subscriptions = tables(spark)
    none = events.where("id < 0")
    assert billing.reports(none, billing.billable_users(users, subscriptions), CUTOFF).count() == 0
    billing.publish(none, billing.billable_users(users, subscriptions), CUTOFF, f"file://{tmp_path}/e", "one")
    assert idempotent.current(spark, f"file://{tmp_path}/e", "reports").count() == 0
