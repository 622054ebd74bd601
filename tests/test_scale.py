"""Operators that split large groups: selection, carried values, the rule index, stitched lines, verdicts."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from statera.operators import adjudicate, joins, segments, selection, stitch


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[int(at)], values[min(int(at) + (at > int(at)), len(values) - 1)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize(("most", "grid"), [(1 << 20, 128), (10, 8), (50, 32), (1, 16)])
def test_percentiles_by_selection(spark, most, grid):
    r = random.Random(3)
    rows = [("hot", float(r.gauss(0, 100))) for _ in range(3000)] + [("ties", float(r.choice([1, 1, 1, 2, 9]))) for _ in range(500)] + [("same", 7.0)] * 200
    rows += [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0)] + [("skew", float(k**4)) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(4)
    found = {row.g: (row.p50, row.p95, row.p0) for row in selection.percentiles(frame, ["g"], "x", (0.5, 0.95, 0.0), most=most, grid=grid).collect()}
    assert found.keys() == {g for g, _ in rows}
    assert found["none"] == (None, None, None)
    for g in found.keys() - {"none"}:
        values = [x for k, x in rows if k == g]
        assert found[g] == pytest.approx(tuple(interpolated(values, p) for p in (0.5, 0.95, 0.0)))
    assert found["hot"][0] == pytest.approx(statistics.median(x for k, x in rows if k == "hot"))


def test_percentiles_of_some_rows(spark):
    frame = spark.createDataFrame([("a", k, k % 2) for k in range(100)] + [("b", 1, 1)], "g string, x int, odd int")
    for most in (1000, 5):
        found = {r.g: r.p50 for r in selection.percentiles(frame, ["g"], "x", (0.5,), "odd = 0", most=most, grid=8).collect()}
        assert found == {"a": 49.0, "b": None}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_values_are_carried_across_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [("hot", k, r.choice([None, None, None, k])) for k in range(600)] + [(g, k, r.choice([None, k])) for g in ("a", "b", None) for k in range(5)] + [("never", k, None) for k in range(60)]
    frame = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    for inclusive in (False, True):
        values = {"last": (F.col("v"), F.col("v").isNotNull()), "lag": (F.col("v"), F.lit(True))}
        found = {(x.g, x.k): (x.last, x["lag"]) for x in segments.carried(frame, "g", ["k"], values, inclusive, ranges).collect()}
        assert len(found) == len(rows)
        last, before = {}, {}
        for g, k, v in sorted(rows, key=lambda x: (str(x[0]), x[1])):
            if not inclusive:
                assert found[g, k] == (last.get(g), before.get(g))
            before[g] = v
            last[g] = v if v is not None else last.get(g)
            if inclusive:
                assert found[g, k] == (last.get(g), before.get(g))


def matches(record, rule):
    i, kind, cls, state, low, high, day = record
    _, rkind, rcls, rstate, least, most, first, last = rule
    return (
        rkind in (None, kind) and rcls in (None, cls) and rstate in (None, state)
        and (least is None or low is not None and (high is None or high >= least)) and (most is None or low is not None and low <= most)
        and (first is None or day is not None and day >= first) and (last is None or day is not None and day <= last)
    )


def test_rule_index_equals_all_pairs(spark):
    r = random.Random(4)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(r.randrange(4000))
    amount = lambda: r.choice([None, 0, 1, 100, 4096, 10**5, 10**7, r.randrange(10**9)])
    records = []
    for k in range(400):
        low = amount()
        high = None if low is None or r.random() < 0.2 else low + r.choice([0, 5, 10**6])
        records.append((f"r{k}", r.choice("xyz"), r.choice(["c1", "c2", None]), r.choice(["verified", "disputed"]), low, high, r.choice([None, day()])))
    rules = []
    for k in range(120):
        first, last = r.choice([None, day()]), r.choice([None, day()])
        if first and r.random() < 0.5:
            last = first + dt.timedelta(r.randrange(-40, 900))
        rules.append((k, r.choice(["x", "y", None]), r.choice(["c1", None, None]), r.choice(["verified", None, None]), amount(), amount(), first, last))
    left = spark.createDataFrame(records, "id string, record_type string, asset_class string, verification_state string, low_cents long, high_cents long, event_date date")
    right = spark.createDataFrame(rules, "rule_id int, record_type string, asset_class string, verification_state string, min_cents long, max_cents long, event_from date, event_to date").withColumn("channels", F.array(F.lit("email")))
    want = sorted((u[0], e[0]) for u in rules for e in records if matches(e, u))
    assert len(want) > 200
    for most, few in ((10**6, 0), (1, 0), (10**6, 1000)):  # broadcast, joined on salted keys, and rules checked one by one
        found = joins.match_rules(left, right, ("x", "y", "z"), most, few)
        assert sorted((row.rule_id, row.record_id) for row in found.collect()) == want
    plan = joins.match_rules(left, right, ("x", "y", "z"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert joins.match_rules(left, right.limit(0), ("x",)).count() == 0


REPORT = """noise
T
ID Owner Asset Transaction
Type Date Notification
Date Amount Cap.
Gains >
$200?
0000012345 SP Long Name of
Filing ID #20001
iD owner  asset transaction
type Date Notification
Date amount
an Asset [ST] s (partial) 1/2/2020 01/09/2020 $100,001 -

Filing ID #20001
$250,000 gfedc
F S: New
Description: first
and second

Plain Thing P 3/1/2020 3/4/2020 Over $50,000,000
C : loose
* For the complete list of codes
after 1/1/2020 1/1/2020""".split("\n")


def lines_of(spark, documents):
    return spark.createDataFrame([(d, k, x) for d, lines in documents.items() for k, x in enumerate(lines)], "document string, position long, line string").repartition(3)


def test_lines_are_stitched(spark):
    found = stitch.stitch(lines_of(spark, {"a": REPORT})).orderBy("row").collect()
    assert [(r.row, r.row_id, r.owner_code, r.asset, r.asset_code, r.type, str(r.traded), str(r.notified), r.low_cents, r.high_cents) for r in found] == [
        (1, "0000012345", "SP", "Long Name of an Asset [ST]", "ST", "S (partial)", "2020-01-02", "2020-01-09", 10000100, 25000000),
        (2, None, None, "Plain Thing", None, "P", "2020-03-01", "2020-03-04", 5000000000, None),
    ]
    assert [(r.page_break, r.loose, r.filing_status, r.description, r.comments, r.location) for r in found] == [(True, True, "New", "first and second", None, None), (False, True, None, None, "loose", None)]


def test_one_breach_rejects_the_document(spark):
    def changed(at, *lines):
        k = next(i for i, x in enumerate(REPORT) if x.startswith(at))
        return [*REPORT[:k], *lines, *REPORT[k + 1 :]]

    cases = {
        "no_heading": changed("T", "X"), "no_end": changed("* For", "x"), "broken_header": changed("Gains", "x"), "unknown_type": changed("Plain", "Plain Q 3/1/2020 3/4/2020 $1,001 - $15,000"),
        "dates_without_amount": changed("Plain", "Plain P 3/1/2020 3/4/2020"), "unknown_amount": changed("Plain", "Plain P 3/1/2020 3/4/2020 $1 - $2"), "unknown_date": changed("Plain", "Plain P 13/1/2020 3/4/2020 $1,001 - $15,000"),
        "amount_not_continued": changed("$250,000", "more"), "label_amid_text": changed("F S", "some text", "F S: New"), "label_before_row": changed("0000012345", "F S: New", "x"), "repeated_label": changed("C :", "C: a", "C: b"),
        "unattached_text": changed("* For", "", "left over", "* For the complete list"), "no_asset": changed("Plain", "P 3/1/2020 3/4/2020 $1,001 - $15,000"),
    }
    frame = lines_of(spark, {**cases, "fine": REPORT})
    found = {r.document: r.reason for r in stitch.rejected(frame).collect()}
    assert found == {k: k for k in cases}
    assert {r.document for r in stitch.stitch(frame).collect()} == {"fine"}
    assert stitch.stitch(frame.limit(0)).count() == 0


def test_verdicts(spark):
    records = spark.createDataFrame([(i, s, "f1", "p1", "g1") for i, s in (("r1", "unverified"), ("r2", "verified"), ("r3", "unverified"))], "id string, verification_state string, filing_id string, politician_id string, regime_id string")
    rows = [
        ("a1", "t1", "open", "r1", "reject", None), ("a2", "t1", "open", "r1", "confirm", None), ("a3", "t2", "open", "r1", "confirm", None), ("a4", "t2", "open", "r1", "edit", "self"),
        ("a5", "t3", "open", "r2", "edit", "self"), ("a6", "t3", "open", "r2", "edit", "joint"), ("a7", "t4", "open", "r2", "edit", "self"), ("a8", "t5", "resolved", "r3", "confirm", None),
        ("a9", "t6", "open", "nobody", "edit", "self"), ("b1", "t7", "open", "r3", "edit", None), ("b2", "t7", "open", "r3", "confirm", None),
    ]
    attempts = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "attempt_id string, task_id string, task_status string, record_id string, verdict string, owner string, at int")
    attempts = attempts.withColumns({"regime_code": F.lit("us_senate"), "details": F.create_map(F.lit("counsel_name"), F.lit("x"))})
    none = spark.createDataFrame([], "fingerprint string")
    out = adjudicate.adjudicate(records, attempts, none, ["owner"], [(F.col("owner").isNotNull(), "no_owner")])
    assert {r.id: r.verification_state for r in out.states.collect()} == {"r1": "disputed", "r2": "verified", "r3": "verified"}
    assert {r.attempt_id: (r.outcome, r.reason) for r in out.audit.collect()} == {
        "a1": ("applied", None), "a2": ("conflict", "task_resolved"), "a3": ("failed", "not_unverified"), "a4": ("applied", None), "a5": ("applied", None), "a6": ("conflict", "task_resolved"),
        "a7": ("applied", None), "a8": ("conflict", "task_resolved"), "a9": ("failed", "missing_record"), "b1": ("failed", "no_owner"), "b2": ("applied", None),
    }
    added = out.corrections.collect()
    assert sorted((r.task_id, r.supersedes_record_id, r.owner, r.filing_id, r.verification_state, r.details) for r in added) == [("t2", "r1", "self", "f1", "corrected", {}), ("t3", "r2", "self", "f1", "corrected", {})]
    assert out.events.count() == 2 and out.resolved.count() == 5
    again = adjudicate.adjudicate(records, attempts, spark.createDataFrame([(r.fingerprint,) for r in added], "fingerprint string"), ["owner"], [(F.col("owner").isNotNull(), "no_owner")])
    assert again.corrections.count() == 0
