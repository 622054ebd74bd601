"""Operational roll-ups, ordered logic and the multi-step operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.details import CONTRACTS
from ..operators import aggregates as A
from ..operators import adjudicate, billing, consensus, contracts, drift, exports, idempotent, joins, publish, segments, selection, trust, windows
from ..operators.staging import stored
from ..streaming import queue
from .catalog import query

AS_OF = "2024-01-31"
#: groups of more rows than this are selected from by brackets here, so that these small tables show that path too
BRACKETED = 1000


@query("a1_summary", "SELECT count(*) AS n, min(event_date) AS first_date, max(event_date) AS last_date, CAST(sum(low_cents) AS BIGINT) AS cents FROM record WHERE politician_id = '00000077'")
def a1(d):
    return d.record.where("politician_id = '00000077'").agg(F.count("*").alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.sum("low_cents").alias("cents"))


@query(
    "a2_filtered_counts",
    """SELECT adapter, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running,
              count(*) FILTER (WHERE status = 'succeeded' AND seconds > 10) AS slow, sum(seconds > 100 AND status = 'failed')::BIGINT AS worst FROM pipeline_run GROUP BY adapter""",
)
def a2(d):
    s = F.col("status")
    counts = A.counted(failed=s == "failed", running=s == "running", slow=(s == "succeeded") & (F.col("seconds") > 10), worst=(s == "failed") & (F.col("seconds") > 100))
    return d.pipeline_run.groupBy("adapter").agg(*counts)


@query("a3_multi_distinct", "SELECT regime_id, count(*) AS n, count(DISTINCT politician_id) AS people, count(DISTINCT raw_document_id) AS documents FROM filing GROUP BY regime_id")
def a3(d):
    return d.filing.groupBy("regime_id").agg(F.count("*").alias("n"), F.count_distinct("politician_id").alias("people"), F.count_distinct("raw_document_id").alias("documents"))


@query("a4_pct", "SELECT record_type, count(low_cents) AS valued, count(*) AS n, 100.0::DOUBLE * count(low_cents) / nullif(count(*), 0) AS pct, 100.0::DOUBLE * count(side) / nullif(count(transaction_date), 0) AS side_pct FROM line GROUP BY record_type")
def a4(d):
    g = d.line.groupBy("record_type").agg(F.count("low_cents").alias("valued"), F.count("*").alias("n"), F.count("side").alias("_s"), F.count("transaction_date").alias("_t"))
    return g.select("record_type", "valued", "n", A.percent(F.col("valued"), "n").alias("pct"), A.percent(F.col("_s"), "_t").alias("side_pct"))


@query("a5_percentiles", "SELECT stage, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY seconds), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY seconds), 6) AS p95 FROM pipeline_run GROUP BY stage")
def a5(d):
    out = selection.percentiles(d.pipeline_run, ["stage"], "seconds", most=BRACKETED)
    return out.select("stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("a6_percentile_filter", "SELECT adapter, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY seconds) FILTER (WHERE status = 'succeeded'), 6) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY seconds) FILTER (WHERE status = 'succeeded'), 6) AS p90 FROM pipeline_run GROUP BY adapter")
def a6(d):
    out = selection.percentiles(d.pipeline_run, ["adapter"], "seconds", (0.5, 0.9), "status = 'succeeded'", most=BRACKETED)
    return out.select("adapter", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))  # the last bit of an interpolation is the engine's own


@query("a7_distinct_array", "SELECT stage, string_agg(DISTINCT adapter, ',' ORDER BY adapter) AS adapters FROM pipeline_run WHERE status = 'failed' GROUP BY stage")
def a7(d):
    return d.pipeline_run.where("status = 'failed'").groupBy("stage").agg(A.distinct_values("adapter").alias("adapters"))


@query("a8_having_distinct", "SELECT identifier, count(DISTINCT id) AS people FROM politician GROUP BY identifier HAVING count(DISTINCT id) > 3")
def a8(d):
    return d.politician.groupBy("identifier").agg(F.count_distinct("id").alias("people")).where("people > 3")


@query("a9_json_guard_sum", "SELECT stage, CAST(coalesce(sum(CASE WHEN regexp_matches(json_extract_string(stats, '$.k'), '^[0-9]+$') THEN CAST(json_extract_string(stats, '$.k') AS BIGINT) ELSE 0 END), 0) AS BIGINT) AS k FROM pipeline_run GROUP BY stage")
def a9(d):
    return d.pipeline_run.groupBy("stage").agg(A.guarded_sum(F.get_json_object("stats", "$.k")).alias("k"))


@query("a10_buckets", "SELECT date_trunc('hour', started_at) AS hour, CAST(started_at AS DATE) AS day, count(*) AS n FROM pipeline_run WHERE stage = 'fetch' GROUP BY 1, 2")
def a10(d):
    at = F.col("started_at").cast("timestamp")
    return d.pipeline_run.where("stage = 'fetch'").groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour"), F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


@query(
    "a11_month_spine",
    """SELECT CAST(m AS DATE) AS month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '1994-06-01', DATE '1999-03-01', INTERVAL 1 MONTH)) AS m)
       LEFT JOIN (SELECT date_trunc('month', filed_date) AS m2, count(*) AS n FROM filing WHERE priority = '2-HIGH' AND status = 'P' GROUP BY 1) ON m = m2""",
)
def a11(d):
    counts = d.filing.where("priority = '2-HIGH' AND status = 'P'").groupBy(F.trunc("filed_date", "month").alias("month")).agg(F.count("*").alias("n"))
    return A.month_spine(d.filing.sparkSession, "1994-06-01", "1999-03-01").join(counts, "month", "left").fillna(0, ["n"])


@query(
    "j4_month_left",
    """SELECT month, a.n AS parses, b.n AS fetches FROM (SELECT strftime(started_at, '%Y-%m-%d') AS month, count(*) AS n FROM pipeline_run WHERE stage = 'parse' GROUP BY 1) a
       LEFT JOIN (SELECT strftime(started_at, '%Y-%m-%d') AS month, count(*) AS n FROM pipeline_run WHERE stage = 'fetch' AND status = 'failed' GROUP BY 1) b USING (month)""",
)
def j4(d):
    by = lambda where, n: d.pipeline_run.where(where).groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("month")).agg(F.count("*").alias(n))
    return by("stage = 'parse'", "parses").join(by("stage = 'fetch' AND status = 'failed'", "fetches"), "month", "left")


@query(
    "j5_full_outer3",
    """SELECT coalesce(coalesce(a.k, b.k), c.k) AS k, a.n AS filings, b.n AS failed_runs, c.n AS drift_tasks
       FROM (SELECT regime_id AS k, count(*) AS n FROM filing GROUP BY 1) a
       FULL OUTER JOIN (SELECT regime_id AS k, count(*) AS n FROM pipeline_run WHERE status = 'failed' AND seconds > 60 GROUP BY 1) b ON a.k = b.k
       FULL OUTER JOIN (SELECT split_part(target_id, ':', 1) AS k, count(*) AS n FROM review_task WHERE target_kind = 'regime' AND priority = 3 AND status = 'open' GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""",
)
def j5(d):
    count = lambda df, key, n: df.groupBy(key.alias("k")).agg(F.count("*").alias(n))
    filings = count(d.filing, F.col("regime_id"), "filings")
    failed = count(d.pipeline_run.where("status = 'failed' AND seconds > 60"), F.col("regime_id"), "failed_runs")
    tasks = count(d.review_task.where("target_kind = 'regime' AND priority = 3 AND status = 'open'"), F.split_part("target_id", F.lit(":"), F.lit(1)), "drift_tasks")
    return joins.outer_chain("k", filings, failed, tasks)


@query(
    "a12_age_buckets",
    f"""SELECT count(*) FILTER (WHERE a < 1) AS under_1d, count(*) FILTER (WHERE a >= 1 AND a < 7) AS under_7d, count(*) FILTER (WHERE a >= 7 AND a < 30) AS under_30d, count(*) FILTER (WHERE a >= 30) AS older
        FROM (SELECT date_diff('day', CAST(created_at AS DATE), DATE '{AS_OF}') AS a FROM review_task WHERE status = 'open')""",
)
def a12(d):
    return A.age_buckets(d.review_task.where("status = 'open'"), "created_at", AS_OF)


@query("a13_two_level", "SELECT reason, count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY hours) AS median FROM (SELECT DISTINCT reason, target_id, hours FROM review_task WHERE status = 'resolved') GROUP BY reason")
def a13(d):
    rows = d.review_task.where("status = 'resolved'").select("reason", "target_id", "hours").distinct()
    rows = stored(rows, "resolved")
    medians = selection.percentiles(rows, ["reason"], "hours", (0.5,), most=BRACKETED).withColumnRenamed("p50", "median")
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(medians, "reason")


@query("a14_precision", "SELECT record_type, CASE WHEN count(*) FILTER (WHERE verification_state <> 'unverified') > 0 THEN (count(*) FILTER (WHERE verification_state = 'verified'))::DOUBLE / count(*) FILTER (WHERE verification_state <> 'unverified') END AS precision FROM line GROUP BY 1")
def a14(d):
    v = F.col("verification_state")
    g = d.line.groupBy("record_type").agg(*A.counted(audited=v != "unverified", right=v == "verified"))
    return g.select("record_type", F.try_divide(F.col("right").cast("double"), F.col("audited")).alias("precision"))


@query("a15_totals", "SELECT (SELECT count(*) FROM filing) AS filings, (SELECT count(*) FROM line) AS records, (SELECT count(*) FROM politician) AS people, (SELECT count(*) FROM raw_document) AS documents, (SELECT count(*) FROM review_task) AS tasks")
def a15(d):
    return A.totals(filings=d.filing, records=d.line, people=d.politician, documents=d.raw_document, tasks=d.review_task)


@query("a16_union_counts", "SELECT 'filing' AS relation, count(*) AS rows FROM filing UNION ALL SELECT 'line', count(*) FROM line UNION ALL SELECT 'regime', count(*) FROM regime UNION ALL SELECT 'run', count(*) FROM pipeline_run")
def a16(d):
    return A.union_counts(filing=d.filing, line=d.line, regime=d.regime, run=d.pipeline_run)


@query("a17_label_counts", "SELECT CASE WHEN target_kind = 'regime' THEN split_part(target_id, ':', 2) ELSE target_kind END AS label, status, count(*) AS n FROM review_task GROUP BY 1, 2")
def a17(d):
    label = F.when(F.col("target_kind") == "regime", F.split_part("target_id", F.lit(":"), F.lit(2))).otherwise(F.col("target_kind"))
    return d.review_task.groupBy(label.alias("label"), "status").agg(F.count("*").alias("n"))


@query("a18_heatmap", "SELECT f.regime_id, year(f.filed_date)::INTEGER AS year, l.record_type, count(*) AS n, count(*) FILTER (WHERE l.transaction_date IS NULL) AS undated FROM line l JOIN filing f ON l.filing_id = f.id GROUP BY 1, 2, 3")
def a18(d):
    f = d.filing.select(F.col("id").alias("filing_id"), "regime_id", F.year("filed_date").alias("year"))
    return d.line.join(f, "filing_id").groupBy("regime_id", "year", "record_type").agg(F.count("*").alias("n"), F.count_if(F.col("transaction_date").isNull()).alias("undated"))


@query("a20_half_even", "SELECT DISTINCT confidence_loss, CAST(round_even(CAST(confidence_loss AS DOUBLE) / 4.0, 1) AS DOUBLE) AS share FROM line")
def a20(d):
    return d.line.select("confidence_loss", A.half_even((F.col("confidence_loss") / F.lit(4)).cast("decimal(12,4)"), 1).cast("double").alias("share")).distinct()


@query("a22_owner_summary", "SELECT filing_id, count(*) FILTER (WHERE owner = 'self') AS own, count(*) FILTER (WHERE owner = 'spouse') AS spouse, count(*) FILTER (WHERE owner IS NULL) AS unstated, count(*) = max(ordinal) AS agrees FROM line GROUP BY filing_id")
def a22(d):
    o = F.col("owner")
    return d.line.groupBy("filing_id").agg(*A.counted(own=o == "self", spouse=o == "spouse", unstated=o.isNull()), (F.count("*") == F.max("ordinal")).alias("agrees"))


@query("a23_single_currency_sum", "SELECT filing_id, CASE WHEN count(DISTINCT currency) = 1 THEN CAST(sum(low_cents) AS BIGINT) END AS cents FROM line WHERE record_type = 'holding' GROUP BY 1")
def a23(d):
    one = F.min("currency") == F.max("currency")
    return d.line.where("record_type = 'holding'").groupBy("filing_id").agg(F.when(one, F.sum("low_cents")).alias("cents"))


@query("a24_latest_value", "SELECT f.politician_id, CASE WHEN max_by(l.low_cents, (f.filed_date, l.id)) > 1000000 THEN max_by(l.low_cents, (f.filed_date, l.id)) END AS cents FROM line l JOIN filing f ON l.filing_id = f.id WHERE l.low_cents IS NOT NULL GROUP BY 1")
def a24(d):
    f = d.filing.select(F.col("id").alias("filing_id"), "politician_id", "filed_date")
    latest = d.line.where("low_cents IS NOT NULL").join(f, "filing_id").groupBy("politician_id").agg(F.max_by("low_cents", F.struct("filed_date", "id")).alias("v"))
    return latest.select("politician_id", F.when(F.col("v") > 1_000_000, F.col("v")).alias("cents"))


@query("a25_group_counts", "SELECT reason, count(*) AS n, min(created_at) AS oldest, max(priority) AS top_priority FROM review_task WHERE status = 'open' GROUP BY reason ORDER BY n DESC, reason")
def a25(d):
    g = d.review_task.where("status = 'open'").groupBy("reason").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("priority").alias("top_priority"))
    return g.orderBy(F.desc("n"), F.asc("reason"))


@query("a26_retention", "SELECT count(*) AS documents, (SELECT count(DISTINCT raw_document_id) FROM filing) AS referenced FROM raw_document")
def a26(d):
    referenced = d.filing.select(F.col("raw_document_id").alias("id")).distinct()
    return A.totals(documents=d.raw_document, referenced=referenced)


@query("w1_occurrence", "SELECT id, row_number() OVER (PARTITION BY filing_id, record_type, owner ORDER BY ordinal) - 1 AS occurrence FROM line")
def w1(d):
    return windows.occurrence(d.line, "filing_id", ["record_type", "owner"], ["ordinal"]).select("id", F.col("occurrence").cast("long").alias("occurrence"))


@query("w2_row_numbers", "SELECT filing_id, bool_and(ordinal = n - rn + 1) AS numbered FROM (SELECT filing_id, ordinal, count(*) OVER (PARTITION BY filing_id) AS n, row_number() OVER (PARTITION BY filing_id ORDER BY ordinal DESC) AS rn FROM line) GROUP BY 1")
def w2(d):
    return windows.descending_numbers(d.line, "filing_id", "ordinal", [F.desc("ordinal")])


@query(
    "w3_sample",
    """SELECT regime_id, id FROM (SELECT regime_id, id, row_number() OVER (PARTITION BY regime_id ORDER BY sha256(unhex('000000000000002a') || encode(':' || id)), id) AS r FROM filing) WHERE r <= 20""",
)
def w3(d):
    return windows.seeded_sample(d.filing.select("regime_id", "id"), "regime_id", "id", 20, 42)


@query("w4_drift_rank", "SELECT id, priority, target_id FROM review_task WHERE target_kind = 'regime' AND status = 'open' ORDER BY priority DESC, target_id, id LIMIT 60")
def w4(d):
    rows = d.review_task.where("target_kind = 'regime' AND status = 'open'").select("id", "priority", "target_id")
    return rows.orderBy(F.desc("priority"), F.asc("target_id"), F.asc("id")).limit(60)


@query("w5_baseline", "SELECT id, last_value(CASE WHEN status = 'succeeded' THEN CAST(json_extract_string(stats, '$.k') AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY regime_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM pipeline_run")
def w5(d):
    runs = d.pipeline_run.select("id", F.col("regime_id").alias("source"), F.col("id").alias("pass"), (F.col("status") == "succeeded").alias("healthy"), F.get_json_object("stats", "$.k").cast("long").alias("count"))
    return trust.last_healthy(runs).select("id", "baseline")


@query("w6_carry_forward", "SELECT id, last_value(side IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY ordinal) AS side FROM line")
def w6(d):
    return d.line.select("id", windows.carried(F.col("side"), "filing_id", [F.col("ordinal")]).alias("side"))


@query(
    "k2_insert_absent",
    """SELECT document, id FROM (SELECT raw_document_id AS document, first(id ORDER BY id) AS id FROM filing WHERE status = 'P' GROUP BY 1)
       WHERE document NOT IN (SELECT raw_document_id FROM filing WHERE status = 'O' AND priority = '1-URGENT')""",
)
def k2(d):
    batch = d.filing.where("status = 'P'").select(F.col("raw_document_id").alias("document"), "id")
    target = d.filing.where("status = 'O' AND priority = '1-URGENT'").select(F.col("raw_document_id").alias("document"), "id")
    return idempotent.insert_if_absent(target, batch, ["document"], "id")


@query("k3_upsert", "SELECT politician_id, max_by(status, id) AS status, max(id) AS id FROM filing GROUP BY politician_id")
def k3(d):
    rows = d.filing.select("politician_id", "status", "id", F.col("id").alias("seq"))
    return idempotent.upsert(rows.where("status <> 'P'"), rows.where("status = 'P'"), ["politician_id"], "seq").select("politician_id", "status", "id")


@query(
    "k4_conditional_upsert",
    """SELECT coalesce(a.target_id, b.target_id) AS target_id, coalesce(a.detections, 0) + coalesce(b.found, 0) AS detections, a.detections IS NULL AS inserted
       FROM (SELECT target_id, count(*) AS detections FROM review_task WHERE status = 'open' AND priority = 3 GROUP BY 1) a
       FULL OUTER JOIN (SELECT target_id, count(*) AS found FROM review_task WHERE status = 'resolved' AND priority = 2 GROUP BY 1) b ON a.target_id = b.target_id""",
)
def k4(d):
    existing = d.review_task.where("status = 'open' AND priority = 3").groupBy("target_id").agg(F.count("*").alias("detections"), F.lit("open").alias("status"))
    return idempotent.upsert_open(existing, d.review_task.where("status = 'resolved' AND priority = 2"), "target_id")


@query("k1_blob_put", "SELECT DISTINCT sha256(body) AS sha256 FROM raw_document WHERE CAST(id AS INTEGER) % 3 = 0 AND sha256(body) NOT IN (SELECT sha FROM raw_document WHERE CAST(id AS INTEGER) % 6 = 0)")
def k1(d):
    number = F.col("id").cast("int")
    store = d.raw_document.where(number % 6 == 0).select(F.col("sha").alias("sha256"))
    return idempotent.put_blobs(store, d.raw_document.where(number % 3 == 0).select(F.col("body").cast("binary").alias("content"))).select("sha256")


@query(
    "r1_stage_claim",
    """SELECT w.id, CASE WHEN p.done THEN 'replay' WHEN p.done IS NOT NULL THEN 'retry' ELSE 'new' END AS claim FROM (SELECT id, concat(regime_id, ':', stage, ':', json_extract_string(stats, '$.k')) AS k FROM pipeline_run WHERE CAST(id AS BIGINT) >= 5000) w
       LEFT JOIN (SELECT concat(regime_id, ':', stage, ':', json_extract_string(stats, '$.k')) AS k, bool_or(status = 'succeeded') AS done FROM pipeline_run WHERE CAST(id AS BIGINT) < 5000 GROUP BY 1) p ON w.k = p.k""",
)
def r1(d):
    runs = d.pipeline_run.withColumn("idempotency_key", F.concat_ws(":", "regime_id", "stage", F.get_json_object("stats", "$.k")))
    number = F.col("id").cast("long")
    return trust.claim(runs.where(number >= 5000).select("id", "idempotency_key"), runs.where(number < 5000)).select("id", "claim")


@query(
    "r2_publish_verdicts",
    """SELECT record_type, CASE WHEN owner IS NULL THEN 'no_owner' WHEN record_type = 'transaction' AND side IS NULL THEN 'transaction_without_side'
              WHEN high_cents IS NOT NULL AND high_cents < low_cents THEN 'inverted_value' ELSE 'ok' END AS verdict, count(*) AS n FROM line GROUP BY 1, 2""",
)
def r2(d):
    checks = [(F.col("owner").isNotNull(), "no_owner"), *trust.row_checks()]
    return d.line.groupBy("record_type", trust.verdict(checks).alias("verdict")).agg(F.count("*").alias("n"))


PUBLISH_SQL = """c AS (
  SELECT l.filing_id, l.ordinal - 1 AS ordinal, l.asset_class, CASE CAST(f.regime_id AS INTEGER) % 5 WHEN 0 THEN 'fr_hatvp_dia' WHEN 1 THEN 'us_senate' WHEN 2 THEN 'br' WHEN 3 THEN 'ca' ELSE 'uk' END AS regime_code,
         l.ordinal % 4 = 0 AS dsp, CAST(l.filing_id AS BIGINT) % 3 = 0 AS known, l.asset_class = 'class8' AND l.ordinal = 2 AS bad, l.low_cents IS NULL AS no_value, l.owner IS NULL AS no_owner
  FROM line l JOIN filing f ON l.filing_id = f.id WHERE f.status = 'P'),
b AS (SELECT *, regime_code = 'fr_hatvp_dia' AND dsp AS held, bool_or(bad AND NOT (regime_code = 'fr_hatvp_dia' AND dsp)) OVER (PARTITION BY filing_id) AS rejected FROM c),
o AS (SELECT *, CASE WHEN regime_code = 'ca' THEN 'frozen' WHEN rejected THEN 'filing_rejected' WHEN held THEN 'suppressed' WHEN known THEN 'replay' ELSE 'inserted' END AS outcome FROM b)"""


def _published(d, keep=True):
    code = F.get(F.array(*map(F.lit, ("fr_hatvp_dia", "us_senate", "br", "ca", "uk"))), F.col("regime_id").cast("int") % 5)
    f = d.filing.where("status = 'P'").select(F.col("id").alias("filing_id"), code.alias("regime_code"), (F.col("priority") == "1-URGENT").alias("backfill"))
    declared = F.when(F.col("ordinal") % 4 == 0, "DSPM").otherwise("DIA")
    details = F.create_map(F.lit("type_declaration"), declared, F.lit("declarant_address"), F.lit("x"), F.lit("counsel_name"), F.lit("y"), F.lit("last_updated_time_raw"), F.col("id"))
    columns = ["record_type", "asset_class", "asset_description_raw", "low_cents", "high_cents", "owner", "side"]
    # what is published and what was published before both come from these lines
    c = stored(d.line_by_filing(f).join(f, "filing_id").select("filing_id", "ordinal", "regime_code", "backfill", "id", *columns), "candidates")
    c = c.select("filing_id", (F.col("ordinal") - 1).alias("ordinal"), "regime_code", "backfill", details.alias("details"), *columns)
    checks = [(~((F.col("asset_class") == "class8") & (F.col("ordinal") == 1)), "not_of_this_class")]
    reviews = [(F.col("low_cents").isNull(), "value_missing"), (F.col("owner").isNull(), "owner_missing")]
    frozen = c.where("regime_code = 'ca'").select("regime_code").distinct()
    earlier = c.where("CAST(filing_id AS BIGINT) % 3 = 0").withColumn("details", publish.public_details())
    known = earlier.select(S.fingerprint(F.col("filing_id"), F.col("ordinal"), publish.content(columns)).alias("fingerprint"))
    return publish.publish(c, columns, frozen, known, checks, reviews, keep)


@query(
    "r2_publish",
    f"""WITH {PUBLISH_SQL} SELECT filing_id, count(*) AS candidates, count(*) FILTER (WHERE outcome = 'inserted') AS gold_inserted, count(*) FILTER (WHERE outcome = 'inserted') AS outbox_written,
        CAST(sum(CASE outcome WHEN 'inserted' THEN no_value::INTEGER + no_owner::INTEGER WHEN 'suppressed' THEN 1 ELSE 0 END) AS BIGINT) AS review_tasks,
        count(*) FILTER (WHERE outcome = 'suppressed') AS suppressed, count(*) FILTER (WHERE outcome = 'replay') AS replayed FROM o GROUP BY filing_id""",
)
def r2_publish(d):
    return _published(d).counters


@query(
    "r2_reviews",
    f"""WITH {PUBLISH_SQL} SELECT target_kind, reason, count(*) AS n FROM (
          SELECT 'disclosure_record' AS target_kind, 'value_missing' AS reason FROM o WHERE outcome = 'inserted' AND no_value
          UNION ALL SELECT 'disclosure_record', 'owner_missing' FROM o WHERE outcome = 'inserted' AND no_owner
          UNION ALL SELECT 'filing', 'redaction_fr_patrimony_unrepublishable' FROM o WHERE outcome = 'suppressed'
          UNION ALL SELECT DISTINCT 'regime', 'publish_blocked_frozen' FROM o WHERE outcome = 'frozen') GROUP BY 1, 2""",
)
def r2_reviews(d):
    return _published(d).reviews.groupBy("target_kind", "reason").agg(F.count("*").alias("n"))


@query("t7_backfill_events", f"WITH {PUBLISH_SQL} SELECT f.priority = '1-URGENT' AS suppressed, count(*) AS n FROM o JOIN filing f ON f.id = o.filing_id WHERE outcome = 'inserted' GROUP BY 1")
def t7(d):
    """Events of backfilled filings are written as sent already, so no alert follows."""
    return _published(d, keep=False).events.groupBy("suppressed").agg(F.count("*").alias("n"))


@query(
    "f3_fingerprint_content",
    "SELECT id, sha256(encode(filing_id) || unhex('00') || unhex(lpad(hex(ordinal), 8, '0')) || unhex('00') || encode('{\"asset_class\":\"' || asset_class || '\",\"details\":{' || CASE WHEN ordinal % 2 = 0 THEN '' ELSE '\"last_updated_time_raw\":\"' || id || '\",' END || '\"z\":\"1\"}}')) AS fingerprint FROM line",
)
def f3(d):
    details = F.create_map(F.lit("z"), F.lit("1"), F.lit("last_updated_time_raw"), F.col("id"))
    rows = d.line.select("id", "filing_id", "ordinal", "asset_class", details.alias("details"), F.when(F.col("ordinal") % 2 == 0, "br").otherwise("uk").alias("regime_code"))
    return rows.select("id", S.fingerprint(F.col("filing_id"), F.col("ordinal"), publish.content(["asset_class"])).alias("fingerprint"))


@query("r3_redaction", "SELECT id, CAST(NULL AS VARCHAR) AS owner, record_type FROM line WHERE NOT starts_with(lower(asset_description_raw), 'asset 1')")
def r3(d):
    return trust.redact(d.line, "asset_description_raw", "ASSET 1", ["owner"]).select("id", "owner", "record_type")


@query(
    "r5_resolve",
    """SELECT m.mention_id, CASE WHEN count(DISTINCT e.entity_id) = 1 THEN min(e.entity_id) END AS entity_id, count(DISTINCT e.entity_id) AS candidates
       FROM (SELECT id AS mention_id, body, substr(canonical_name, 1, 17) AS name, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN identifier END AS identifier, CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN birth_year + 30 END AS year FROM politician) m
       LEFT JOIN (SELECT id AS entity_id, body, substr(canonical_name, 1, 17) AS name, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN identifier END AS identifier, birth_year + 27 AS first_year FROM politician) e
         ON m.body = e.body AND m.name = e.name AND (CASE WHEN m.identifier IS NOT NULL AND e.identifier IS NOT NULL THEN m.identifier = e.identifier ELSE m.year IS NULL OR abs(m.year - e.first_year) <= 3 END) GROUP BY 1""",
)
def r5(d):
    """Mentions by body and name, which few people share, then by identifier or years in office."""
    number, name = F.col("id").cast("long"), F.left("canonical_name", F.lit(17)).alias("name")
    mentions = d.politician.select(F.col("id").alias("mention_id"), "body", name, F.when(number % 3 == 0, F.col("identifier")).alias("identifier"), F.when(number % 7 != 0, F.col("birth_year") + 30).alias("year"))
    entities = d.politician.select(F.col("id").alias("entity_id"), "body", name, F.when(number % 2 == 0, F.col("identifier")).alias("identifier"), (F.col("birth_year") + 27).alias("first_year"))
    return trust.resolve(mentions, entities, ["body", "name"], 3)


@query("r6_refuse_collisions", "SELECT id FROM politician WHERE (body, regime_id, birth_year) IN (SELECT (body, regime_id, birth_year) FROM politician GROUP BY body, regime_id, birth_year HAVING count(*) = 1)")
def r6(d):
    return trust.refuse_collisions(d.politician, ["body", "regime_id", "birth_year"]).select("id")


# Attempts one after the other, as a reviewer would meet them: the state of the record and the tasks closed so far.
_STEPS = """
  numbered AS (SELECT a.*, row_number() OVER (PARTITION BY a.record_id ORDER BY a.at, a.attempt_id) AS k,
      CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'redaction_fr_patrimony_unrepublishable' WHEN n % 11 = 0 THEN 'no_owner' END AS bad FROM attempt a),
  steps AS (
    SELECT DISTINCT r.record_id, 0::BIGINT AS k, l.verification_state AS state, []::VARCHAR[] AS closed, NULL::VARCHAR AS attempt_id, NULL::VARCHAR AS verdict, NULL::VARCHAR AS task_id, NULL::BIGINT AS n, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason
    FROM (SELECT DISTINCT record_id FROM attempt) r LEFT JOIN line l ON l.id = r.record_id
    UNION ALL
    SELECT record_id, k, CASE WHEN outcome = 'applied' AND verdict = 'confirm' THEN 'verified' WHEN outcome = 'applied' AND verdict = 'reject' THEN 'disputed' ELSE state END,
           CASE WHEN outcome = 'applied' THEN list_append(closed, task_id) ELSE closed END, attempt_id, verdict, task_id, n, outcome,
           CASE outcome WHEN 'conflict' THEN 'task_resolved' WHEN 'failed' THEN CASE WHEN state IS NULL THEN 'missing_record' WHEN verdict = 'edit' THEN bad ELSE 'not_unverified' END END
    FROM (SELECT s.record_id, a.k, s.state, s.closed, a.attempt_id, a.verdict, a.task_id, a.n, a.bad,
                 CASE WHEN a.task_status <> 'open' OR list_contains(s.closed, a.task_id) THEN 'conflict' WHEN s.state IS NULL THEN 'failed'
                      WHEN a.verdict = 'edit' THEN CASE WHEN a.bad IS NULL THEN 'applied' ELSE 'failed' END WHEN s.state = 'unverified' THEN 'applied' ELSE 'failed' END AS outcome
          FROM steps s JOIN numbered a ON a.record_id = s.record_id AND a.k = s.k + 1) q)"""


def _adjudicated(d):
    n = F.col("n")
    attempts = d.attempt.select(
        "attempt_id", "task_id", "task_status", "record_id", "at", "verdict", F.when(n % 5 == 0, "fr_hatvp_dia").otherwise("us_senate").alias("regime_code"),
        F.when(n % 11 != 0, F.when(n % 2 == 0, "spouse").otherwise("self")).alias("owner"),
        F.create_map(F.lit("type_declaration"), F.when(n % 2 == 0, "DSPfm").otherwise("dia"), F.lit("counsel_name"), F.lit("x")).alias("details"),
    )
    records = d.line.join(d.filing.select(F.col("id").alias("filing_id"), "politician_id", "regime_id"), "filing_id")
    none = d.line.sparkSession.createDataFrame([], "fingerprint string")
    return adjudicate.adjudicate(records, attempts, none, ["owner"], [(F.col("owner").isNotNull(), "no_owner")])


@query("r7_verdict_fold", f"WITH {_STEPS}, final AS (SELECT record_id, arg_max(state, k) AS state FROM steps GROUP BY 1) SELECT l.id, coalesce(f.state, l.verification_state) AS state FROM line l LEFT JOIN final f ON f.record_id = l.id")
def r7(d):
    """States of all records after all verdicts; an edit leaves its record as it is."""
    return _adjudicated(d).states.withColumnRenamed("verification_state", "state")


@query("r7_audit", f"WITH {_STEPS} SELECT attempt_id, record_id, verdict, outcome, reason FROM steps WHERE k > 0")
def r7_audit(d):
    return _adjudicated(d).audit.drop("task_id")


@query(
    "r7_corrections",
    f"""WITH {_STEPS}, rows AS (SELECT s.record_id, s.task_id, s.attempt_id, s.k, f.id AS filing_id, f.politician_id, f.regime_id, CASE WHEN s.n % 2 = 0 THEN 'spouse' ELSE 'self' END AS owner,
               '{{' || CASE WHEN s.n % 5 = 0 THEN '"counsel_name":"x",' ELSE '' END || '"type_declaration":"' || CASE WHEN s.n % 2 = 0 THEN 'DSPfm' ELSE 'dia' END || '"}}' AS details
               FROM steps s JOIN line l ON l.id = s.record_id JOIN filing f ON f.id = l.filing_id WHERE s.k > 0 AND s.outcome = 'applied' AND s.verdict = 'edit'),
        printed AS (SELECT *, sha256(encode('correction:' || record_id) || unhex('00') || unhex('00000000') || unhex('00')
               || encode('{{"details":' || details || ',"filing_id":"' || filing_id || '","owner":"' || owner || '","politician_id":"' || politician_id || '","regime_id":"' || regime_id || '"}}')) AS fingerprint FROM rows)
        SELECT arg_min(task_id, k) AS task_id, record_id AS supersedes_record_id, any_value(filing_id) AS filing_id, any_value(owner) AS owner, any_value(details) AS details, fingerprint, 'corrected' AS verification_state FROM printed GROUP BY record_id, fingerprint""",
)
def r7_corrections(d):
    """Rows that applied edits append: identity from the record they supersede, details redacted, fingerprints of their own scope."""
    out = _adjudicated(d).corrections
    return out.select("task_id", "supersedes_record_id", "filing_id", "owner", S.canonical_json(F.to_json("details")).alias("details"), "fingerprint", "verification_state")


@query(
    "j12_identity_sweep",
    """SELECT p.id, p.canonical_name, count(DISTINCT s.identifier) AS n, array_to_string(list_sort(list(DISTINCT s.identifier)), ',') AS identifiers FROM politician p JOIN filing f ON f.politician_id = p.id JOIN raw_document r ON r.id = f.raw_document_id
       JOIN (SELECT raw_document_id, CASE WHEN status = 'P' THEN substr(priority, 1, 1) END AS identifier FROM filing) s ON s.raw_document_id = r.id WHERE s.identifier IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT s.identifier) > 1""",
)
def j12(d):
    staged = d.filing.select("raw_document_id", F.when(F.col("status") == "P", F.left("priority", F.lit(1))).alias("identifier"))
    out = trust.shared_identifiers(d.politician, d.filing, d.raw_document, staged)
    return out.select("id", "canonical_name", "n", F.array_join("identifiers", ",").alias("identifiers"))


@query(
    "r23_row_keys",
    """SELECT id, coalesce('"' || asset_class || '"', 'null') || chr(31) || coalesce('"' || owner || '"', 'null') || chr(31) || 'null' AS row_key,
              row_number() OVER (PARTITION BY filing_id, asset_class, owner ORDER BY ordinal) - 1 AS occurrence FROM line""",
)
def r23(d):
    payload = F.to_json(F.struct("asset_class", "owner", "ordinal"))
    rows = consensus.row_keys(d.line.select("id", "filing_id", "ordinal", payload.alias("payload")), "filing_id", "payload", ["asset_class", "owner", "absent"], ["ordinal"])
    return rows.select("id", "row_key", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    "r23_confidence",
    "SELECT id, CASE WHEN owner IS NOT NULL AND low_cents IS NOT NULL THEN 0.9 WHEN owner IS NOT NULL THEN 0.79 WHEN ordinal = 1 THEN 0.75 END::DOUBLE AS confidence FROM line",
)
def r23_confidence(d):
    return d.line.select("id", consensus.confidence(F.col("owner").isNotNull(), F.col("low_cents").isNotNull(), F.col("ordinal") == 1).alias("confidence"))


@query(
    "r24_differing_paths",
    """SELECT id, CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN '' WHEN 1 THEN '$.k' WHEN 2 THEN '$.a.length,$.m' WHEN 3 THEN '$.a[1].x' WHEN 4 THEN '$.a[0],$.a[1].x' WHEN 5 THEN '$.k' WHEN 6 THEN '$.a' ELSE '$' END AS paths FROM pipeline_run""",
)
def r24(d):
    """Where two documents differ; values of other types are other values, however alike."""
    k, n = F.get_json_object("stats", "$.k"), F.col("id").cast("long") % 8
    texts = ['{"k":%, "a":[1,{"x":2}]}', '{"a":[1,{"x":2}],"k":"%"}', '{"a":[1],"m":0,"k":%}', '{"a":[1,{"x":3}],"k":%}', '{"a":[true,{"x":2.0}],"k":%}', '{"a":[1,{"x":2}],"k":%.0}', '{"a":{"0":1},"k":%}', "[%]"]
    left = F.concat(F.lit('{"a":[1,{"x":2}],"k":'), k, F.lit("}"))
    right = F.replace(F.get(F.array(*map(F.lit, texts)), n.cast("int")), F.lit("%"), k)
    return d.pipeline_run.select("id", F.array_join(consensus.differing_paths(left, right), ",").alias("paths"))


@query("r8_open_once", "SELECT DISTINCT target_kind, target_id, reason FROM review_task WHERE priority = 1 AND (target_id || reason) NOT IN (SELECT target_id || reason FROM review_task WHERE status = 'open' AND priority = 2)")
def r8(d):
    proposed = d.review_task.where("priority = 1").select("target_kind", "target_id", "reason")
    return trust.open_once(d.review_task.where("priority = 2"), proposed, ["target_kind", "target_id", "reason"])


@query("r9_identity_agreement", "SELECT filing_id, CASE WHEN count(DISTINCT owner) = 1 AND count(owner) = count(*) THEN min(owner) END AS identity FROM line GROUP BY 1")
def r9(d):
    return trust.agreed(d.line, "filing_id", "owner")


DIFF_SQL = """cand AS (
  SELECT l.filing_id, year(f.filed_date)::INTEGER AS year, l.id AS fingerprint, CASE WHEN CAST(f.id AS BIGINT) % 10 = 3 THEN f.id END AS supersedes,
         CAST(l.filing_id AS BIGINT) % 3 <> 0 AND (CAST(l.filing_id AS BIGINT) % 5 <> 1 OR l.id NOT LIKE '%002') AS published
  FROM line l JOIN filing f ON l.filing_id = f.id WHERE f.status = 'P'),
diff AS (
  SELECT filing_id, min(year) AS year, count(*) AS records, count(*) FILTER (WHERE NOT published) AS new_records,
         CASE WHEN NOT bool_or(published) AND max(supersedes) IS NOT NULL THEN 'supersession' WHEN NOT bool_or(published) THEN 'add'
              WHEN count(*) FILTER (WHERE NOT published) > 0 THEN 'change' ELSE 'unchanged' END AS kind
  FROM cand GROUP BY filing_id)"""


def _diff(d):
    f = d.filing.where("status = 'P'").select(F.col("id").alias("filing_id"), F.year("filed_date").alias("year"), F.when(F.col("id").cast("long") % 10 == 3, F.col("id")).alias("supersedes"))
    candidates = d.line.join(f, "filing_id").select("filing_id", "year", F.col("id").alias("fingerprint"), "supersedes")
    number = F.col("filing_id").cast("long")
    return trust.diff_filings(candidates, candidates.where((number % 3 != 0) & ((number % 5 != 1) | ~F.col("fingerprint").like("%002"))))


@query("r10_diff", f"WITH {DIFF_SQL} SELECT filing_id, year, records, new_records, kind FROM diff")
def r10(d):
    return _diff(d)


@query(
    "r11_budget_gate",
    f"""WITH {DIFF_SQL} SELECT year, count(*) FILTER (WHERE kind = 'add') AS "add", count(*) FILTER (WHERE kind = 'supersession') AS supersession, count(*) FILTER (WHERE kind = 'change') AS change,
        count(*) FILTER (WHERE kind = 'unchanged') AS unchanged, CAST(sum(new_records) AS BIGINT) AS record_delta, sum(new_records) <= 500 AS proceed FROM diff GROUP BY year""",
)
def r11(d):
    return trust.budget_gate(_diff(d))


DRIFT_SQL = """d AS (
  SELECT id, regime_id, http, n % 29 AS layout, CASE WHEN http IS NULL THEN 'probe_error' WHEN http = 304 THEN 'none' WHEN http < 200 OR http > 299 THEN 'status_error' WHEN n % 17 = 0 THEN 'regime_change'
         WHEN base IS NOT NULL AND k = 0 AND base > 0 THEN 'count_zero' WHEN base_layout IS NOT NULL AND n % 29 <> base_layout THEN 'layout_shift' WHEN base IS NOT NULL AND k >= 0 AND k < base THEN 'count_delta' ELSE 'none' END AS kind
  FROM (SELECT id, regime_id, n, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 7 = 0 THEN 304 WHEN n % 11 = 0 THEN 500 ELSE 200 END AS http, k - 1 AS k,
               CASE WHEN n % 5 <> 0 THEN lag(k) OVER w END AS base, CASE WHEN n % 3 = 0 THEN lag(n % 29) OVER w END AS base_layout
        FROM (SELECT id, regime_id, CAST(id AS BIGINT) // 5 AS n, CAST(json_extract_string(stats, '$.k') AS BIGINT) AS k FROM pipeline_run) WINDOW w AS (PARTITION BY regime_id ORDER BY id)))"""


@query(
    "r12_drift",
    f"""WITH {DRIFT_SQL} SELECT id, kind, CASE kind WHEN 'layout_shift' THEN 100 WHEN 'count_zero' THEN 90 WHEN 'regime_change' THEN 80 WHEN 'status_error' THEN 70 WHEN 'probe_error' THEN 60 WHEN 'count_delta' THEN 30 END AS score,
        CASE WHEN kind <> 'none' THEN kind IN ('layout_shift', 'count_zero', 'regime_change') END AS freeze,
        CASE WHEN kind <> 'none' THEN regime_id || ':' || kind || ':' || CASE kind WHEN 'probe_error' THEN 'transport' WHEN 'status_error' THEN CAST(http AS VARCHAR) WHEN 'regime_change' THEN 'markers' WHEN 'count_zero' THEN 'zero' WHEN 'layout_shift' THEN CAST(layout AS VARCHAR) ELSE 'shrink' END END AS dedup_key FROM d""",
)
def r12(d):
    """Probes with partly missing baselines."""
    n = F.col("n")
    runs = d.pipeline_run.select("id", "regime_id", F.expr("CAST(id AS BIGINT) DIV 5").alias("n"), F.get_json_object("stats", "$.k").cast("long").alias("k"))
    runs = segments.carried(runs, "regime_id", ["id"], {"before": (F.col("k"), F.lit(True)), "layout": (n % 29, F.lit(True))})
    runs = runs.select("*", F.when(n % 5 != 0, F.col("before")).alias("base"), F.when(n % 3 == 0, F.col("layout")).alias("base_layout"))
    http = F.when(n % 13 == 0, None).when(n % 7 == 0, 304).when(n % 11 == 0, 500).otherwise(200)
    runs = runs.withColumn("kind", trust.drift(http, n % 17 != 0, F.col("k") - 1, n % 29, F.col("base"), F.col("base_layout")))
    return runs.select("id", "kind", *trust.drift_report(F.col("kind"), F.col("regime_id"), http, n % 29))


SETTLE = "SELECT id, CAST(CAST(json_extract_string(stats, '$.k') AS BIGINT) % 6 AS INTEGER) AS attempts, CASE status WHEN 'succeeded' THEN CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'sent' ELSE 'retryable' END WHEN 'failed' THEN 'terminal' ELSE 'retryable' END AS outcome FROM pipeline_run"


@query(
    "r15_settle",
    f"""SELECT id, attempts + 1 AS attempts, s AS status, CASE WHEN s = 'pending' THEN CAST(500 * pow(2, attempts) AS BIGINT) END AS wait_ms
        FROM (SELECT *, CASE WHEN outcome = 'sent' THEN 'sent' WHEN outcome = 'terminal' OR attempts + 1 >= 5 THEN 'dead' ELSE 'pending' END AS s FROM ({SETTLE}) q)""",
)
def r15(d):
    outcome = F.when(F.col("status") == "failed", "terminal").when((F.col("status") == "succeeded") & (F.col("id").cast("long") % 4 == 0), "sent").otherwise("retryable")
    rows = d.pipeline_run.select("id", (F.get_json_object("stats", "$.k").cast("long") % 6).cast("int").alias("attempts"), outcome.alias("outcome"))
    return trust.settle(rows).select("id", "attempts", "status", "wait_ms")


@query("r16_digest", "SELECT CAST(CAST(regime_id AS INTEGER) % 9 AS INTEGER) AS rule_id, 'digest' AS channel, count(*) AS deliveries, min(id) AS first_record, max(id) AS last_record, max(CAST(json_extract_string(stats, '$.k') AS BIGINT)) AS attempts FROM pipeline_run WHERE stage = 'publish' GROUP BY 1")
def r16(d):
    pending = d.pipeline_run.select((F.col("regime_id").cast("int") % 9).alias("rule_id"), F.when(F.col("stage") == "publish", "digest").otherwise("email").alias("channel"), F.col("id").alias("record_id"), F.get_json_object("stats", "$.k").cast("long").alias("attempts"))
    return trust.digests(pending)


@query("r17_usage", "SELECT user_id, min(id) AS first_event, max(id) AS last_event, count(*) AS n_events, sha256(concat_ws(':', CAST(user_id AS VARCHAR), CAST(min(id) AS VARCHAR), CAST(max(id) AS VARCHAR))) AS report_id FROM usage_event WHERE NOT billed GROUP BY user_id")
def r17(d):
    return trust.usage_report(d.usage_event)


# Billing at a cutoff: every third user has no customer id, every fourth no open subscription; a fifth of all events has a report.
CUTOFF = "2024-01-20 12:00:00"
_EVENTS_SQL = "SELECT id, user_id, \"at\", CASE WHEN billed THEN 'earlier' END AS report_id FROM usage_event"
_REPORTS_SQL = f"""SELECT sha256(concat_ws(':', CAST(user_id AS VARCHAR), CAST(min(id) AS VARCHAR), CAST(max(id) AS VARCHAR))) AS report_id, user_id, min("at") AS period_start, max("at") AS period_end, count(*) AS quantity
       FROM ({_EVENTS_SQL}) e WHERE report_id IS NULL AND "at" <= TIMESTAMP '{CUTOFF}' AND user_id % 3 <> 0 AND user_id % 4 <> 0 GROUP BY user_id"""


def _billing(d):
    events = d.usage_event.select("id", "user_id", "at", F.when(F.col("billed"), "earlier").alias("report_id"))
    users = d.usage_event.select("user_id").distinct()
    known = users.select("user_id", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("cus_"), F.col("user_id").cast("string"))).alias("customer_id"))
    subscriptions = users.select("user_id", F.element_at(F.array(*map(F.lit, ("ended", "active", "trialing", "active"))), (F.col("user_id") % 4 + 1).cast("int")).alias("status"))
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    return events, billing.reports(events, billing.billable_users(known, subscriptions), cutoff), cutoff


@query("r17_reports", _REPORTS_SQL)
def r17_reports(d):
    """Reports of what billable users have not been billed for up to a cutoff."""
    return _billing(d)[1]


@query("r17_stamped", f"SELECT e.id, coalesce(e.report_id, r.report_id) AS report_id FROM ({_EVENTS_SQL}) e LEFT JOIN ({_REPORTS_SQL}) r ON e.user_id = r.user_id AND e.\"at\" <= TIMESTAMP '{CUTOFF}'")
def r17_stamped(d):
    """Every event with the report that counts it, if one does."""
    events, made, cutoff = _billing(d)
    return billing.stamped(events, made, cutoff).select("id", "report_id")


@query("r17_pending", f"SELECT report_id, 'cus_' || user_id AS customer_id, quantity FROM ({_REPORTS_SQL}) r WHERE user_id % 5 <> 0 OR user_id % 10 = 0")
def r17_pending(d):
    """Reports to send again: every fifth user's was accepted, but for those whose acceptance has no time."""
    made = _billing(d)[1].withColumn("reported_at", F.lit(None).cast("timestamp_ntz"))
    accepted = made.where("user_id % 5 = 0").select("report_id", F.when(F.col("user_id") % 10 != 0, F.col("period_end")).alias("at"))
    users = d.usage_event.select("user_id").distinct().withColumn("customer_id", F.concat(F.lit("cus_"), F.col("user_id").cast("string")))
    return billing.pending(billing.settled(made, accepted), users)


@query("r18_quota", 'SELECT user_id, CAST("at" AS DATE) AS day, count(*) AS calls, count(*) > 5 AS "over" FROM usage_event GROUP BY 1, 2')
def r18(d):
    return trust.over_quota(d.usage_event, 5)


@query(
    "r20_split",
    """SELECT entity_id, last(identifier ORDER BY records DESC, filings DESC, identifier DESC) AS moves, last(records ORDER BY records DESC, filings DESC, identifier DESC) AS records, last(filings ORDER BY records DESC, filings DESC, identifier DESC) AS filings
       FROM (SELECT politician_id AS entity_id, 'A' || CAST(CAST(raw_document_id AS INTEGER) % 3 AS VARCHAR) AS identifier, count(*) AS records, count(DISTINCT id) AS filings FROM filing WHERE status = 'P' AND priority <> '5-LOW' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2""",
)
def r20(d):
    rows = d.filing.where("status = 'P' AND priority <> '5-LOW'").select(F.col("politician_id").alias("entity_id"), F.concat(F.lit("A"), (F.col("raw_document_id").cast("int") % 3).cast("string")).alias("identifier"), F.col("id").alias("filing_id"))
    return trust.split_identity(rows)


@query("r21_single_identifier", "SELECT politician_id AS entity_id, CASE WHEN count(DISTINCT priority) = 1 THEN min(priority) END AS identifier, count(DISTINCT priority) > 1 AS ambiguous FROM filing WHERE status = 'P' GROUP BY 1")
def r21(d):
    return trust.single_identifier(d.filing.where("status = 'P'").select(F.col("politician_id").alias("entity_id"), F.col("priority").alias("identifier")))


@query("r29_review_reasons", "SELECT id, unnest(list_filter([CASE WHEN owner IS NULL THEN 'owner_missing' END, CASE WHEN low_cents IS NULL THEN 'value_missing' END, CASE WHEN high_cents IS NULL AND low_cents IS NOT NULL THEN 'value_open' END], lambda x: x IS NOT NULL)) AS reason FROM line")
def r29(d):
    rules = [(F.col("owner").isNull(), "owner_missing"), (F.col("low_cents").isNull(), "value_missing"), (F.col("high_cents").isNull() & F.col("low_cents").isNotNull(), "value_open")]
    return d.line.select("id", F.explode(trust.review_reasons(rules)).alias("reason"))


@query("t6_tumbling", "SELECT user_id, time_bucket(INTERVAL '1 hour', \"at\") AS start, count(*) AS calls FROM usage_event GROUP BY 1, 2")
def t6(d):
    events = d.usage_event.withColumn("at", F.col("at").cast("timestamp"))
    return trust.usage_windows(events, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


_ATTEMPTS = """SELECT concat('d', CAST(id AS BIGINT) // 6) AS dedup_key, CAST(id AS BIGINT) % 6 + 1 AS attempt, started_at AS at, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'sent' WHEN CAST(id AS BIGINT) % 17 = 0 THEN 'terminal' ELSE 'retryable' END AS outcome
      FROM pipeline_run WHERE CAST(id AS BIGINT) % 11 <> 3"""


@query(
    "t3_queue",
    f"""WITH tries AS ({_ATTEMPTS}), walk AS (SELECT DISTINCT dedup_key, 0::BIGINT AS n, NULL::VARCHAR AS outcome, NULL::TIMESTAMP AS tried FROM tries
          UNION ALL SELECT w.dedup_key, w.n + 1, e.outcome, e.at FROM walk w JOIN tries e ON e.dedup_key = w.dedup_key AND e.attempt = w.n + 1 WHERE coalesce(w.outcome, 'retryable') = 'retryable' AND w.n < 5),
        ends AS (SELECT dedup_key, max(n) AS n, arg_max(outcome, n) AS outcome, arg_max(tried, n) AS tried FROM walk GROUP BY dedup_key),
        told AS (SELECT *, CASE WHEN outcome = 'sent' THEN 'sent' WHEN outcome = 'terminal' OR n >= 5 THEN 'dead' ELSE 'pending' END AS status FROM ends)
        SELECT dedup_key, status, n::INTEGER AS attempts, CASE WHEN status = 'pending' THEN CASE n WHEN 0 THEN 0 ELSE 500 * 2 ** (n - 1) END END::BIGINT AS wait_ms, CASE WHEN status = 'pending' AND n > 0 THEN epoch_us(tried) + (500000 * 2 ** (n - 1))::BIGINT END AS due_us FROM told""",
)
def t3(d):
    """States of deliveries after all their attempts, some of which are told twice and some not at all."""
    n = F.col("id").cast("long")
    outcome = F.when(n % 5 == 0, "sent").when(n % 17 == 0, "terminal").otherwise("retryable")
    tries = d.pipeline_run.where(n % 11 != 3).select(F.concat(F.lit("d"), F.expr("CAST(id AS BIGINT) DIV 6").cast("string")).alias("dedup_key"), (n % 6 + 1).alias("attempt"), F.col("started_at").alias("at"), outcome.alias("outcome"), n.alias("n"))
    told = tries.union(tries.where("n % 7 = 0")).drop("n")
    return queue.states(told).select("dedup_key", "status", "attempts", "wait_ms", F.unix_micros("due").alias("due_us"))


@query("t5_minute_counters", "SELECT user_id, time_bucket(INTERVAL '1 minute', \"at\") AS start, count(*) AS calls FROM usage_event WHERE \"at\" >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2")
def t5(d):
    events = d.usage_event.where("at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("at", F.col("at").cast("timestamp"))
    return trust.usage_windows(events, "1 minute").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "r4_details_contract",
    """SELECT id, CASE WHEN stage = 'discover' THEN 'unregistered' ELSE CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN 'missing:stage' WHEN 1 THEN 'unknown:extra' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'type:k' WHEN 4 THEN 'enum:stage'
              WHEN 5 THEN 'range:k' WHEN 6 THEN 'type:note' ELSE 'ok' END END AS breach FROM pipeline_run""",
)
def r4(d):
    k, n = F.get_json_object("stats", "$.k"), F.col("id").cast("long") % 8
    text = lambda form: F.format_string(form, k)
    shapes = ('{"k":%s}', '{"k":%s,"stage":"a","extra":2}', "[%s]", '{"k":"%s","stage":"a"}', '{"k":%s,"stage":"c"}', '{"k":1%s000,"stage":"b"}', '{"k":%s,"stage":"b","note":7}', '{"k":%s,"stage":"a","note":"n"}')
    details = text(shapes[-1])
    for at, shape in enumerate(shapes[:-1]):
        details = F.when(n == at, text(shape)).otherwise(details)
    rule = trust.Contract(required=("k", "stage"), allowed=("k", "stage", "note"), types={"k": "number", "note": "string"}, enums={"stage": ("a", "b")}, ranges={"k": (0, 999)})
    registry = {("run", stage): rule for stage in ("fetch", "parse", "normalize", "publish")}
    return d.pipeline_run.select("id", trust.registered_contract(registry, F.lit("run"), F.col("stage"), details).alias("breach"))


def _example(schema: dict) -> str:
    """JSON that keeps a contract, as a pattern: %s a text, %d a number from 1 to 7."""
    kind = schema.get("type")
    if "enum" in schema:
        return f'"{schema["enum"][0]}"'
    if "anyOf" in schema or isinstance(kind, list):
        return "null"
    if kind == "object":
        members = [f'"{k}":{_example(v)}' for k, v in schema.get("properties", {}).items()]
        return "{" + ",".join(members or ['"any":"%s"']) + "}"
    return {"string": '"%s"', "boolean": "true", "array": "[]", "integer": "%d"}.get(kind, "0")


def _cases() -> list[tuple[str, str, str, str]]:
    """(regime, type, pattern, breach): for each contract one that keeps it and one of each kind that does not."""
    out = []
    for (code, kind), schema in CONTRACTS.items():
        members = {k: _example(v) for k, v in schema["properties"].items()}
        text = lambda m: "{" + ",".join(f'"{k}":{v}' for k, v in m.items()) + "}"
        number = next(k for k, v in schema["properties"].items() if v.get("type") == "integer" and "minimum" in v)
        least = schema["properties"][number]["minimum"]
        needed = schema["required"][-1]
        out += [
            (code, kind, text(members), "ok"), (code, kind, text({k: v for k, v in members.items() if k != needed}), f"$.{needed} required"), (code, kind, text(members | {number: '"%d"'}), f"$.{number} type"),
            (code, kind, text(members | {number: str(least - 1)}), f"$.{number} minimum"), (code, kind, f"[{text(members)}]", "$ type"),
        ]
    return out + [("us_house", "holding", "{}", "unregistered"), ("br", "holding", "{", "$ json")]


CASES = _cases()


@query("r4_contracts", f"SELECT l.id, v.regime_code, v.breach FROM line l JOIN (VALUES {', '.join(f'({k}, {c!r}, {b!r})' for k, (c, _, _, b) in enumerate(CASES))}) AS v(k, regime_code, breach) ON v.k = CAST(l.filing_id AS BIGINT) % {len(CASES)}")
def r4_contracts(d):
    """Details of every record against the contract of its regime and type."""
    at = F.pmod(F.col("filing_id").cast("long"), F.lit(len(CASES))).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in CASES]), at)
    details = F.replace(F.replace(pick(2), F.lit("%s"), F.col("asset_description_raw")), F.lit("%d"), (1 + F.col("ordinal") % 7).cast("string"))
    rows = d.line.select("id", pick(0).alias("regime_code"), pick(1).alias("kind"), details.alias("details"))
    return rows.select("id", "regime_code", contracts.checked(CONTRACTS, F.col("regime_code"), F.col("kind"), F.col("details")).alias("breach"))


@query(
    "r13_drift_state",
    """SELECT source, max_by(kind, pass) AS kind, count(*) AS detections, min(pass) AS since, bool_or(kind IN ('layout_shift', 'count_zero', 'regime_change')) AS frozen FROM (
         SELECT source, pass, kind, max(CASE WHEN kind = 'none' THEN pass END) OVER (PARTITION BY source) AS recovered FROM (
           SELECT adapter || regime_id AS source, id AS pass, ['none', 'count_delta', 'probe_error', 'layout_shift', 'status_error', 'count_zero', 'probe_error'][CAST(CAST(id AS BIGINT) % 7 AS INTEGER) + 1] AS kind FROM pipeline_run))
       WHERE kind <> 'none' AND (recovered IS NULL OR pass > recovered) GROUP BY source""",
)
def r13(d):
    kinds = ("none", "count_delta", "probe_error", "layout_shift", "status_error", "count_zero", "probe_error")
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("id").cast("long") % 7).cast("int"))
    return trust.drift_state(d.pipeline_run.select(F.concat("adapter", "regime_id").alias("source"), F.col("id").alias("pass"), kind.alias("kind")))


_PASSES = """SELECT adapter || regime_id AS source, CAST(id AS BIGINT) AS pass, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 7 = 0 THEN 304 WHEN n % 11 = 0 THEN 500 ELSE 200 END AS status, n % 17 <> 0 AS markers,
      CASE WHEN n % 29 = 0 THEN 0 WHEN n % 19 = 0 THEN 3 ELSE 5 + n // 4000 END AS entries, CASE WHEN n % 23 < 2 THEN 'b' ELSE 'a' END AS layout FROM (SELECT *, CAST(id AS BIGINT) // 3 AS n FROM pipeline_run) q"""
# pass after pass, with the baseline as it stands
_WATCHED = f"""p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass) AS k FROM ({_PASSES}) x),
  w AS (
    SELECT DISTINCT source, 0::BIGINT AS k, NULL::BIGINT AS pass, NULL::VARCHAR AS kind, NULL::VARCHAR AS mark, NULL::VARCHAR AS base_layout, NULL::BIGINT AS base_entries FROM p
    UNION ALL
    SELECT source, k, pass, kind, mark, CASE WHEN kind = 'none' AND status = 200 THEN layout ELSE base_layout END, CASE WHEN kind = 'none' AND status = 200 THEN entries ELSE base_entries END
    FROM (SELECT w.source, p.k, p.pass, w.base_layout, w.base_entries, p.layout, p.entries, p.status,
            CASE WHEN p.status IS NULL THEN 'probe_error' WHEN p.status = 304 THEN 'none' WHEN p.status <> 200 THEN 'status_error' WHEN NOT p.markers THEN 'regime_change'
                 WHEN p.entries = 0 AND w.base_entries > 0 THEN 'count_zero' WHEN p.layout <> w.base_layout THEN 'layout_shift' WHEN p.entries < w.base_entries THEN 'count_delta' ELSE 'none' END AS kind,
            CASE WHEN p.status IS NULL THEN 'transport' WHEN p.status <> 200 THEN CAST(p.status AS VARCHAR) WHEN NOT p.markers THEN 'markers' WHEN p.entries = 0 AND w.base_entries > 0 THEN 'zero'
                 WHEN p.layout <> w.base_layout THEN p.layout ELSE 'shrink' END AS mark
          FROM w JOIN p ON p.source = w.source AND p.k = w.k + 1) z)"""


def watched_passes(d):
    n = F.expr("CAST(id AS BIGINT) DIV 3")
    return d.pipeline_run.select(
        F.concat("adapter", "regime_id").alias("source"), F.col("id").cast("long").alias("pass"), F.when(n % 13 == 0, None).when(n % 7 == 0, 304).when(n % 11 == 0, 500).otherwise(200).alias("status"), (n % 17 != 0).alias("markers"),
        F.when(n % 29 == 0, F.lit(0)).when(n % 19 == 0, 3).otherwise(5 + F.expr("CAST(id AS BIGINT) DIV 3 DIV 4000")).cast("long").alias("entries"), F.when(n % 23 < 2, "b").otherwise("a").alias("layout"),
    )


@query(
    "r13_drift_reports",
    f"""WITH {_WATCHED}, seen AS (SELECT *, kind IN ('layout_shift', 'count_zero', 'regime_change') AS frz, (SELECT min(h.pass) FROM w h WHERE h.source = w.source AND h.kind = 'none' AND h.k > w.k) AS next_healthy FROM w WHERE k > 0 AND kind <> 'none')
        SELECT source, source || ':' || kind || ':' || mark AS dedup_key, min(pass) AS opened, any_value(kind) AS kind, any_value(frz) AS "freeze", count(*) AS detections, CASE WHEN any_value(frz) THEN coalesce(any_value(next_healthy), max(pass)) ELSE max(pass) END AS last_pass, CASE WHEN any_value(frz) THEN any_value(next_healthy) END AS resolved
        FROM seen GROUP BY source, kind, mark, CASE WHEN frz THEN coalesce(next_healthy, -1) END""",
)
def r13_reports(d):
    """Reports over all passes: opened, seen again, and resolved by a healthy pass where they froze publication."""
    return drift.reports(watched_passes(d)).drop("score")


@query(
    "r25_zero_rows",
    """SELECT f.id, CASE WHEN count(l.id) > 0 OR CAST(f.regime_id AS INTEGER) % 5 = 1 THEN 'accept' ELSE 'reject' END AS outcome FROM filing f
       LEFT JOIN line l ON l.filing_id = f.id AND l.record_type = 'holding' AND l.low_cents > 6000000 GROUP BY f.id, f.regime_id""",
)
def r25(d):
    rows = d.line.where("record_type = 'holding' AND low_cents > 6000000").groupBy(F.col("filing_id").alias("id")).agg(F.count("*").alias("rows"))
    documents = d.filing.select("id", "regime_id").join(rows, "id", "left").fillna(0, ["rows"])
    policy = d.regime.select(F.col("id").alias("regime_id"), (F.col("id").cast("int") % 5 == 1).alias("zero_is_correct"))
    return trust.zero_rows(documents, policy).select("id", "outcome")


@query(
    "r26_coverage",
    """SELECT t.regime_id, count(*) AS target_years, count(h.year) AS done_years, count(*) = count(h.year) AS complete
       FROM (SELECT id AS regime_id, unnest(range(1990, 1996 + CAST(id AS INTEGER) % 6)) AS year FROM regime) t
       LEFT JOIN (SELECT DISTINCT regime_id, year(filed_date) AS year FROM filing WHERE priority = '1-URGENT') h ON h.regime_id = t.regime_id AND h.year = t.year GROUP BY 1""",
)
def r26(d):
    targets = d.regime.select(F.col("id").alias("regime_id"), F.lit(1990).alias("first_year"), (F.lit(1995) + F.col("id").cast("int") % 6).alias("last_year"))
    present = d.filing.where("priority = '1-URGENT'").select("regime_id", F.year("filed_date").alias("year"))
    return trust.coverage(present, targets)


@query(
    "k11_scoped_copy",
    """SELECT 'filing' AS relation, count(*) AS rows FROM filing WHERE regime_id = '3' AND CAST(id AS BIGINT) % 4 <> 0
       UNION ALL SELECT 'line', count(*) FROM line l JOIN filing f ON l.filing_id = f.id WHERE f.regime_id = '3' AND l.ordinal > 1""",
)
def k11(d):
    source = {"filing": d.filing, "line": d.line}
    target = {"filing": d.filing.where("CAST(id AS BIGINT) % 4 = 0"), "line": d.line.where("ordinal = 1")}
    out = exports.scoped_copy(source, target, {"line": ("filing_id", "filing")}, "filing", F.col("regime_id") == "3")
    return A.union_counts(**out)


@query("s22_seed", "SELECT id, code, id IN (SELECT regime_id FROM filing WHERE status = 'P' AND priority = '1-URGENT' AND year(filed_date) = 1995) AS live FROM regime")
def s22(d):
    live = d.filing.where("status = 'P' AND priority = '1-URGENT' AND year(filed_date) = 1995").select(F.col("regime_id").alias("id")).distinct()
    rows = d.regime.select("id", "code")
    return rows.join(live, "id", "left_semi").withColumn("live", F.lit(True)).unionByName(rows.join(live, "id", "left_anti").withColumn("live", F.lit(False)))
