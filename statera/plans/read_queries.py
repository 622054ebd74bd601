"""The read surface: filters, pages, search, joins, chains."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import chains, filters, joins, paging, reads, trust
from .catalog import query
from .domain import RECORD_TYPES

AS_OF = dt.datetime(2001, 6, 30)
BOUND = "TIMESTAMP '2001-06-30 00:00:00'"


@query(
    "p1_record_filter",
    f"""SELECT id, politician_id, record_type, event_date, low_cents, high_cents FROM record
        WHERE regime_id IN (SELECT id FROM regime WHERE jurisdiction_id = '2') AND record_type = 'transaction'
          AND event_date >= DATE '1996-01-01' AND event_date <= DATE '2001-12-31'
          AND low_cents IS NOT NULL AND (high_cents IS NULL OR high_cents >= 2000000) AND low_cents <= 7000000
          AND verification_state = 'verified' AND discovered_at <= {BOUND}""",
)
def p1(d):
    f = filters.RecordFilter(jurisdiction="2", record_type="transaction", event_from=dt.date(1996, 1, 1), event_to=dt.date(2001, 12, 31), min_cents=2_000_000, max_cents=7_000_000, verification_state="verified", visible_until=AS_OF)
    return f.apply(d.record, d.regime).select("id", "politician_id", "record_type", "event_date", "low_cents", "high_cents")


@query("p1_instrument", "SELECT id, instrument_id, record_type FROM record WHERE instrument_id = '00000077' AND event_date >= DATE '1994-01-01'")
def p1_instrument(d):
    f = filters.RecordFilter(instrument="00000077", event_from=dt.date(1994, 1, 1))
    return f.apply(d.record).select("id", "instrument_id", "record_type")


@query(
    "api_filing_document",
    f"""SELECT f.id, r.url, r.sha FROM filing f JOIN raw_document r ON f.raw_document_id = r.id
        WHERE EXISTS (SELECT 1 FROM record e WHERE e.filing_id = f.id AND e.verification_state = 'verified' AND e.discovered_at <= {BOUND})""",
)
def api_filing_document(d):
    reader = filters.RecordFilter(verification_state="verified", visible_until=AS_OF)
    return filters.documents_of(d.filing, d.raw_document, d.record, reader).select("id", "url", "sha")


@query("p2_value_overlap", "SELECT id, low_cents, high_cents FROM record WHERE low_cents IS NOT NULL AND (high_cents IS NULL OR high_cents >= 5000000) AND low_cents <= 6000000")
def p2(d):
    return d.line.where(filters.at_least(5_000_000) & filters.at_most(6_000_000)).select("id", "low_cents", "high_cents")


@query("p3_freshness", f"SELECT regime_id, count(*) AS n FROM filing WHERE discovered_at <= {BOUND} GROUP BY regime_id")
def p3(d):
    return d.filing.where(filters.visible(AS_OF)).groupBy("regime_id").agg(F.count("*").alias("n"))


@query("p4_substring", r"SELECT id, canonical_name FROM politician WHERE canonical_name ILIKE '%R#0000001\_%' ESCAPE '\' OR canonical_name ILIKE '%#00000012%'")
def p4(d):
    return d.politician.where(filters.contains_text("canonical_name", "R#0000001_") | filters.contains_text("canonical_name", "#00000012")).select("id", "canonical_name")


@query("p5_alias_match", "SELECT id, canonical_name FROM politician p WHERE canonical_name ILIKE '%00077%' OR EXISTS (SELECT 1 FROM politician_alias a WHERE a.politician_id = p.id AND a.alias ILIKE '%hold 12%')")
def p5(d):
    by_alias = d.politician_alias.where(filters.contains_text("alias", "hold 12")).select(F.col("politician_id").alias("id")).distinct()
    named = d.politician.where(filters.contains_text("canonical_name", "00077")).select("id")
    return d.politician.join(named.union(by_alias).distinct(), "id", "left_semi").select("id", "canonical_name")


@query(
    "p5_name_or_alias",
    "SELECT id, canonical_name FROM politician p WHERE canonical_name ILIKE '%y 2%' OR EXISTS (SELECT 1 FROM politician_alias a WHERE a.politician_id = p.id AND a.alias ILIKE '%y 2%')",
)
def p5_both(d):
    return filters.name_or_alias(d.politician, d.politician_alias, "Y 2").select("id", "canonical_name")


@query("p7_run_filter", "SELECT id, adapter, stage, status FROM pipeline_run WHERE adapter = 'adapter3' AND status = 'failed' AND started_at >= TIMESTAMP '2024-01-05 00:00:00' AND started_at < TIMESTAMP '2024-01-20 00:00:00'")
def p7(d):
    at = F.col("started_at")
    inside = (at >= F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz")) & (at < F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz"))
    return d.pipeline_run.where((F.col("adapter") == "adapter3") & (F.col("status") == "failed") & inside).select("id", "adapter", "stage", "status")


@query("p8_membership", "SELECT stage, count(*) AS n FROM pipeline_run WHERE stage IN ('parse', 'normalize') AND status NOT IN ('running') GROUP BY stage")
def p8(d):
    return d.pipeline_run.where(F.col("stage").isin("parse", "normalize") & ~F.col("status").isin("running")).groupBy("stage").agg(F.count("*").alias("n"))


@query("p9_distinct_from", "SELECT owner IS NOT DISTINCT FROM 'joint' AS joint, count(*) AS n FROM line GROUP BY 1")
def p9(d):
    return d.line.groupBy(F.col("owner").eqNullSafe("joint").alias("joint")).agg(F.count("*").alias("n"))


@query("p10_guarded_cast", "SELECT id, CASE WHEN regexp_matches(json_extract_string(stats, '$.k'), '^[0-9]+$') THEN CAST(json_extract_string(stats, '$.k') AS BIGINT) END AS k FROM pipeline_run WHERE stage = 'parse'")
def p10(d):
    return d.pipeline_run.where("stage = 'parse'").select("id", filters.guarded_int(F.get_json_object("stats", "$.k")).alias("k"))


@query(
    "p12_claimable",
    """SELECT id, target_id FROM review_task t WHERE status = 'open' AND priority < 3
         AND NOT EXISTS (SELECT 1 FROM review_task l WHERE l.status = 'open' AND l.priority = 3 AND l.target_id = t.target_id)""",
)
def p12(d):
    leases = d.review_task.where("status = 'open' AND priority = 3").select(F.col("id").alias("task_id"), "target_id", F.lit(True).alias("live"))
    return filters.claimable(d.review_task.where("priority < 3"), leases).select("id", "target_id")


@query("o1_keyset", "SELECT id, filing_id, record_type FROM record WHERE record_type = 'holding' AND id > '0000002000001' ORDER BY id LIMIT 51")
def o1(d):
    return paging.page(d.line.where("record_type = 'holding'"), 50, "0000002000001").select("id", "filing_id", "record_type")


@query("o2_keyset_desc", "SELECT id, stage, status FROM pipeline_run WHERE id < '0000000900' ORDER BY id DESC LIMIT 101")
def o2(d):
    return paging.page(d.pipeline_run, 100, "0000000900", descending=True).select("id", "stage", "status")


@query(
    "o3_mixed_keyset",
    """SELECT id, hours, created_at FROM (SELECT id, hours, created_at, row_number() OVER (ORDER BY hours DESC NULLS LAST, created_at, id) AS n FROM review_task) t,
         (SELECT n AS m FROM (SELECT id, row_number() OVER (ORDER BY hours DESC NULLS LAST, created_at, id) AS n FROM review_task) WHERE id = '0000000500') a
       WHERE n > m AND n <= m + 51""",
)
def o3(d):
    order = [("hours", True), ("created_at", False), ("id", False)]
    rows = d.review_task.select("id", "hours", "created_at")
    return paging.mixed_page(rows, order, paging.anchor(rows, "0000000500", [n for n, _ in order]), 50)


@query(
    "o3_null_anchor",
    """SELECT id, hours, created_at FROM (SELECT id, hours, created_at, row_number() OVER (ORDER BY hours DESC NULLS LAST, created_at, id) AS n FROM review_task) t,
         (SELECT n AS m FROM (SELECT id, row_number() OVER (ORDER BY hours DESC NULLS LAST, created_at, id) AS n FROM review_task) WHERE id = '0000000501') a
       WHERE n > m AND n <= m + 51""",
)
def o3_null(d):
    """A page after a row without the first key."""
    order = [("hours", True), ("created_at", False), ("id", False)]
    rows = d.review_task.select("id", "hours", "created_at")
    return paging.mixed_page(rows, order, paging.anchor(rows, "0000000501", [n for n, _ in order]), 50)


@query("o6_null_year", "SELECT id, year FROM (SELECT id, CASE WHEN status <> 'O' THEN CAST(year(filed_date) AS INTEGER) END AS year FROM filing WHERE priority = '1-URGENT' AND regime_id = '3') ORDER BY year NULLS LAST, id DESC LIMIT 200")
def o6(d):
    rows = d.filing.where("priority = '1-URGENT' AND regime_id = '3'").select("id", F.when(F.col("status") != "O", F.year("filed_date")).alias("year"))
    return paging.top(rows, 200, F.asc_nulls_last("year"), F.desc("id"))


@query("o4_topk", "SELECT id, seconds FROM pipeline_run WHERE status = 'failed' ORDER BY seconds DESC, id LIMIT 25")
def o4(d):
    return paging.top(d.pipeline_run.where("status = 'failed'").select("id", "seconds"), 25, F.desc_nulls_last("seconds"), F.asc("id"))


@query("o5_nulls_last", "SELECT id, owner, low_cents FROM line WHERE ordinal = 3 ORDER BY low_cents DESC NULLS LAST, owner NULLS FIRST, id LIMIT 40")
def o5(d):
    rows = d.line.where("ordinal = 3").select("id", "owner", "low_cents")
    return paging.top(rows, 40, F.desc_nulls_last("low_cents"), F.asc_nulls_first("owner"), F.asc("id"))


@query("o7_ranked_order", "SELECT id, adapter FROM pipeline_run ORDER BY CASE WHEN adapter = 'adapter5' THEN 0 ELSE 1 END, id DESC LIMIT 30")
def o7(d):
    return paging.top(d.pipeline_run.select("id", "adapter"), 30, F.when(F.col("adapter") == "adapter5", 0).otherwise(1).asc(), F.desc("id"))


@query(
    "o8_search",
    """(SELECT id, canonical_name AS name, 'politician' AS arm FROM politician WHERE canonical_name ILIKE '%00001%' ORDER BY id LIMIT 20)
       UNION ALL (SELECT id, code AS name, 'regime' AS arm FROM regime WHERE code ILIKE '%a%' ORDER BY id LIMIT 20)""",
)
def o8(d):
    people = d.politician.where(filters.contains_text("canonical_name", "00001")).select("id", F.col("canonical_name").alias("name"))
    regimes = d.regime.where(filters.contains_text("code", "a")).select("id", F.col("code").alias("name"))
    return paging.search({"politician": people, "regime": regimes})


@query("j1_provenance", "SELECT f.id, f.filed_date, r.sha, r.url FROM filing f JOIN raw_document r ON f.raw_document_id = r.id")
def j1(d):
    return d.filing.join(d.raw_document.withColumnRenamed("id", "raw_document_id"), "raw_document_id").select("id", "filed_date", "sha", "url")


@query(
    "j3_conditional_left",
    """SELECT t.id, t.target_kind, l.record_type, f.politician_id FROM review_task t
       LEFT JOIN line l ON t.target_kind = 'disclosure_record' AND l.id = t.target_id LEFT JOIN filing f ON f.id = l.filing_id WHERE t.status = 'open'""",
)
def j3(d):
    t, line, f = d.review_task.alias("t"), d.line.alias("l"), d.filing.alias("f")
    on = (F.col("t.target_kind") == "disclosure_record") & (F.col("l.id") == F.col("t.target_id"))
    out = t.where("status = 'open'").join(line, on, "left").join(f, F.col("f.id") == F.col("l.filing_id"), "left")
    return out.select("t.id", "t.target_kind", "l.record_type", "f.politician_id")


@query("j6_semi", "SELECT id, code FROM regime g WHERE EXISTS (SELECT 1 FROM filing f WHERE f.regime_id = g.id AND f.status = 'P')")
def j6(d):
    having = d.filing.where("status = 'P'").select(F.col("regime_id").alias("id"))
    return d.regime.join(having, "id", "left_semi").select("id", "code")


@query(
    "j7_anti",
    """SELECT id, url FROM (SELECT id, url, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN id END AS bridge FROM raw_document) r
       WHERE bridge IS NULL OR NOT EXISTS (SELECT 1 FROM filing f WHERE f.raw_document_id = r.bridge AND f.priority = '1-URGENT' AND f.status = 'P')""",
)
def j7(d):
    """Documents without a bridge key or whose key leads nowhere; a null key meets nothing, so one anti join keeps both."""
    bridged = d.filing.where("priority = '1-URGENT' AND status = 'P'").select(F.col("raw_document_id").alias("bridge"))
    rows = d.raw_document.select("id", "url", F.when(F.col("id").cast("long") % 5 != 0, F.col("id")).alias("bridge"))
    return rows.join(bridged, "bridge", "left_anti").select("id", "url")


@query(
    "j8_worst_row",
    """SELECT reason, count(*) AS n, first(id ORDER BY priority DESC, id) AS worst_id, first(priority ORDER BY priority DESC, id) AS worst_priority
       FROM review_task WHERE status = 'open' GROUP BY reason""",
)
def j8(d):
    return joins.worst(d.review_task.where("status = 'open'"), "reason", [(-F.col("priority")).alias("p"), F.col("id")], ["id", "priority"])


@query(
    "j9_range_expand",
    """SELECT id, CAST(y AS INTEGER) AS year FROM (SELECT id, birth_year + 40 AS s, CASE WHEN birth_year % 4 <> 0 THEN birth_year + 36 + birth_year % 9 END AS e FROM politician),
       LATERAL (SELECT unnest(range(s, coalesce(e, 2024) + 1)) AS y)""",
)
def j9(d):
    spans = d.politician.select("id", (F.col("birth_year") + 40).alias("s"), F.when(F.col("birth_year") % 4 != 0, F.col("birth_year") + 36 + F.col("birth_year") % 9).alias("e"))
    return joins.expand_years(spans, "s", F.coalesce("e", F.lit(2024))).select("id", "year")


RULES = [
    (k, RECORD_TYPES[k % 4] if k % 3 else None, f"class{k % 9}" if k % 2 else None, ("verified", "disputed")[k % 2] if k % 5 == 0 else None, 1_000_000 * k if k % 4 else None, 9_000_000 if k % 7 == 0 else None, dt.date(1995 + k % 6, 1, 1), None if k % 3 else dt.date(2001, 12, 31))
    for k in range(1, 31)
]


def _literal(v) -> str:
    return "NULL" if v is None else f"DATE '{v}'" if isinstance(v, dt.date) else f"'{v}'" if isinstance(v, str) else str(v)


RULES_SQL = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in RULES) + ") AS v(rule_id, record_type, asset_class, verification_state, min_cents, max_cents, event_from, event_to))"
MATCHES_SQL = f"""SELECT r.rule_id, e.id AS record_id FROM record e JOIN {RULES_SQL} r ON (r.record_type IS NULL OR r.record_type = e.record_type)
   AND (r.asset_class IS NULL OR r.asset_class = e.asset_class) AND (r.verification_state IS NULL OR r.verification_state = e.verification_state)
   AND (r.min_cents IS NULL OR (e.low_cents IS NOT NULL AND (e.high_cents IS NULL OR e.high_cents >= r.min_cents)))
   AND (r.max_cents IS NULL OR (e.low_cents IS NOT NULL AND e.low_cents <= r.max_cents))
   AND (r.event_from IS NULL OR e.event_date >= r.event_from) AND (r.event_to IS NULL OR e.event_date <= r.event_to)"""


def rules(spark):
    ddl = "rule_id int, record_type string, asset_class string, verification_state string, min_cents long, max_cents long, event_from date, event_to date"
    channels = F.when(F.col("rule_id") % 3 == 0, F.array(F.lit("email"), F.lit("digest"))).when(F.col("rule_id") % 3 == 1, F.array(F.lit("webhook"))).otherwise(F.array(F.lit("digest")))
    return spark.createDataFrame(RULES, ddl).withColumn("channels", channels)


@query("j10_rule_match", MATCHES_SQL)
def j10(d):
    return joins.match_rules(d.record, rules(d.record.sparkSession), RECORD_TYPES).select("rule_id", "record_id")


@query("j11_bridge", "SELECT DISTINCT p.adapter, f.regime_id FROM filing f JOIN raw_document r ON f.raw_document_id = r.id JOIN pipeline_run p ON p.regime_id = f.regime_id AND p.stage = 'fetch'")
def j11(d):
    pairs = d.pipeline_run.where("stage = 'fetch'").select("adapter", "regime_id").distinct()
    bridged = d.filing.join(d.raw_document.select(F.col("id").alias("raw_document_id")), "raw_document_id", "left_semi").select("regime_id").distinct()
    return pairs.join(bridged, "regime_id").select("adapter", "regime_id")


@query(
    "j13_nest_composite",
    """SELECT p.body, p.regime_id, count(f.id) AS filings, coalesce(string_agg(f.id, ',' ORDER BY f.id), '') AS ids FROM (SELECT DISTINCT body, regime_id FROM politician) p
       LEFT JOIN (SELECT f.id, q.body, q.regime_id FROM filing f JOIN politician q ON f.politician_id = q.id WHERE f.status = 'P' AND f.priority = '1-URGENT') f
         ON p.body = f.body AND p.regime_id = f.regime_id GROUP BY 1, 2""",
)
def j13(d):
    people = d.politician.select(F.col("id").alias("politician_id"), "body", "regime_id")
    children = d.filing.where("status = 'P' AND priority = '1-URGENT'").drop("regime_id").join(people, "politician_id").select("body", "regime_id", "id")
    out = joins.nest(d.politician.select("body", "regime_id").distinct(), children, ["body", "regime_id"], ["id"], [])
    return out.select("body", "regime_id", F.size("items").cast("long").alias("filings"), F.array_join(F.transform("items", lambda s: s["id"]), ",").alias("ids"))


@query(
    "j14_first_match",
    """SELECT f.id, first(l.id ORDER BY l.ordinal) AS line_id FROM filing f LEFT JOIN line l ON l.filing_id = f.id AND l.record_type = 'holding' WHERE f.status = 'P' GROUP BY f.id""",
)
def j14(d):
    holdings = d.line.where("record_type = 'holding'").select(F.col("filing_id").alias("id"), "ordinal", F.col("id").alias("line_id"))
    return joins.first_match(d.filing.where("status = 'P'").select("id"), holdings, ["id"], "ordinal", ["line_id"])


@query(
    "j15_rollup",
    """SELECT g.id AS regime_id, coalesce(f.filings, 0) AS filings, coalesce(r.runs, 0) AS runs, coalesce(p.people, 0) AS people FROM regime g
       LEFT JOIN (SELECT regime_id, count(*) AS filings FROM filing WHERE status = 'P' GROUP BY 1) f ON f.regime_id = g.id
       LEFT JOIN (SELECT regime_id, count(*) AS runs FROM pipeline_run WHERE status = 'failed' GROUP BY 1) r ON r.regime_id = g.id
       LEFT JOIN (SELECT regime_id, count(*) AS people FROM politician GROUP BY 1) p ON p.regime_id = g.id""",
)
def j15(d):
    count = lambda df, name: df.groupBy("regime_id").agg(F.count("*").alias(name))
    return joins.rollup_by("regime_id", d.regime.select(F.col("id").alias("regime_id")), count(d.filing.where("status = 'P'"), "filings"), count(d.pipeline_run.where("status = 'failed'"), "runs"), count(d.politician, "people"))


@query("j16_nested", "SELECT j.id, j.name, string_agg(g.code, ',' ORDER BY g.code) AS regimes FROM jurisdiction j LEFT JOIN regime g ON g.jurisdiction_id = j.id GROUP BY 1, 2")
def j16(d):
    out = joins.nest(d.jurisdiction, d.regime.select(F.col("jurisdiction_id").alias("id"), "code"), ["id"], ["code"], [], "regimes")
    return out.select("id", "name", F.array_join(F.transform("regimes", lambda s: s["code"]), ",").alias("regimes"))


@query("j17_json_key", "SELECT p.id, f.code FROM pipeline_run p JOIN regime f ON f.id = json_extract_string(p.stats, '$.k')")
def j17(d):
    runs = d.pipeline_run.select(F.col("id"), F.get_json_object("stats", "$.k").alias("k"))
    return runs.join(d.regime.select(F.col("id").alias("k"), "code"), "k").select("id", "code")


@query(
    "j18_polymorphic",
    """SELECT regime_id, count(*) AS tasks FROM (
         SELECT t.id, f.regime_id FROM review_task t JOIN line l ON t.target_kind = 'disclosure_record' AND t.target_id = l.id JOIN filing f ON f.id = l.filing_id
         UNION ALL SELECT t.id, f.regime_id FROM review_task t JOIN filing f ON t.target_kind = 'filing' AND t.target_id = f.id
         UNION ALL SELECT t.id, split_part(t.target_id, ':', 1) FROM review_task t WHERE t.target_kind = 'regime') u GROUP BY 1""",
)
def j18(d):
    lines = d.line.join(d.filing.select(F.col("id").alias("filing_id"), "regime_id"), "filing_id").select("id", "regime_id")
    arms = joins.routed(d.review_task, {"disclosure_record": (lines, "id"), "filing": (d.filing, "id")})
    codes = d.review_task.where("target_kind = 'regime'").select("id", F.split_part("target_id", F.lit(":"), F.lit(1)).alias("regime_id"))
    return arms.unionByName(codes).groupBy("regime_id").agg(F.count("*").alias("tasks"))


@query(
    "j19_predistinct",
    """SELECT x.regime_id, CAST(sum(s.n) AS BIGINT) AS rows FROM (SELECT DISTINCT raw_document_id, regime_id FROM filing) x
       JOIN (SELECT id, length(body) AS n FROM raw_document) s ON s.id = x.raw_document_id GROUP BY 1""",
)
def j19(d):
    pairs = d.filing.select("raw_document_id", "regime_id").distinct()
    sizes = d.raw_document.select(F.col("id").alias("raw_document_id"), F.char_length("body").alias("n"))
    return pairs.join(sizes, "raw_document_id").groupBy("regime_id").agg(F.sum("n").cast("long").alias("rows"))


CHAIN = "c AS (SELECT id, supersedes_record_id FROM record)"


@query(
    "u3_chain_up",
    f"""WITH {CHAIN}, up AS (
         SELECT id AS start_id, id, supersedes_record_id AS parent, 0 AS depth FROM c
         UNION ALL SELECT up.start_id, c.id, c.supersedes_record_id, up.depth + 1 FROM up JOIN c ON c.id = up.parent)
       SELECT start_id, id, depth FROM up""",
)
def u3(d):
    return chains.chain_up(d.record, d.record)


@query(
    "u5_visible_chain",
    f"""WITH {CHAIN}, up AS (
         SELECT id AS start_id, id, supersedes_record_id AS parent, 0 AS depth FROM c
         UNION ALL SELECT up.start_id, c.id, c.supersedes_record_id, up.depth + 1 FROM up JOIN c ON c.id = up.parent)
       SELECT start_id, up.id, depth FROM up JOIN record e ON e.id = up.id WHERE depth > 0 AND e.discovered_at <= {BOUND} AND e.verification_state = 'verified'""",
)
def u5(d):
    return chains.visible(chains.chain_up(d.record, d.record), d.record, filters.RecordFilter(visible_until=AS_OF, verification_state="verified"))


@query(
    "u4_chain_down",
    f"""WITH {CHAIN}, down AS (
         SELECT id AS start_id, id, 0 AS depth FROM c WHERE id LIKE '%001'
         UNION ALL SELECT down.start_id, c.id, down.depth + 1 FROM down JOIN c ON c.supersedes_record_id = down.id)
       SELECT start_id, count(*) AS members, max(depth) AS depth FROM down GROUP BY 1""",
)
def u4(d):
    out = chains.chain_down(d.record, d.record.where("id LIKE '%001'"))
    return out.groupBy("start_id").agg(F.count("*").alias("members"), F.max("depth").alias("depth"))


@query(
    "u6_missing_years",
    """SELECT r.regime_id, CAST(y AS INTEGER) AS missing_year FROM (SELECT DISTINCT regime_id FROM filing WHERE priority = '1-URGENT') r, (SELECT unnest(range(1990, 2006)) AS y)
       WHERE NOT EXISTS (SELECT 1 FROM filing f WHERE f.regime_id = r.regime_id AND f.priority = '1-URGENT' AND year(f.filed_date) = y)""",
)
def u6(d):
    have = d.filing.where("priority = '1-URGENT'").select("regime_id", F.year("filed_date").alias("year"))
    return chains.missing_years(have, "regime_id", "year", 1990, 2005)


@query("u7_new_keys", "SELECT count(*) AS new_records FROM line WHERE record_type = 'holding' AND asset_description_raw NOT IN (SELECT asset_description_raw FROM line WHERE record_type = 'interest')")
def u7(d):
    new = chains.new_keys(d.line.where("record_type = 'holding'"), d.line.where("record_type = 'interest'"), "asset_description_raw")
    return new.agg(F.count("*").alias("new_records"))


@query("j2_inner", f"SELECT r.rule_id, m.record_id, p.canonical_name FROM ({MATCHES_SQL}) m JOIN {RULES_SQL} r ON r.rule_id = m.rule_id JOIN record e ON e.id = m.record_id JOIN politician p ON p.id = e.politician_id WHERE r.asset_class = 'class3'")
def j2(d):
    """Matches with their rule, record and filer."""
    some = rules(d.record.sparkSession).where("asset_class = 'class3'")
    matched = joins.match_rules(d.record, some, RECORD_TYPES)
    records = d.record.select(F.col("id").alias("record_id"), "politician_id")
    people = d.politician.select(F.col("id").alias("politician_id"), "canonical_name")
    return matched.join(records, "record_id").join(people, "politician_id").select("rule_id", "record_id", "canonical_name")


@query(
    "r30_record_summary",
    "SELECT l.id, p.canonical_name, g.code, f.filed_date FROM line l JOIN filing f ON l.filing_id = f.id JOIN politician p ON f.politician_id = p.id JOIN regime g ON f.regime_id = g.id WHERE l.ordinal = 1",
)
def r30(d):
    f = d.filing.select(F.col("id").alias("filing_id"), "politician_id", "regime_id", "filed_date")
    people, regimes = d.politician.select(F.col("id").alias("politician_id"), "canonical_name"), d.regime.select(F.col("id").alias("regime_id"), "code")
    return d.line.where("ordinal = 1").join(f, "filing_id").join(people, "politician_id").join(regimes, "regime_id").select("id", "canonical_name", "code", "filed_date")


@query("r14_deliveries", f"SELECT rule_id, record_id, channel, concat_ws(':', CAST(rule_id AS VARCHAR), record_id, channel) AS dedup_key, CASE channel WHEN 'digest' THEN 'pending_digest' ELSE 'pending' END AS status FROM (SELECT *, unnest(CASE rule_id % 3 WHEN 0 THEN ['email', 'digest'] WHEN 1 THEN ['webhook'] ELSE ['digest'] END) AS channel FROM ({MATCHES_SQL}) m)")
def r14(d):
    return trust.deliveries(joins.match_rules(d.record, rules(d.record.sparkSession), RECORD_TYPES))


@query(
    "api_record_detail",
    f"""WITH {CHAIN}, seen AS (SELECT * FROM record WHERE politician_id < '00000100' AND discovered_at <= {BOUND} AND verification_state = 'verified'),
         up AS (SELECT id AS start_id, id, supersedes_record_id AS parent, 0 AS depth FROM seen UNION ALL SELECT up.start_id, c.id, c.supersedes_record_id, up.depth + 1 FROM up JOIN c ON c.id = up.parent),
         down AS (SELECT id AS start_id, id, 0 AS depth FROM seen UNION ALL SELECT down.start_id, c.id, down.depth + 1 FROM down JOIN c ON c.supersedes_record_id = down.id),
         shown AS (SELECT id FROM record WHERE discovered_at <= {BOUND} AND verification_state = 'verified')
       SELECT s.id, s.filing_id, f.filed_date, d.sha, g.code, coalesce((SELECT string_agg(u.id, ',' ORDER BY depth) FROM up u JOIN shown USING (id) WHERE u.start_id = s.id AND depth > 0), '') AS supersedes,
              coalesce((SELECT string_agg(u.id, ',' ORDER BY depth) FROM down u JOIN shown USING (id) WHERE u.start_id = s.id AND depth > 0), '') AS superseded_by
       FROM seen s JOIN filing f ON f.id = s.filing_id JOIN raw_document d ON d.id = f.raw_document_id JOIN regime g ON g.id = s.regime_id""",
)
def api_record_detail(d):
    """Some politicians' records as a reader bound to a date sees them, with provenance and both sides of their chains."""
    reader = filters.RecordFilter(visible_until=AS_OF, verification_state="verified")
    documented = d.filing.join(d.raw_document.select(F.col("id").alias("raw_document_id")), "raw_document_id", "left_semi").select(F.col("id").alias("filing_id"))
    starts = d.record.where("politician_id < '00000100'").join(documented, "filing_id", "left_semi")  # these tables lack some documents
    out = reads.record_details(d.record, starts, d.filing, d.raw_document, d.regime, reader)
    ids = lambda c: F.array_join(F.transform(c, lambda m: m.id), ",").alias(c)
    return out.select("id", "filing_id", "filing.filed_date", "document.sha", "regime.code", ids("supersedes"), ids("superseded_by"))


@query(
    "api_politicians",
    """SELECT p.id, p.canonical_name, coalesce(a.aliases, '') AS aliases, coalesce(f.n, 0) AS filings, f.last_filed, coalesce(r.n, 0) AS records FROM politician p
       LEFT JOIN (SELECT politician_id, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM politician_alias GROUP BY 1) a ON a.politician_id = p.id
       LEFT JOIN (SELECT politician_id, count(*) AS n, max(filed_date) AS last_filed FROM filing GROUP BY 1) f ON f.politician_id = p.id
       LEFT JOIN (SELECT politician_id, count(*) AS n FROM record GROUP BY 1) r ON r.politician_id = p.id""",
)
def api_politicians(d):
    out = reads.profiles(d.politician, d.politician_alias, d.filing, d.record)
    return out.select("id", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "filings", "last_filed", "records")


@query(
    "api_review_queue",
    """SELECT t.id, t.priority, t.target_kind, coalesce(f.regime_id, CASE WHEN t.target_kind = 'regime' THEN split_part(t.target_id, ':', 1) END) AS regime_id, g.code AS regime_code
       FROM (SELECT * FROM review_task WHERE status = 'open' AND (priority < 3 OR (priority = 3 AND (created_at > TIMESTAMP '2024-01-02 00:00:00' OR (created_at = TIMESTAMP '2024-01-02 00:00:00' AND id > '')))) ORDER BY priority DESC, created_at, id LIMIT 101) t
       LEFT JOIN line l ON t.target_kind = 'disclosure_record' AND l.id = t.target_id LEFT JOIN filing f ON f.id = CASE WHEN t.target_kind = 'filing' THEN t.target_id ELSE l.filing_id END
       LEFT JOIN regime g ON g.id = coalesce(f.regime_id, CASE WHEN t.target_kind = 'regime' THEN split_part(t.target_id, ':', 1) END)""",
)
def api_review_queue(d):
    """The page of open tasks after a cursor, with the regimes they concern."""
    lines = d.line.join(d.filing.select(F.col("id").alias("filing_id"), "regime_id"), "filing_id")
    out = reads.review_queue(d.review_task, lines, d.filing, d.regime, 100, (3, "2024-01-02 00:00:00", ""))
    return out.select("id", "priority", "target_kind", "regime_id", "regime_code")
