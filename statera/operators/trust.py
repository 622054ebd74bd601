"""Claims, publication gates, verdicts, drift, diffs, identity and usage: the multi-step operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments


def claim(work: DataFrame, prior: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """new, retry or replay for each unit of work, by the best earlier run of its key."""
    done = prior.groupBy(key).agg(F.bool_or(F.col("status") == "succeeded").alias("done"))
    return work.join(done, key, "left").withColumn("claim", F.when(F.col("done"), "replay").when(F.col("done").isNotNull(), "retry").otherwise("new")).drop("done")


def redact(records: DataFrame, text: str, prefix: str, hidden: list[str]) -> DataFrame:
    """Without records whose text starts with the prefix (any case); hidden columns are blanked in the others."""
    out = records.where(~F.startswith(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(prefix.lower())))
    return out.withColumns({c: F.lit(None).cast(dict(out.dtypes)[c]) for c in hidden})


def verdict(checks: list[tuple[Column, str]]) -> Column:
    """The first check that fails names the verdict; a check that is null counts as failed; ok otherwise."""
    out = F.lit(None).cast("string")
    for ok, name in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return F.coalesce(out, F.lit("ok"))


def row_checks() -> list[tuple[Column, str]]:
    """Integrity of a gold record."""
    transaction, holding = F.col("record_type") == "transaction", F.col("record_type") == "holding"
    return [
        (~transaction | F.col("side").isNotNull(), "transaction_without_side"),
        (~transaction | F.col("transaction_date").isNotNull(), "transaction_without_date"),
        (~holding | F.col("as_of_date").isNotNull(), "holding_without_date"),
        (F.col("high_cents").isNull() | (F.col("high_cents") >= F.col("low_cents")), "inverted_value"),
    ]


def review_reasons(rules: list[tuple[Column, str]]) -> Column:
    """All reasons that apply, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(reason)) for c, reason in rules]))


def resolve(mentions: DataFrame, aliases: DataFrame, key: list[str], span: int = 65) -> DataFrame:
    """The one entity a mention can mean, else null: equal key, equal id where both have one, else years within ``span``; a mention without a year may mean any."""
    m, a = mentions.alias("m"), aliases.alias("a")
    on = [F.col(f"m.{k}") == F.col(f"a.{k}") for k in key]
    both = F.col("m.identifier").isNotNull() & F.col("a.identifier").isNotNull()
    fits = F.when(both, F.col("m.identifier") == F.col("a.identifier")).otherwise(F.col("m.year").isNull() | (F.abs(F.col("m.year") - F.col("a.first_year")) <= span))
    hits = m.join(a, on).where(fits).select("m.mention_id", "a.entity_id").distinct()
    one = hits.groupBy("mention_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    out = mentions.join(one, "mention_id", "left")
    return out.select("mention_id", F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def refuse_collisions(roster: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is theirs alone in this pass; the size of a group is an aggregate, not a window over it."""
    single = roster.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").select(*keys)
    return roster.join(single, keys, "left_semi")


def shared_identifiers(entities: DataFrame, filings: DataFrame, documents: DataFrame, staged: DataFrame) -> DataFrame:
    """Entities whose documents name more than one identifier: the identifiers, sorted, and how many."""
    f = filings.select(F.col("politician_id").alias("id"), "raw_document_id").distinct()
    s = staged.where("identifier IS NOT NULL").select("raw_document_id", "identifier").distinct()
    pairs = f.join(documents.select(F.col("id").alias("raw_document_id")), "raw_document_id", "left_semi").join(s, "raw_document_id").select("id", "identifier").distinct()
    found = pairs.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("identifier")).alias("identifiers")).where("n > 1")
    return entities.select("id", "canonical_name").join(found, "id")


def open_once(tasks: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    return proposed.dropDuplicates(key).join(tasks.where("status = 'open'").select(*key), key, "left_anti")


def agreed(rows: DataFrame, document: str, identity: str) -> DataFrame:
    """Per document its identity if all rows agree on one, else null."""
    return rows.groupBy(document).agg(F.when((F.min(identity) == F.max(identity)) & (F.count(identity) == F.count("*")), F.min(identity)).alias("identity"))


def diff_filings(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """add, supersession, change or unchanged per candidate filing against what was published.

    candidates and baseline: filing_id, year, fingerprint, supersedes (of the filing, or null).
    """
    known = baseline.groupBy("filing_id").agg(F.lit(True).alias("known"))
    fresh = candidates.join(baseline.select("filing_id", "fingerprint").distinct(), ["filing_id", "fingerprint"], "left_anti")
    fresh = fresh.groupBy("filing_id").agg(F.count("*").alias("new_records"))
    out = candidates.groupBy("filing_id").agg(F.min("year").alias("year"), F.max("supersedes").alias("supersedes"), F.count("*").alias("records"))
    out = out.join(known, "filing_id", "left").join(fresh, "filing_id", "left").fillna(0, ["new_records"])
    kind = F.when(F.col("known").isNull() & F.col("supersedes").isNotNull(), "supersession").when(F.col("known").isNull(), "add").when(F.col("new_records") > 0, "change").otherwise("unchanged")
    return out.select("filing_id", "year", "records", "new_records", kind.alias("kind"))


def budget_gate(diff: DataFrame, budget: int = 500) -> DataFrame:
    """Per year the totals of a diff, and whether its new records are within the budget."""
    return diff.groupBy("year").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("add", "supersession", "change", "unchanged")], F.sum("new_records").alias("record_delta")
    ).withColumn("proceed", F.col("record_delta") <= budget)


# Codes and scores of the kinds of drift, worst first, and which of them stop publication.
DRIFT_SCORES = {"layout_shift": 100, "count_zero": 90, "regime_change": 80, "status_error": 70, "probe_error": 60, "count_delta": 30}
FREEZING = ("layout_shift", "count_zero", "regime_change")


def drift(status: Column, markers: Column, count: Column, layout: Column, base_count: Column, base_layout: Column) -> Column:
    """Kind of drift of a probe against the baseline, the first that applies, or none; each part of a baseline may be missing."""
    return (
        F.when(status.isNull(), "probe_error")
        .when(status == 304, "none")
        .when((status < 200) | (status > 299), "status_error")
        .when(~markers, "regime_change")
        .when((count == 0) & (base_count > 0), "count_zero")
        .when(layout != base_layout, "layout_shift")
        .when((count >= 0) & (count < base_count), "count_delta")
        .otherwise("none")
    )


def drift_report(kind: Column, source: Column, status: Column, layout: Column) -> list[Column]:
    """score, freeze and dedup_key of a drift; the key holds what was seen, so one drift is reported once."""
    score = F.element_at(F.create_map(*[F.lit(x) for kv in DRIFT_SCORES.items() for x in kv]), kind)
    fixed = {"probe_error": "transport", "regime_change": "markers", "count_zero": "zero", "count_delta": "shrink"}
    seen = F.when(kind == "status_error", status.cast("string")).when(kind == "layout_shift", layout.cast("string"))
    for name, signature in fixed.items():
        seen = seen.when(kind == name, signature)
    drifts = kind != "none"
    return [F.when(drifts, score).alias("score"), F.when(drifts, kind.isin(*FREEZING)).alias("freeze"), F.when(drifts, F.concat_ws(":", source, kind, seen)).alias("dedup_key")]


def deliveries(matches: DataFrame) -> DataFrame:
    """One delivery per rule, record and channel; the key makes a second run insert nothing."""
    out = matches.select("rule_id", "record_id", F.explode("channels").alias("channel"))
    key = F.concat_ws(":", F.col("rule_id").cast("string"), "record_id", "channel")
    return out.select("rule_id", "record_id", "channel", key.alias("dedup_key"), F.when(F.col("channel") == "digest", "pending_digest").otherwise("pending").alias("status")).dropDuplicates(["dedup_key"])


def settle(attempted: DataFrame, max_attempts: int = 5, base_ms: int = 500) -> DataFrame:
    """Next state of deliveries with prior attempts and an outcome (sent, retryable, terminal), and the wait before a retry."""
    used = F.col("attempts") + 1
    status = F.when(F.col("outcome") == "sent", "sent").when((F.col("outcome") == "terminal") | (used >= max_attempts), "dead").otherwise("pending")
    wait = F.when(status == "pending", F.lit(base_ms) * F.pow(F.lit(2), F.col("attempts")).cast("long"))
    return attempted.withColumns({"status": status, "attempts": used, "wait_ms": wait})


def digests(pending: DataFrame) -> DataFrame:
    """Pending digest deliveries grouped into messages; a message's budget follows its most attempted delivery."""
    return pending.where("channel = 'digest'").groupBy("rule_id", "channel").agg(F.count("*").alias("deliveries"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"), F.max("attempts").alias("attempts"))


def usage_report(events: DataFrame) -> DataFrame:
    """Per user one report of the unbilled events; the id follows from what it covers."""
    out = events.where("NOT billed").groupBy("user_id").agg(F.min("id").alias("first_event"), F.max("id").alias("last_event"), F.count("*").alias("n_events"))
    return out.withColumn("report_id", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("first_event").cast("string"), F.col("last_event").cast("string")), 256))


def over_quota(events: DataFrame, quota: int) -> DataFrame:
    days = events.groupBy("user_id", F.to_date("at").alias("day")).agg(F.count("*").alias("calls"))
    return days.withColumn("over", F.col("calls") > quota)


def split_identity(records: DataFrame) -> DataFrame:
    """Entities with exactly two identifiers: which one moves away (fewer records, then fewer filings, then the identifier that is less as text)."""
    groups = records.groupBy("entity_id", "identifier").agg(F.count("*").alias("records"), F.count_distinct("filing_id").alias("filings"))
    both = groups.groupBy("entity_id").agg(F.count("*").alias("identifiers"), F.min_by(F.struct("identifier", "records", "filings"), F.struct("records", "filings", "identifier")).alias("m"))
    return both.where("identifiers = 2").select("entity_id", F.col("m.identifier").alias("moves"), F.col("m.records").alias("records"), F.col("m.filings").alias("filings"))


def single_identifier(records: DataFrame) -> DataFrame:
    """Entities by whether their records agree on one identifier; ambiguous ones keep none."""
    out = records.groupBy("entity_id").agg(F.count_distinct("identifier").alias("n"), F.min("identifier").alias("identifier"))
    return out.select("entity_id", F.when(F.col("n") == 1, F.col("identifier")).alias("identifier"), (F.col("n") > 1).alias("ambiguous"))


def usage_windows(events: DataFrame, length: str) -> DataFrame:
    """Calls per user in tumbling windows; works on batches and, behind a watermark, on streams."""
    return events.groupBy("user_id", F.window("at", length).alias("w")).agg(F.count("*").alias("calls")).select("user_id", F.col("w.start").alias("start"), "calls")


def last_healthy(passes: DataFrame) -> DataFrame:
    """Baseline before each pass: the count of the last healthy pass of the same source that has one; sources of any length."""
    return segments.carried(passes, "source", ["pass"], {"baseline": (F.col("count"), F.col("healthy") & F.col("count").isNotNull())})


@dataclass(frozen=True)
class Contract:
    """What the details of one record type of one regime must look like."""

    required: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)  #: JSON type of a key's value: string, number, boolean, array, object
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


def contract(details: Column, rule: Contract) -> Column:
    """The first breach of a contract (not_an_object, then missing, unknown, type, enum or range with the key), or ok."""
    keys = F.json_object_keys(details)
    missing = F.array_except(F.array(*map(F.lit, rule.required)), keys)
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, rule.allowed))))
    out = F.when(keys.isNull(), "not_an_object").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.get(missing, 0))).when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.get(unknown, 0)))
    there = lambda key: F.array_contains(keys, key)
    value = lambda key: F.get_json_object(details, f"$.{key}")
    names = {"string": "STRING", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
    for key, kind in rule.types.items():
        found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(details), f"$.{key}", "variant"))
        out = out.when(there(key) & ~F.coalesce(found.rlike(f"^({names[kind]})$"), F.lit(False)), f"type:{key}")
    for key, values in rule.enums.items():
        out = out.when(there(key) & ~F.coalesce(value(key).isin(*values), F.lit(False)), f"enum:{key}")
    for key, (low, high) in rule.ranges.items():
        out = out.when(there(key) & ~F.coalesce(value(key).try_cast("double").between(low, high), F.lit(False)), f"range:{key}")
    return out.otherwise("ok")


def registered_contract(rules: dict[tuple[str, str], Contract], regime: Column, record_type: Column, details: Column) -> Column:
    """contract() by (regime, record type); a pair without a contract is a breach."""
    out = F.lit("unregistered")
    for (code, kind), rule in rules.items():
        out = F.when((regime == code) & (record_type == kind), contract(details, rule)).otherwise(out)
    return out


def drift_state(passes: DataFrame) -> DataFrame:
    """Per source after all passes: the drift of its last pass since the last healthy one, how often and since when drift was seen, and whether any of it stops publication; a healthy pass clears all."""
    healthy = passes.where("kind = 'none'").groupBy("source").agg(F.max("pass").alias("recovered"))
    open_ = passes.where("kind <> 'none'").join(healthy, "source", "left").where("recovered IS NULL OR pass > recovered")
    return open_.groupBy("source").agg(F.max_by("kind", "pass").alias("kind"), F.count("*").alias("detections"), F.min("pass").alias("since"), F.bool_or(F.col("kind").isin(*FREEZING)).alias("frozen"))


def zero_rows(documents: DataFrame, policy: DataFrame) -> DataFrame:
    """accept or reject per document without rows, by its regime's policy; regimes without one reject."""
    out = documents.join(policy, "regime_id", "left")
    return out.withColumn("outcome", F.when((F.col("rows") > 0) | F.coalesce("zero_is_correct", F.lit(False)), "accept").otherwise("reject"))


def coverage(present: DataFrame, targets: DataFrame) -> DataFrame:
    """Per regime the share of its declared target years (first_year to last_year) that it has data for."""
    have = present.select("regime_id", "year").distinct()
    spread = targets.select("regime_id", F.explode(F.sequence("first_year", "last_year")).alias("year"))
    hit = spread.join(have.withColumn("hit", F.lit(1)), ["regime_id", "year"], "left")
    return hit.groupBy("regime_id").agg(F.count("*").alias("target_years"), F.count("hit").alias("done_years")).withColumn("complete", F.col("target_years") == F.col("done_years"))
