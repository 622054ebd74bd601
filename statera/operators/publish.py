"""Publication of candidates as one plan: gate, redaction, checks, fingerprint, insertion, events, reviews, counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import trust
from .staging import stored

# Keys of details that are not published, by regime; prefixes of a key's value that keep a record back,
# and the reason noted for it; keys that a fingerprint leaves out.
HIDDEN_KEYS = {"fr_hatvp_dia": ("declarant_address", "declarant_private"), "us_senate": ("counsel_name", "signature_image")}
KEPT_BACK = {"fr_hatvp_dia": ("type_declaration", ("dsp",), "redaction_fr_patrimony_unrepublishable")}
NOT_HASHED = {"br": ("last_updated_date_raw", "last_updated_time_raw")}


def _by_regime(rules: dict, then, otherwise: Column, regime: str = "regime_code") -> Column:
    out = otherwise
    for code, rule in rules.items():
        out = F.when(F.col(regime) == code, then(rule)).otherwise(out)
    return out


def kept_back() -> Column:
    """The reason why a candidate must not be published at all, or null."""

    def reason(rule):
        key, prefixes, text = rule
        value = F.lower(F.col("details")[key])
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | F.coalesce(F.startswith(value, F.lit(prefix)), F.lit(False))
        return F.when(hit, text)

    return _by_regime(KEPT_BACK, reason, F.lit(None).cast("string"))


def public_details() -> Column:
    return _by_regime(HIDDEN_KEYS, lambda keys: S.without_keys(F.col("details"), *keys), F.col("details"))


def content(columns: list[str], details: str = "details") -> Column:
    """Canonical JSON of a candidate, without the keys that its regime changes without meaning anything."""
    hashed = _by_regime(NOT_HASHED, lambda keys: S.without_keys(F.col(details), *keys), F.col(details))
    return S.canonical_json(F.to_json(F.struct(*columns, hashed.alias("details")), {"ignoreNullFields": "false"}))


def correction_fingerprint(record_id: Column, body: Column) -> Column:
    """Fingerprints of corrections have a scope of their own, so they never meet those of filings."""
    return S.fingerprint(F.concat(F.lit("correction:"), record_id), F.lit(0), body)


@dataclass
class Published:
    outcome: DataFrame  #: filing_id, ordinal, outcome: frozen, suppressed, filing_rejected, replay or inserted
    records: DataFrame  #: candidates to append, with fingerprint and public details
    events: DataFrame  #: one per inserted record; ``suppressed`` where the filing is a backfill, so nothing is sent
    reviews: DataFrame  #: target_kind, target_id, reason
    counters: DataFrame = field(repr=False)  #: per filing


def publish(candidates: DataFrame, columns: list[str], frozen: DataFrame, known: DataFrame, checks: list[tuple[Column, str]], reviews: list[tuple[Column, str]], keep: bool = True) -> Published:
    """What publishing these candidates would write; nothing is written here.  ``keep`` stores the plan, as more than one output is read.

    ``candidates``: filing_id, ordinal, regime_code, backfill, details (map) and ``columns``, the content of a record.
    ``frozen``: regime_code.  ``known``: fingerprints that are published; a candidate whose fingerprint is known is a
    replay.  A candidate that fails a check rejects its whole filing; one without a filing is left out.  Fingerprints are made after redaction, from the
    filing, the candidate's place in it, and its content.
    """
    stopped = F.broadcast(frozen.select("regime_code").distinct().withColumn("frozen", F.lit(True)))  # a regime is one of a closed list
    c = candidates.where("filing_id IS NOT NULL").join(stopped, "regime_code", "left")
    c = c.withColumn("suppress", kept_back()).withColumn("details", public_details())
    c = c.withColumn("breach", F.when(F.col("suppress").isNull(), F.nullif(trust.verdict(checks), F.lit("ok"))))
    # filings with a breach alone; candidates meet them before they have a fingerprint to carry along
    bad = c.where("breach IS NOT NULL").select("filing_id").distinct().withColumn("rejected", F.lit(True))
    c = c.join(bad, "filing_id", "left")
    c = c.withColumn("decided", F.when(F.col("frozen"), "frozen").when(F.col("rejected"), "filing_rejected").when(F.col("suppress").isNotNull(), "suppressed"))
    c = c.withColumn("fingerprint", S.fingerprint(F.col("filing_id"), F.col("ordinal"), content(columns)))
    c = c.join(known.select("fingerprint").distinct().withColumn("known", F.lit(True)), "fingerprint", "left")
    c = c.withColumn("outcome", F.coalesce("decided", F.when(F.col("known"), "replay").otherwise("inserted")))
    if keep:
        c = stored(c, "published")
    inserted = c.where("decided IS NULL AND known IS NULL")
    noted = inserted.select(F.lit("disclosure_record").alias("target_kind"), F.col("fingerprint").alias("target_id"), F.explode(trust.review_reasons(reviews)).alias("reason"))
    held = c.where("outcome = 'suppressed'").select(F.lit("filing").alias("target_kind"), F.col("filing_id").alias("target_id"), F.col("suppress").alias("reason"))
    blocked = c.where("outcome = 'frozen'").select(F.lit("regime").alias("target_kind"), F.col("regime_code").alias("target_id"), F.lit("publish_blocked_frozen").alias("reason")).distinct()
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    n_reviews = F.sum(F.when(F.col("outcome") == "inserted", F.size(trust.review_reasons(reviews))).when(F.col("outcome") == "suppressed", 1).otherwise(0))
    counters = c.groupBy("filing_id").agg(F.count("*").alias("candidates"), is_("inserted").alias("gold_inserted"), is_("inserted").alias("outbox_written"), n_reviews.cast("long").alias("review_tasks"), is_("suppressed").alias("suppressed"), is_("replay").alias("replayed"))
    return Published(
        c.select("filing_id", "ordinal", "outcome"),
        inserted.select("filing_id", "ordinal", "regime_code", *columns, "details", "fingerprint"),
        inserted.select("fingerprint", "filing_id", F.col("backfill").alias("suppressed")),
        noted.unionByName(held).unionByName(blocked),
        counters,
    )
