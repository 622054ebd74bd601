"""Join shapes that are more than one call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_chain(key: str, *frames: DataFrame) -> DataFrame:
    """Full outer joins on one key; a key missing on one side still meets the frames that follow."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def expand_years(rows: DataFrame, start: str, end: Column, year: str = "year") -> DataFrame:
    """One row per year from start to end; none where the end lies before the start (a sequence would count down)."""
    return rows.where(F.col(start) <= end).withColumn(year, F.explode(F.sequence(F.col(start), end)))


def worst(rows: DataFrame, by: str, rank: list[Column], take: list[str]) -> DataFrame:
    """Per group, the columns ``take`` of the row that ranks first, and the number of rows; no window, one partial aggregate."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min_by(F.struct(*take), F.struct(*rank)).alias("w")).select(by, "n", *[F.col(f"w.{c}").alias(f"worst_{c}") for c in take])


def nest(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], fields: list[str], name: str = "items") -> DataFrame:
    """Children as one sorted array per parent, empty for parents without any."""
    packed = children.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))
    return parents.join(packed, on, "left").withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS {dict(packed.dtypes)[name]})")))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str, take: list[str]) -> DataFrame:
    """Left outer join that takes, of several matches, the one first in ``order``."""
    one = right.groupBy(*on).agg(F.min_by(F.struct(*take), F.col(order)).alias("m"))
    return left.join(one, on, "left").select(*left.columns, *[F.col(f"m.{c}").alias(c) for c in take])


def rollup_by(key: str, spine: DataFrame, *counts: DataFrame) -> DataFrame:
    """Every key of the spine with all counts, zero where a count has no row for it."""
    out = reduce(lambda a, b: a.join(b, key, "left"), counts, spine)
    return out.fillna(0, [c for f in counts for c in f.columns if c != key])


def routed(targets: DataFrame, routes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Polymorphic targets: each kind joins its own relation; the arms are put together as (id, regime_id)."""
    arms = [targets.where(F.col("target_kind") == kind).join(rel.select(F.col(key).alias("target_id"), "regime_id"), "target_id").select("id", "regime_id") for kind, (rel, key) in routes.items()]
    return reduce(DataFrame.unionByName, arms)


#: rows of a rule index that may be broadcast (some 100 bytes each); larger ones are joined by a shuffle on spread keys
INDEX_ROWS = 200_000
FEW_RULES = 256  # so few are checked one by one against each record of their type: that costs less than looking slots up
SALTS = 16
MONTHS = 36


def _bits(cents: Column) -> Column:
    """Buckets of amounts by their length in bits; all below 1 are bucket 0."""
    return F.when(cents < 1, 0).otherwise(F.length(F.bin(cents))).cast("int")


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def rule_index(rules: DataFrame, record_types: tuple[str, ...]) -> DataFrame:
    """Rules with ``arm`` and ``slot``: each under the clause that leaves it fewest records, one row for each slot it covers.

    Arms: months (of a closed span of dates of up to ``MONTHS``), value (length in bits of the amounts), class, state, and
    any for a rule without such a clause.  A rule without a record type stands for one of each.
    """
    kinds = F.when(F.col("record_type").isNull(), F.array(*map(F.lit, record_types))).otherwise(F.array("record_type"))
    first, last = _month(F.col("event_from")), _month(F.col("event_to"))
    short = F.col("event_from").isNotNull() & F.col("event_to").isNotNull() & (last - first < MONTHS)
    # a least amount above the most asks for wide records, which no slot says
    valued = F.coalesce(F.col("min_cents") <= F.col("max_cents"), F.col("min_cents").isNotNull() | F.col("max_cents").isNotNull())
    arm = F.when(short, "months").when(valued, "value").when(F.col("asset_class").isNotNull(), "class").when(F.col("verification_state").isNotNull(), "state").otherwise("any")
    span = lambda a, b: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda x: x.cast("string"))
    bits = span(F.coalesce(_bits(F.col("min_cents")), F.lit(0)), F.coalesce(_bits(F.col("max_cents")), F.lit(63)))
    slots = F.when(arm == "months", span(first, last)).when(arm == "value", bits).when(arm == "class", F.array("asset_class")).when(arm == "state", F.array("verification_state")).otherwise(F.array(F.lit("")))
    return rules.withColumn("kind", F.explode(kinds)).withColumn("arm", arm).withColumn("slot", F.explode(slots))


def match_rules(records: DataFrame, rules: DataFrame, record_types: tuple[str, ...], index_rows: int = INDEX_ROWS, few_rules: int = FEW_RULES) -> DataFrame:
    """(rule_id, record_id, channels) of every rule a record satisfies; unset rule columns match everything.

    Records look rules up by slot and check the clauses of those few.  The index is counted: a small one is broadcast, so
    records do not move; a large one meets them by (kind, arm, slot) and a salt, so no slot is one task.
    """
    r = lambda c: F.col(f"r.{c}")
    c = lambda c: F.col(f"e.{c}")
    low, high = _bits(F.col("low_cents")), F.coalesce(_bits(F.col("high_cents")), F.lit(63))
    bits = F.when(F.col("low_cents").isNotNull() & (low <= high), F.transform(F.sequence(low, high), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    entry = lambda arm, slots: F.transform(slots, lambda s: F.struct(F.lit(arm).alias("arm"), s.alias("slot")))
    index = rule_index(rules, record_types)
    if len(rules.select("rule_id").limit(few_rules + 1).collect()) <= few_rules:
        index = index.withColumns({"arm": F.lit("any"), "slot": F.lit("")}).dropDuplicates(["rule_id", "kind"])
    arms = {row["arm"]: row["count"] for row in index.groupBy("arm").count().collect()}  # five at most
    slots = {"months": F.array(_month(F.col("event_date")).cast("string")), "value": bits, "class": F.array("asset_class"), "state": F.array("verification_state"), "any": F.array(F.lit(""))}
    looked = F.explode(F.concat(*[entry(a, slots[a]) for a in slots if a in arms] or [F.array().cast("array<struct<arm:string,slot:string>>")]))
    if set(arms) <= {"any"}:
        looked = F.struct(F.lit("any").alias("arm"), F.lit("").alias("slot"))
    records = records.withColumn("at", looked).withColumn("low_bits", low)
    keys = [r("kind") == c("record_type"), r("arm") == c("at.arm"), r("slot") == c("at.slot")]
    if sum(arms.values()) <= index_rows:
        index = F.broadcast(index)
    else:
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        records = records.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        keys.append(r("salt") == c("salt"))
    on = [
        *keys,
        # two ranges of bits that overlap have many slots in common; the pair counts at the first of them
        (r("arm") != "value") | (r("slot") == F.greatest(c("low_bits"), F.coalesce(_bits(r("min_cents")), F.lit(0))).cast("string")),
        *[r(k).isNull() | (r(k) == c(k)) for k in ("asset_class", "verification_state")],
        r("min_cents").isNull() | (c("low_cents").isNotNull() & (c("high_cents").isNull() | (c("high_cents") >= r("min_cents")))),
        r("max_cents").isNull() | (c("low_cents").isNotNull() & (c("low_cents") <= r("max_cents"))),
        r("event_from").isNull() | (c("event_date") >= r("event_from")),
        r("event_to").isNull() | (c("event_date") <= r("event_to")),
    ]
    joined = records.alias("e").join(index.alias("r"), reduce(lambda a, b: a & b, on))
    return joined.select(r("rule_id").alias("rule_id"), c("id").alias("record_id"), r("channels").alias("channels"))
