"""Supersession chains by jumps of doubled length, and differences between sets of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import RecordFilter
from .staging import stored


def jumps(records: DataFrame) -> list[tuple[int, DataFrame]]:
    """(steps, table of id and to) for 1, 2, 4, ... steps up a chain, as long as any record has so many above it.

    Two narrow columns a table, and as many tables as the logarithm of the longest chain.  A record that supersedes
    itself through others is refused: its chain has no end.
    """
    records = stored(records.select("id", "supersedes_record_id"), "links")
    ids = records.select(F.col("id").alias("to"))
    step = records.where("supersedes_record_id IS NOT NULL").select("id", F.col("supersedes_record_id").alias("to")).join(ids, "to", "left_semi").select("id", "to")
    out, steps = [], 1
    jump = stored(step, "jump")
    links = jump.count()
    while not jump.isEmpty():
        if steps > links:
            raise ValueError(f"a chain of records ends in a cycle: {jump.agg(F.min('id')).collect()[0][0]}")
        out.append((steps, jump))
        further = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        jump, steps = stored(further, "jump"), steps * 2
    return out


def _walk(records: DataFrame, starts: DataFrame, here: str, there: str) -> DataFrame:
    """(start_id, id, depth): members up to 2^k away are known after k joins; each adds those as far again."""
    known = [stored(starts.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("depth")), "starts")]
    for steps, jump in jumps(records):
        jump = jump.select(F.col(here).alias("at"), F.col(there).alias("next"))
        so_far = reduce(DataFrame.unionByName, known)
        more = so_far.join(jump, so_far["id"] == jump["at"]).select("start_id", F.col("next").alias("id"), (F.col("depth") + steps).alias("depth"))
        known.append(stored(more, "chain"))
    return reduce(DataFrame.unionByName, known)


def chain_up(records: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, id, depth) of every record that the starts supersede, directly or through others, themselves at depth 0."""
    return _walk(records, starts, "id", "to")


def chain_down(records: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, id, depth) of every record that supersedes a start, directly or through others; branches are followed."""
    return _walk(records, starts, "to", "id")


def visible(chain: DataFrame, records: DataFrame, reader: RecordFilter) -> DataFrame:
    """The other members of each chain that the reader may see; the walk itself goes on through hidden ones."""
    return chain.where("depth > 0").join(reader.apply(records).select("id"), "id", "left_semi").select("start_id", "id", "depth")


def missing_years(present: DataFrame, by: str, year: str, first: int, last: int) -> DataFrame:
    """Per group, the years of the target range it has nothing for."""
    have = present.groupBy(by).agg(F.collect_set(year).alias("have"))
    target = F.sequence(F.lit(first), F.lit(last))
    return have.select(by, F.explode(F.array_except(target, "have")).alias("missing_year"))


def new_keys(candidates: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    return candidates.join(baseline.select(key).distinct(), key, "left_anti")
