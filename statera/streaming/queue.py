"""Deliveries as a queue: attempts in keyed state, back-off, dead letters, replays that change nothing.

Events are outcomes of numbered attempts: (dedup_key, attempt, outcome, at).  What a delivery's state is follows from the
set of its attempts alone, not from the order or number of their arrivals, so replayed and late files end in the same
state, and the batch function gives it too.  The earliest outcome of an attempt counts (ties: the least outcome).

When a delivery is due again is a column of its state and :func:`claimable` asks for it; timers would say the same, but
a query with processing-time timers never runs out of batches, and event-time ones drop what comes late.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.idempotent import insert_if_absent

# Fixed values of the domain: attempts before a delivery is given up, and the wait before its first repetition.
MAX_ATTEMPTS, BASE_MS = 5, 500
STATE = "dedup_key string, status string, attempts int, wait_ms long, due timestamp"
COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]


def unsettled(events: DataFrame, settled: DataFrame) -> DataFrame:
    """Events of deliveries that no earlier run has settled; what a run's state has forgotten is kept out here."""
    return events.join(settled.select("dedup_key").distinct(), "dedup_key", "left_anti")


def states(events: DataFrame, max_attempts: int = MAX_ATTEMPTS, base_ms: int = BASE_MS) -> DataFrame:
    """dedup_key, status (sent, dead or pending), attempts, wait_ms and due, after all events; one partial aggregate a delivery."""
    of = lambda n: F.min(F.when(F.col("attempt") == n, F.struct("at", "outcome")))
    rows = events.groupBy("dedup_key").agg(*[of(n).alias(f"a{n}") for n in range(1, max_attempts + 1)])
    result = None
    for n in range(max_attempts, 0, -1):
        outcome = F.col(f"a{n}.outcome")
        last = n == max_attempts
        pending = _row("pending", n, F.lit(base_ms * 2 ** (n - 1)).cast("long"), F.col(f"a{n}.at"))
        further = _row("dead", n) if last else F.when(F.col(f"a{n + 1}").isNull(), pending).otherwise(result)
        result = F.when(outcome == "sent", _row("sent", n)).when(outcome == "terminal", _row("dead", n)).when(outcome == "retryable", further)
    first = F.coalesce(result, _row("pending", 0, F.lit(0).cast("long")))
    return rows.select("dedup_key", first.alias("s")).select("dedup_key", "s.*")


def _row(status: str, attempts: int, wait: Column | None = None, at: Column | None = None) -> Column:
    due = F.lit(None).cast("timestamp") if at is None else F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + wait * 1000)
    return F.struct(F.lit(status).alias("status"), F.lit(attempts).alias("attempts"), (F.lit(None).cast("long") if wait is None else wait).alias("wait_ms"), due.alias("due"))


def state_of(attempts: dict[int, tuple[pd.Timestamp, str]], max_attempts: int, base_ms: int) -> tuple:
    """(status, attempts, wait_ms, due) of one delivery from its attempts without a gap."""
    n = 0
    while n + 1 in attempts:
        n += 1
        at, outcome = attempts[n]
        if outcome == "sent":
            return "sent", n, None, None
        if outcome == "terminal" or n >= max_attempts:
            return "dead", n, None, None
    if not n:
        return "pending", 0, 0, None
    wait = base_ms * 2 ** (n - 1)
    return "pending", n, wait, attempts[n][0] + pd.Timedelta(wait, "ms")


class Queue(StatefulProcessor):
    """Attempts of a delivery, at most ``max_attempts`` of them."""

    def __init__(self, max_attempts: int, base_ms: int):
        self.max_attempts, self.base_ms = max_attempts, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "attempt int", "at timestamp, outcome string")

    def handleInputRows(self, key, rows, timerValues):
        held = {k[0]: (pd.Timestamp(v[0]), v[1]) for k, v in self.attempts.iterator()} if self.attempts.exists() else {}
        before = state_of(held, self.max_attempts, self.base_ms)
        for frame in rows:
            for r in frame.itertuples(index=False):
                if 1 <= r.attempt <= self.max_attempts:
                    found = (pd.Timestamp(r.at), r.outcome)
                    held[r.attempt] = min(held.get(r.attempt, found), found)
        for k, (at, outcome) in held.items():
            self.attempts.updateValue((k,), (at.to_pydatetime(), outcome))
        after = state_of(held, self.max_attempts, self.base_ms)
        if after != before or not after[1]:
            out = pd.DataFrame([(key[0], *after)], columns=COLUMNS)
            yield out.astype({"attempts": "int32", "wait_ms": "Int64", "due": "datetime64[us]"})

    def close(self) -> None:
        pass


def claimable(states: DataFrame, now: Column) -> DataFrame:
    """Deliveries whose wait is over, and those that nobody has tried."""
    return states.where((F.col("status") == "pending") & (F.col("due").isNull() | (F.col("due") <= now)))


def settled(events: DataFrame, max_attempts: int = MAX_ATTEMPTS, base_ms: int = BASE_MS) -> DataFrame:
    """Changes of state of a stream of events; a row replaces the earlier one of its delivery.

    State of a delivery is at most ``max_attempts`` entries; a run from a new checkpoint forgets them, and
    :func:`unsettled` keeps replays of what was settled before out of it.  Needs the RocksDB state store.
    """
    return events.groupBy("dedup_key").transformWithStateInPandas(statefulProcessor=Queue(max_attempts, base_ms), outputStructType=STATE, outputMode="Update", timeMode="None")


def run(events: DataFrame, sink: str, checkpoint: str, **options):
    """Append each delivery that is sent or dead to ``sink`` once, whatever is run again."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = batch.where("status <> 'pending'").select("dedup_key", "status", "attempts")
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        target = spark.read.schema(done.schema).parquet(sink) if exists else done.limit(0)
        insert_if_absent(target, done, ["dedup_key"], "attempts").write.mode("append").parquet(sink)

    return settled(events, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
