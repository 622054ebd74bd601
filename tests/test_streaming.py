"""Streams give what their batch functions give, and a second run adds nothing."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from statera.operators import trust
from statera.streaming import dispatch

DAY = dt.datetime(2024, 1, 1)


def test_dispatch_is_exactly_once(spark, tmp_path):
    src, sink = f"{tmp_path}/outbox", f"file://{tmp_path}/deliveries"
    events = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "n int, id string")
    events.repartition(3).write.parquet(src)

    def match(batch):
        return batch.select((F.col("n") % 2).alias("rule_id"), F.col("id").alias("record_id"), F.array(F.lit("email"), F.lit("digest")).alias("channels"))

    for run in range(2):  # the second run has lost its offsets and reads everything again
        q = dispatch.dispatch(dispatch.outbox(spark, src, events.schema, 1), match, sink, f"{tmp_path}/checkpoint{run}").start()
        q.awaitTermination(120)
        keys = [r.dedup_key for r in spark.read.parquet(sink).collect()]
        assert len(keys) == len(set(keys)) == 12


def test_windows_equal_batch(spark, tmp_path):
    rows = [(k % 3, DAY + dt.timedelta(minutes=7 * k)) for k in range(40)] + [(9, DAY + dt.timedelta(days=3))]
    events = spark.createDataFrame(rows, "user_id int, at timestamp")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = dispatch.windowed(stream, "at", "user_id", "1 hour", "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    late = dt.datetime(2024, 1, 3)
    batch = {tuple(r) for r in trust.usage_windows(events, "1 hour").collect() if r.start < late}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.start < late} == batch


def test_watch_equals_batch(spark, tmp_path):
    rows = [(f"s{k % 2}", k, k % 3 != 0, 10 * k) for k in range(12)]
    passes = spark.createDataFrame(rows, "source string, pass long, healthy boolean, count_seen long")
    passes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(passes.schema).parquet(f"{tmp_path}/in")
    q = dispatch.watch(stream).writeStream.format("memory").queryName("watch").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {(r.source, r["pass"]): r.baseline for r in spark.sql("SELECT * FROM watch").collect()}
    batch = trust.last_healthy(passes.withColumnRenamed("count_seen", "count"))
    assert found == {(r.source, r["pass"]): r.baseline for r in batch.collect()}


def watched(n):
    import random

    r = random.Random(n)
    return [
        (f"s{k % 3}", k, r.choice([200, 200, 200, 200, 304, 500, None]), r.random() > 0.1, r.choice([0, 5, 5 + k // 20, 4]), r.choice(["a", "a", "a", "a", "b"]))
        for k in range(n)
    ]


PASS = "source string, pass long, status int, markers boolean, entries long, layout string"


def test_drift_reports_equal_a_plain_loop(spark):
    from statera.operators import drift

    want, base, held = [], {}, {}
    for source, number, status, markers, entries, layout in watched(400):
        b = base.get(source)
        if status is None:
            kind, mark = "probe_error", "transport"
        elif status == 304:
            kind = "none"
        elif status == 500:
            kind, mark = "status_error", "500"
        elif not markers:
            kind, mark = "regime_change", "markers"
        elif b and entries == 0 < b[1]:
            kind, mark = "count_zero", "zero"
        elif b and layout != b[0]:
            kind, mark = "layout_shift", layout
        elif b and entries < b[1]:
            kind, mark = "count_delta", "shrink"
        else:
            kind = "none"
        if kind == "none":
            if status == 200:
                base[source] = (layout, entries)
            for key in [k for k in held if k[0] == source and trust.DRIFT_SCORES[k[1]] >= 80]:
                want.append((*held.pop(key), number))
        else:
            opened, seen, _, _ = held.get((source, kind, mark), (number, 0, None, None))
            held[source, kind, mark] = (opened, seen + 1, f"{source}:{kind}:{mark}", number)
    want += [(*r, None) for r in held.values()]
    for ranges in (None, 9):
        frame = spark.createDataFrame(watched(400), PASS).repartition(ranges or 2)
        found = drift.reports(frame).collect()
        assert sorted((r.opened, r.detections, r.dedup_key, str(r.resolved)) for r in found) == sorted((o, n, k, str(x)) for o, n, k, _, x in want)
        assert all(r.freeze == (r.score >= 80) and r.last_pass == (r.resolved or r.last_pass) for r in found)
    assert any(x is not None for *_, x in want) and len(want) > 30


def test_drift_stream_equals_batch(spark, tmp_path):
    from statera.operators import drift
    from statera.streaming import watch

    rows = watched(240)
    for part in range(4):
        spark.createDataFrame(rows[60 * part : 60 * part + 60], PASS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{part}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        last = {}
        for part in range(4):  # each run goes on from the state of the one before
            shutil.copytree(f"{tmp_path}/in/p{part}", f"{tmp_path}/seen", dirs_exist_ok=True)
            stream = spark.readStream.schema(PASS).parquet(f"{tmp_path}/seen")

            def keep(batch, number):
                for r in batch.collect():
                    last[r.source, r.dedup_key, r.opened] = tuple(r)

            q = watch.drift_reports(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = drift.reports(spark.createDataFrame(rows, PASS)).collect()
    assert {tuple(map(str, r)) for r in last.values()} == {tuple(map(str, r)) for r in batch}


def test_queue_equals_batch_over_replays_and_late_files(spark, tmp_path):
    import random

    from statera.streaming import queue

    r = random.Random(6)
    events = []
    for k in range(40):
        for n in range(1, 7):
            outcome = r.choice(["retryable", "retryable", "retryable", "sent", "terminal"])
            events.append((f"k{k}", n, outcome, DAY + dt.timedelta(seconds=100 * k + n)))
            if outcome != "retryable" or r.random() < 0.1:
                break
    events += [("gap", 2, "sent", DAY), ("late", 1, "retryable", DAY), ("late", 1, "terminal", DAY + dt.timedelta(seconds=9))]
    ddl = "dedup_key string, attempt int, outcome string, at timestamp"
    r.shuffle(events)
    parts = [events[k::3] for k in range(3)]
    parts[2] += parts[0][:20]  # replayed
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    last = {}

    def keep(batch, _):
        for row in batch.collect():
            last[row.dedup_key] = (row.status, row.attempts, row.wait_ms, row.due)

    sink = f"file://{tmp_path}/sink"
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
            queue.settled(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
            if k == 2:  # from the start, twice: the second run has lost its state
                for again in range(2):
                    queue.run(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/again{again}").start().awaitTermination(60)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = {row.dedup_key: (row.status, row.attempts, row.wait_ms, row.due) for row in queue.states(spark.createDataFrame(events, ddl)).collect()}
    assert last == batch and {s for s, *_ in batch.values()} == {"sent", "dead", "pending"}
    assert batch["gap"] == ("pending", 0, 0, None) and batch["late"][:3] == ("pending", 1, 500)
    states = queue.states(spark.createDataFrame(events, ddl))
    assert {x.dedup_key for x in queue.claimable(states, F.lit(DAY + dt.timedelta(seconds=2000)).cast("timestamp")).collect()} == {k for k, (s, n, _, at) in batch.items() if s == "pending" and (at is None or at <= DAY + dt.timedelta(seconds=2000))}
    written = [tuple(x) for x in spark.read.parquet(sink).collect()]
    assert sorted(written) == sorted((k, s, n) for k, (s, n, *_) in batch.items() if s != "pending")
    kept = queue.unsettled(spark.createDataFrame(events, ddl), spark.read.parquet(sink))
    assert {x.dedup_key for x in kept.collect()} == {k for k, (s, *_) in batch.items() if s == "pending"}
