"""Streams: outbox dispatch, exactly-once effects, watch state, tumbling windows.

Every stream takes a checkpoint folder that all executors share and is driven by ``availableNow`` in tests; each has a
batch function of the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import trust
from ..operators.idempotent import insert_if_absent


def outbox(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The append-only outbox as a stream; offsets live in the query's checkpoint, so nothing is stamped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dispatch(events: DataFrame, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Match each micro-batch and append its deliveries, unless a run before wrote them: at least once in, exactly once out."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        made = trust.deliveries(match(batch))
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        target = spark.read.parquet(sink) if exists else made.limit(0)
        insert_if_absent(target, made, ["dedup_key"], "record_id").write.mode("append").parquet(sink)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deduplicated(events: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Repeats of a key within the delay are dropped; older ones are the sink's business."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, at: str, by: str, length: str, delay: str) -> DataFrame:
    """Counts per key in tumbling windows, final once the watermark has passed."""
    out = events.withWatermark(at, delay).groupBy(by, F.window(at, length).alias("w")).agg(F.count("*").alias("calls"))
    return out.select(by, F.col("w.start").alias("start"), "calls")


def watch(passes: DataFrame) -> DataFrame:
    """For each pass of a source, the baseline before it: the count of its last healthy pass.

    State is one number per source.  Passes of a source are taken in their order within a micro-batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("pass")
            out = []
            for row in frame.itertuples(index=False):
                out.append(base)
                if row.healthy:
                    base = int(row.count_seen)
            yield pd.DataFrame({"source": frame["source"], "pass": frame["pass"], "baseline": pd.array(out, dtype="Int64")})
        if base is not None:
            state.update((base,))

    return passes.groupBy("source").applyInPandasWithState(step, "source string, pass long, baseline long", "base long", "append", GroupStateTimeout.NoTimeout)
