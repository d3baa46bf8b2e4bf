"""Stateful streams (extensions: the batch forms give the same answers): token buckets and running ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import scratch, ship

BURST = 10
#: Rows of one frame that a bucket gives.
FRAME = 10_000


def refill(tokens: float, last: float | None, now: float, rate: float, capacity: float) -> tuple[float, bool]:
    """Tokens after one request at ``now`` (seconds), and whether it passes."""
    tokens = capacity if last is None else min(capacity, tokens + (now - last) * rate)
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


def _bucket(rate: float, capacity: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A user's events of a batch come in several frames in any order: they are taken in the order of their times all the same, as two numbers each."""
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat([f[["t", "event_id"]] for f in frames]).sort_values(["t", "event_id"])
        for a in range(0, len(rows), FRAME):
            own, ok = rows.iloc[a : a + FRAME], []
            for now in own["t"].tolist():
                tokens, passes = refill(tokens, last, now, rate, capacity)
                last = now
                ok.append(passes)
            yield pd.DataFrame({"event_id": own["event_id"], "user_id": key[0], "allowed": ok})
        state.update((tokens, last))

    return step


def _timed(events: DataFrame) -> DataFrame:
    """Events with their time in seconds, computed alike in stream and batch."""
    return events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def token_bucket(events: DataFrame, rate: float, burst: int = BURST) -> DataFrame:
    """Streaming limiter: one bucket per user, starting full."""
    step = _bucket(rate, rate * burst)
    return _timed(events).groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def _fold(batches: Iterator[pa.RecordBatch], rate: float, capacity: float) -> Iterator[pa.RecordBatch]:
    """Users' events in order of time; what is held between batches is one bucket."""
    user, tokens, last = None, capacity, None
    for batch in batches:
        ok = []
        for u, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if u != user or last is None:
                user, tokens, last = u, capacity, None
            tokens, passes = refill(tokens, last, now, rate, capacity)
            last = now
            ok.append(passes)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ok, pa.bool_())], names=["event_id", "user_id", "allowed"])


def token_bucket_batch(events: DataFrame, rate: float, burst: int = BURST) -> DataFrame:
    """The same in one pass. A user's events are taken in order by one task, as they must be, but never held together."""
    ship(events.sparkSession)
    capacity = float(rate * burst)
    ordered = _timed(events).repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return ordered.mapInArrow(lambda b: _fold(b, rate, capacity), "event_id long, user_id long, allowed boolean")


def ledger(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Cost by window and type, with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("cost"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", F.col("cost").cast("double").alias("cost"), "n")


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, then read what it wrote: files and checkpoints in the shared folder."""
    ship(spark)
    out = scratch(spark, f"stream-{name}-{uuid.uuid4().hex[:6]}")
    rows: list[str] = []

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        rows.append(f"{out}/rows/epoch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not rows:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*rows)
