"""Jobs whose heartbeats stop (an extension: as a stream, with timers of event time; the batch form gives the same rows).

A job's beats make intervals: a beat later than ``timeout`` after the one before starts a new one. An interval is
reaped once its last beat is older than ``timeout`` before the watermark. Reaps of a job are numbered; the number
starts again where a job was silent for longer than ``forget``, and the reap that reaches ``most`` fails the job
where earlier ones put it back into the queue.

Beats are combined by job and time slot before they move, so a job with a third of all beats sends its slots. What is kept
of a job are its open intervals and its last reap: as many as fit between its watermark and its newest beat, whatever the
number of beats. Intervals that the watermark has passed go out with the slots that end them; one timer of a job waits for the first that
it has not passed. When nothing is open and ``forget`` has passed, all of it goes.

Defined cases: beats without a job or a time take no part; equal beats all count; a beat exactly ``timeout`` after the
last one continues it; late rows are dropped by the watermark and counted in the stream's progress (in slots of a batch); a table
without beats has no reaps; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

# Times are microseconds where Python makes the rows, and timestamps in what is returned.
OUT = "job long, first_beat long, last_beat long, n_beats long, reaped_at long, attempt int, action string"
_Reap = Row("job", "first_beat", "last_beat", "n_beats", "reaped_at", "attempt", "action")
_STATE = "first array<long>, last array<long>, n array<long>, attempt int, before long, timer long"


@dataclass(frozen=True)
class Rule:
    """Seconds: silence that ends an interval, silence after which reaps are numbered anew, the slot of combined beats, lateness allowed; and the reap that fails a job."""

    timeout: int = 60
    forget: int = 3600
    most: int = 3
    slot: int = 10
    late: int = 120

    def __post_init__(self) -> None:
        if not 0 < self.slot <= self.timeout <= self.forget or self.late < 0 or self.most < 1:
            raise ValueError("0 < slot <= timeout <= forget, late >= 0 and most >= 1 are needed")


def merge(first: np.ndarray, last: np.ndarray, n: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals joined where one begins no later than ``gap`` after the ones before."""
    if len(first) < 2:
        return first, last, n
    order = np.argsort(first, kind="stable")
    first, last, n = first[order], last[order], n[order]
    starts = np.flatnonzero(np.r_[True, first[1:] - np.maximum.accumulate(last)[:-1] > gap])
    return first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts)


class Reaper(StatefulProcessor):
    """Open intervals of a job, in microseconds, and the timer of the earliest."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _load(self) -> tuple[list[np.ndarray], int, int | None, int | None]:
        held = self.held.get()
        if held is None:
            return [np.empty(0, np.int64)] * 3, 0, None, None
        first, last, n, attempt, before, timer = held
        return [np.asarray(x, np.int64) for x in (first, last, n)], attempt, before, timer

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A job's slots of a batch come in one call, so what the watermark has passed is reaped at once, without a timer."""
        open_, attempt, before, timer = self._load()
        slots = np.array([(r["first"], r["last"], r["n"]) for r in rows], np.int64).reshape(-1, 3).T
        parts = [np.concatenate(x) for x in zip(open_, slots, strict=True)]
        return self._reap(key[0], merge(*parts, self.rule.timeout * 1_000_000), attempt, before, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        open_, attempt, before, _ = self._load()  # the timer that rings goes by itself
        return self._reap(key[0], open_, attempt, before, None, timerValues)

    def _reap(self, job: int, intervals, attempt: int, before: int | None, timer: int | None, timerValues) -> Iterator[Row]:
        """Rows of the intervals that have ended; the rest is stored with a timer for its next end, or the job forgotten when nothing can change any more."""
        first, last, n = intervals
        timeout, forget, slot, mark = self.rule.timeout * 1_000_000, self.rule.forget * 1_000_000, self.rule.slot * 1000, timerValues.getCurrentWatermarkInMs()
        # Slots that end after the watermark are still to come.
        sure = mark // slot * slot * 1000
        ended = int(np.searchsorted(last + timeout, sure, side="left"))
        rows = []
        for a, b, k in zip(first[:ended].tolist(), last[:ended].tolist(), n[:ended].tolist(), strict=True):
            attempt = 1 if before is None or a - before > forget else attempt + 1
            before = b
            rows.append(_Reap(job, a, b, k, b + timeout, attempt, "failed" if attempt >= self.rule.most else "requeued"))
        at = None
        if ended < len(first) or before + forget >= sure:
            # One that is not yet due, so that it does not ring before its slot is whole; what rings at the watermark itself is deleted after its call.
            at = max((int(last[ended]) + timeout if ended < len(first) else before + forget) // 1000, mark + 1)
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is None:
            self.held.clear()
        else:
            if timer != at:
                self.handle.registerTimer(at)
            self.held.update((*(x[ended:].tolist() for x in (first, last, n)), attempt, before, at))
        return iter(rows)

    def close(self) -> None:
        pass


def rocks(spark: SparkSession) -> None:
    """Timers need the state store that Spark keeps in RocksDB; a provider that the user has named stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _slots(beats: DataFrame, job: str, at: str) -> DataFrame:
    return beats.select(F.col(job).cast("long").alias("job"), F.col(at).cast("timestamp").alias("at")).where("job IS NOT NULL AND at IS NOT NULL")


def _sums() -> list[Column]:
    return [F.min(F.unix_micros("at")).alias("first"), F.max(F.unix_micros("at")).alias("last"), F.count(F.lit(1)).alias("n")]


def reaps(beats: DataFrame, job: str, at: str, rule: Rule = Rule()) -> DataFrame:
    """Reaped intervals of a stream of beats, each once, when the watermark has passed them."""
    rocks(beats.sparkSession)
    slots = _slots(beats, job, at).withWatermark("at", f"{rule.late} seconds").groupBy("job", F.window("at", f"{rule.slot} seconds")).agg(*_sums())
    timed = slots.select("job", "first", "last", "n", F.window_time("window").alias("slot_end"))
    # Rows, not pandas: a job has few slots in a batch, and a frame for each job costs far more than its rows.
    made = timed.groupBy("job").transformWithState(Reaper(rule), OUT, "append", "eventTime")
    return made.withColumns({c: F.timestamp_micros(c) for c in ("first_beat", "last_beat", "reaped_at")})


def reaps_batch(beats: DataFrame, job: str, at: str, rule: Rule = Rule()) -> DataFrame:
    """The rows that the stream gives when it has read the same beats, none of them late."""
    rows = _slots(beats, job, at)
    micros = {k: F.lit(getattr(rule, k) * 1_000_000) for k in ("timeout", "forget", "slot", "late")}
    slots = rows.groupBy("job", F.floor(F.unix_micros("at") / micros["slot"]).alias("slot")).agg(*_sums())
    mark = rows.agg(((F.floor(F.max(F.unix_micros("at")) / 1000) * 1000 - micros["late"]) / micros["slot"]).alias("w")).select((F.floor("w") * micros["slot"]).alias("sure"))
    turn = Window.partitionBy("job").orderBy("first")
    new = F.coalesce(F.col("first") - F.lag("last").over(turn) > micros["timeout"], F.lit(True)).cast("int")
    joined = slots.withColumn("new", new).withColumn("i", F.sum("new").over(turn)).groupBy("job", "i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    again = F.coalesce(F.col("first") - F.lag("last").over(turn) > micros["forget"], F.lit(True)).cast("int")
    runs = joined.withColumn("again", again).withColumn("run", F.sum("again").over(turn))
    tried = runs.withColumn("attempt", F.row_number().over(Window.partitionBy("job", "run").orderBy("first")))
    done = tried.join(F.broadcast(mark), F.col("last") + micros["timeout"] < F.col("sure"))  # one row
    when = lambda c: F.timestamp_micros(c)
    return done.select("job", when("first").alias("first_beat"), when("last").alias("last_beat"), F.col("n").alias("n_beats"), when(F.col("last") + micros["timeout"]).alias("reaped_at"), "attempt", F.when(F.col("attempt") >= rule.most, "failed").otherwise("requeued").alias("action"))
