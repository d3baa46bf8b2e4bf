"""Reaps of silent jobs: the stream over several batches, late rows, a restart, and the batch form against a plain walk."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.session import ship
from quern.streaming import heartbeats
from quern.streaming.heartbeats import Rule

RULE = Rule(timeout=60, forget=600, most=2, slot=20, late=30)
T0 = dt.datetime(2024, 1, 1)
BEAT = "job long, at timestamp, note string"


def walk(beats: list[tuple[int | None, float | None]], rule: Rule) -> set[tuple]:
    """Job by job and beat by beat."""
    times = [t for j, t in beats if j is not None and t is not None]
    if not times:
        return set()
    sure = (max(times) - rule.late) // rule.slot * rule.slot
    out = set()
    for job in {j for j, t in beats if j is not None and t is not None}:
        runs: list[list[float]] = []
        for t in sorted(t for j, t in beats if j == job and t is not None):
            if runs and t - runs[-1][-1] <= rule.timeout:
                runs[-1].append(t)
            else:
                runs.append([t])
        attempt, before = 0, None
        for r in runs:
            attempt = 1 if before is None or r[0] - before > rule.forget else attempt + 1
            before = r[-1]
            if before + rule.timeout < sure:
                out.add((job, r[0], before, len(r), before + rule.timeout, attempt, "failed" if attempt >= rule.most else "requeued"))
    return out


def plain(df) -> list[tuple]:
    at = lambda x: (x - T0).total_seconds()
    return sorted((r.job, at(r.first_beat), at(r.last_beat), r.n_beats, at(r.reaped_at), r.attempt, r.action) for r in df.collect())


def table(spark, beats):
    return spark.createDataFrame([(j, None if t is None else T0 + dt.timedelta(seconds=t), "x") for j, t in beats], BEAT)


def run(spark, folder, checkpoint, out):
    """One start of the stream, a file for each batch; what its progress said."""
    ship(spark)
    stream = heartbeats.reaps(spark.readStream.schema(BEAT).option("maxFilesPerTrigger", 1).parquet(str(folder)), "job", "at", RULE)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def put(spark, folder, i, beats):
    table(spark, beats).coalesce(1).write.mode("append").parquet(str(folder))


def test_intervals_are_joined_whatever_their_order():
    def one(*x):
        return [tuple(v) for v in zip(*(a.tolist() for a in heartbeats.merge(*(np.array(c, np.int64) for c in zip(*x, strict=True)), 10)), strict=True)]

    assert one((5, 6, 1)) == [(5, 6, 1)]
    assert one((30, 40, 2), (0, 5, 1), (15, 20, 3)) == [(0, 40, 6)]
    assert one((31, 40, 2), (0, 5, 1), (15, 20, 3)) == [(0, 20, 4), (31, 40, 2)]
    # One that lies within another, and equal ones.
    assert one((0, 100, 5), (10, 20, 1), (105, 106, 1), (10, 20, 1)) == [(0, 106, 8)]


def test_rules_that_make_no_sense_stop():
    for bad in (dict(slot=0), dict(slot=61), dict(timeout=60, forget=59), dict(late=-1), dict(most=0)):
        with pytest.raises(ValueError):
            Rule(**bad)


class Held:
    """The state and timers of one job, and what was asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


class Mark:
    def __init__(self, seconds):
        self.ms = seconds * 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_what_has_ended_goes_out_with_its_slots():
    """Each call to the state and each frame costs every job: four calls at most where slots arrive, and no timer that is due already."""
    slots = lambda *x: iter([Row(job=4, first=a * 10**6, last=b * 10**6, n=n) for a, b, n in x])
    plain = lambda rows: [(r[0], r[1] // 10**6, r[2] // 10**6, r[3], r[4] // 10**6, *r[5:]) for r in rows]
    held, job = Held(), heartbeats.Reaper(RULE)
    job.init(held)
    got = plain(job.handleInputRows((4,), slots((300, 310, 2), (0, 15, 3), (20, 30, 1), (900, 905, 1)), Mark(930)))
    assert got == [(4, 0, 30, 4, 90, 1, "requeued"), (4, 300, 310, 2, 370, 2, "failed")]
    assert held.calls == ["get", "register", "update"] and held.timers == {965_000}
    held.calls.clear()
    # Slots that join the open interval; its timer moves.
    assert plain(job.handleInputRows((4,), slots((940, 950, 1)), Mark(960))) == []
    assert held.calls == ["get", "delete", "register", "update"] and held.timers == {1_010_000}
    # The timer rings within a slot: nothing is sure yet, and the next is not due.
    assert plain(job.handleExpiredTimer((4,), Mark(1015), None)) == [] and max(held.timers) == 1_015_001
    assert plain(job.handleExpiredTimer((4,), Mark(1040), None)) == [(4, 900, 950, 2, 1010, 3, "failed")] and held.value[4] == 950 * 10**6
    assert plain(job.handleExpiredTimer((4,), Mark(1600), None)) == [] and held.value is None


def test_batch_form_equals_a_walk(spark):
    rnd = random.Random(5)
    beats = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None] + [rnd.randrange(0, 6000) + rnd.choice([0, 0.5])] * 20)) for _ in range(700)]
    # Exactly on the edges: continues at the timeout, starts anew after it, numbers on at `forget`; repeated rows.
    beats += [(9, 0), (9, 60), (9, 60), (9, 120.001), (9, 720.001), (9, 1320.002), (8, 5900)]
    got = plain(heartbeats.reaps_batch(table(spark, beats), "job", "at", RULE))
    assert set(got) == walk(beats, RULE) and len(got) == len(set(got)) > 20
    assert {(r[1], r[5]) for r in got if r[0] == 9} == {(0, 1), (120.001, 2), (720.001, 3), (1320.002, 1)}


def test_tables_without_beats_and_columns_of_like_names(spark):
    assert heartbeats.reaps_batch(spark.createDataFrame([], BEAT), "job", "at", RULE).count() == 0
    assert heartbeats.reaps_batch(table(spark, [(None, 1), (1, None)]), "job", "at", RULE).count() == 0
    odd = table(spark, [(1, 0), (1, 500)]).withColumn("first", F.lit("a")).withColumn("last", F.lit(0)).withColumn("n", F.lit(None)).withColumn("window", F.lit(1))
    assert [r[:4] for r in plain(heartbeats.reaps_batch(odd, "job", "at", RULE))] == [(1, 0, 0, 1)]


def test_stream_of_many_batches_equals_the_batch_form(spark, tmp_path):
    """Rows come out of order by less than the lateness allowed; the stream stops midway and goes on."""
    rnd = random.Random(7)
    beats = sorted(((rnd.choice([1, 1, 2, 3]), rnd.randrange(0, 4000)) for _ in range(260)), key=lambda b: b[1] + rnd.uniform(0, 25))
    beats += [(7, 4000)]
    cuts = [beats[i : i + 66] for i in range(0, len(beats), 66)]
    folder, checkpoint, out = tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out"
    dropped = 0
    for i, c in enumerate(cuts):
        put(spark, folder, i, c)
        if i in (1, len(cuts) - 1):  # two starts, some files each
            dropped += sum(s["numRowsDroppedByWatermark"] for p in run(spark, folder, checkpoint, out) for s in p["stateOperators"])
    got = plain(spark.read.parquet(str(out)))
    assert dropped == 0
    assert set(got) == walk(beats, RULE) and len(got) == len(set(got)) > 5
    assert any(r[5] > 1 for r in got)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out"
    first = [(1, 0), (1, 30), (2, 1000)]
    put(spark, folder, 0, first)
    run(spark, folder, checkpoint, out)
    # The watermark stands at 970: what is older is late, even where it would have joined a reaped interval.
    put(spark, folder, 1, [(1, 50), (2, 990), (2, 2000)])
    progress = run(spark, folder, checkpoint, out)
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1
    assert set(plain(spark.read.parquet(str(out)))) == walk(first + [(2, 990), (2, 2000)], RULE)


def test_an_interval_that_ends_at_the_watermark_itself_is_reaped(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out"
    beats = [[(1, 0), (2, 90)], [(2, 5000)]]  # 60 is the first watermark and the end of job 1
    for i, b in enumerate(beats):
        put(spark, folder, i, b)
        run(spark, folder, checkpoint, out)
    assert set(plain(spark.read.parquet(str(out)))) == walk(sum(beats, []), RULE) and len(walk(sum(beats, []), RULE)) == 2


def test_a_silent_job_leaves_no_state(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "in", tmp_path / "checkpoint", tmp_path / "out"
    put(spark, folder, 0, [(1, 0), (2, 100)])
    put(spark, folder, 1, [(5, 100_000)])
    run(spark, folder, checkpoint, out)
    put(spark, folder, 2, [(5, 100_010)])
    last = run(spark, folder, checkpoint, out)[-1]["stateOperators"]
    assert {r[0] for r in plain(spark.read.parquet(str(out)))} == {1, 2}
    rows = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "held").load(str(checkpoint)) if last else None
    assert rows is not None and {r[0] for r in rows.select("key.job").collect()} <= {5}
