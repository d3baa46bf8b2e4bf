"""Running figures in two levels against plain windows, with a hot key over many ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import control, ordered

ROWS = "event_id long, user string, at long, v long, mark string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]), rng.randrange(500), rng.choice([None, 1, 2, -3]), rng.choice(["x", "y", None])) for i in range(3000)]
    return spark.createDataFrame([*made, (9000, "one", 1, 5, "x"), (9001, "empty", 1, None, None)], ROWS).repartition(3)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 17])
def test_sums_equal_windows(rows, parts):
    w = Window.partitionBy("user").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = ordered.sums(rows, "user", ["at", "event_id"], {"s": F.col("v"), "n": F.lit(1)}, parts)
    want = rows.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    assert told(got.drop("part")) == told(want)
    if parts > 1:
        assert got.where("user = 'hot'").select("part").distinct().count() > 4
        assert got.groupBy("part").count().agg(F.max("count")).first()[0] < 3002 / 5


@pytest.mark.parametrize("parts", [1, 17])
def test_neighbours_equal_windows(rows, parts):
    w = Window.partitionBy("user").orderBy("at", "event_id")
    got = ordered.neighbours(rows, "user", ["at", "event_id"], "mark", parts)
    want = rows.withColumn("before", F.lag("mark").over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    assert told(got) == told(want)


def test_streaks_cross_ranges(spark, monkeypatch):
    real = ordered.ranges
    monkeypatch.setattr(ordered, "ranges", lambda rows, by, order, parts=None: real(rows, by, order, 7))
    hits = [i not in (3, 4, 60, 97) for i in range(100)]
    rows = spark.createDataFrame([(i, "u", i, int(h), None) for i, h in enumerate(hits)] + [(200, "w", 1, 1, None)], ROWS)
    got = {(r["first_row"], r["n"]) for r in control.streaks(rows, "user", ["at", "event_id"], F.col("v") == 1).collect()}
    assert got == {(1, 3), (6, 55), (62, 36)}


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert ordered.sums(none, "user", ["at"], {"s": F.col("v")}).count() == 0 and ordered.neighbours(none, "user", ["at"], "mark").count() == 0
