"""Next times against a walk over all minutes, leap days included."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import schedules

LOW, HIGH = [0, 0, 1, 1, 0], [59, 23, 31, 12, 7]


def plain(cron):
    """The five sets by plain Python, or None."""
    fields = cron.lower().split()
    if len(fields) != 5:
        return None
    out = []
    for i, f in enumerate(fields):
        names = {3: "jan feb mar apr may jun jul aug sep oct nov dec".split(), 4: "sun mon tue wed thu fri sat".split()}.get(i, [])
        for n, w in enumerate(names):
            f = f.replace(w, str(n + (i == 3)))
        got = set()
        for p in f.split(","):
            span, _, step = p.partition("/")
            a, _, b = span.partition("-")
            try:
                lo, hi = (LOW[i], 6 if i == 4 else HIGH[i]) if a == "*" else (int(a), int(b) if b else (6 if i == 4 else HIGH[i]) if step else int(a))
                by = int(step) if step or "/" in p else 1
            except ValueError:
                return None
            if (a == "*" and b) or not LOW[i] <= lo <= hi <= HIGH[i] or by < 1:
                return None
            got |= {v % 7 if i == 4 else v for v in range(lo, hi + 1, by)}
        out.append(got)
    return [*out, fields[2] == "*", fields[4] == "*"]


def walk(cron, base, years=9):
    s = plain(cron)
    if s is None:
        return None
    t = base.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    end = base + dt.timedelta(days=366 * years)
    while t < end:
        dom, dow = t.day in s[2], (t.isoweekday() % 7) in s[4]
        if not (t.month in s[3] and (dow if s[5] else dom if s[6] else dom or dow)):
            t = t.replace(hour=0, minute=0) + dt.timedelta(days=1)
        elif t.hour not in s[1]:
            t = t.replace(minute=0) + dt.timedelta(hours=1)
        elif t.minute not in s[0]:
            t += dt.timedelta(minutes=1)
        else:
            return t
    return None


CRONS = ["* * * * *", "*/15 * * * *", "0 3 * * *", "30 2 * * 1-5", "0 0 1 * *", "15 6,18 1-7 * mon", "5 4 29 2 *", "0 0 30 2 *", "59 23 31 12 *", "0 12 * jan-mar,DEC sun", "7-20/5 */6 * * 5-7", "0 0 13 * fri", "10/20 1 * * *", "0 0 29 feb mon", "0 9 * * 0,7"]
BAD = ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "5-3 * * * *", "*/0 * * * *", "a * * * *", "*-5 * * * *", "1,,2 * * * *", "* * * * * *", "-1 * * * *", "99999999999 * * * *"]


def test_next_times_equal_a_walk(spark):
    rng = random.Random(3)
    bases = [dt.datetime(2023, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29, 4, 5), dt.datetime(2096, 2, 29, 5, 0), dt.datetime(2024, 2, 28, 12, 0, 1)]
    bases += [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(5 * 365 * 86_400)) for _ in range(25)]
    rows = [(c, b) for c in CRONS + BAD for b in bases] + [(None, bases[0]), ("* * * * *", None)]
    df = spark.createDataFrame(rows, "cron string, base timestamp_ntz")
    got = df.select("cron", "base", schedules.next_time(schedules.parsed(F.col("cron")), F.col("base")).alias("t")).collect()
    for r in got:
        want = walk(r["cron"], r["base"]) if r["cron"] is not None and r["base"] is not None else None
        assert r["t"] == want, (r["cron"], r["base"])
    assert walk("5 4 29 2 *", bases[2]) == dt.datetime(2104, 2, 29, 4, 5)


@pytest.mark.parametrize("cron", BAD)
def test_bad_expressions_are_named(spark, cron):
    assert plain(cron) is None
    assert spark.createDataFrame([(cron,)], "c string").select(schedules.parsed(F.col("c")).isNull()).first()[0]


def test_triggers_are_anchored_before_they_fire(spark):
    now = dt.datetime(2024, 5, 1, 12, 0)
    rows = [(1, "0 3 * * *", None), (2, "0 3 * * *", dt.datetime(2024, 4, 30, 12, 0)), (3, "0 13 * * *", dt.datetime(2024, 4, 30, 14, 0)), (4, "nonsense", now), (5, None, dt.datetime(2024, 4, 1)), (6, "0 12 * * *", dt.datetime(2024, 5, 1, 11, 59, 59))]
    df = spark.createDataFrame(rows, "trigger_id int, cron_expr string, last_fired_at timestamp_ntz")
    ask = lambda default: {r["trigger_id"]: (r["state"], r["last_fired_at"]) for r in schedules.evaluate(df, F.lit(now).cast("timestamp_ntz"), default).collect()}
    got = ask(None)
    assert got == {1: ("anchored", now), 2: ("due", now), 3: ("not_due", rows[2][2]), 4: ("invalid", now), 5: ("skipped", rows[4][2]), 6: ("due", now)}
    assert ask("*/5 * * * *")[5] == ("due", now)
