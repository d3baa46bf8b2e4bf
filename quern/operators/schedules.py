"""Schedules as columns: cron expressions become sets of minutes, hours, days, months and weekdays, and the next time follows from them.

Five fields, each a list of values, ranges and steps; names of months and weekdays; weekday 7 is 0. Where both days of the
month and weekdays are given, either will do. Everything is native expressions, so any number of schedules is one pass.

Defined cases: the next time lies after the base, whatever its seconds; a field that is none or holds a value outside its range makes the
whole expression invalid; a day that never comes (30 February) has no next time, and neither has a null expression or base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let

#: Least and greatest value of each field, and the names that stand for numbers.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
NAMES = {"month": "jan feb mar apr may jun jul aug sep oct nov dec".split(), "weekday": "sun mon tue wed thu fri sat".split()}
#: Days to look ahead, and those that are looked at first: a leap day can be eight years away.
AHEAD, SOON = 8 * 366, 40
_PART = r"^(\*|\d+)(?:-(\d+))?(?:/(\d+))?$"


def _values(field: Column, name: str) -> Column:
    """Sorted values of a field, or null where it is not valid."""
    low, high = FIELDS[name]
    text = F.lower(field)
    for i, word in enumerate(NAMES.get(name, [])):
        text = F.regexp_replace(text, rf"\b{word}\b", str(i + (name == "month")))

    def part(p: Column) -> Column:
        first, last, step = (F.regexp_extract(p, _PART, i) for i in (1, 2, 3))
        star = first == "*"
        a = F.when(star, low).otherwise(first.try_cast("int"))
        b = F.when(star, F.lit(high if name != "weekday" else 6)).when(last != "", last.try_cast("int")).when(step != "", high if name != "weekday" else 6).otherwise(a)
        by = F.when(step == "", 1).otherwise(step.try_cast("int"))
        good = p.rlike(_PART) & ~(star & (last != "")) & (a >= low) & (b <= high) & (a <= b) & (by > 0)
        return F.when(good, F.sequence(a, b, F.greatest(by, F.lit(1))))

    parts = F.transform(F.split(text, ",", -1), part)
    flat = F.array_sort(F.array_distinct(F.flatten(parts)))
    if name == "weekday":
        flat = F.array_sort(F.array_distinct(F.transform(flat, lambda x: x % 7)))
    return F.when(~F.exists(parts, lambda x: x.isNull()), flat)


def parsed(cron: Column) -> Column:
    """A struct of the five sets and whether days are any (star), or null where the expression is not valid."""

    def fields(f: Column) -> Column:
        sets = [_values(F.get(f, i), n).alias(n) for i, n in enumerate(FIELDS)]
        return F.when(F.size(f) == 5, F.struct(*sets, (F.get(f, 2) == "*").alias("any_day"), (F.get(f, 4) == "*").alias("any_weekday")))

    def whole(s: Column) -> Column:
        known = F.lit(True)
        for n in FIELDS:
            known &= s[n].isNotNull()
        return F.when(known, s)

    return let(let(F.split(F.trim(cron), r"\s+"), fields), whole)


def next_time(sets: Column, base: Column) -> Column:
    """The first time of a parsed schedule after ``base`` (a timestamp without a zone)."""
    return let(F.struct(sets.alias("sets"), base.cast("timestamp_ntz").alias("base")), lambda x: _next(x["sets"], x["base"]))


def _next(sets: Column, base: Column) -> Column:
    today, now = F.to_date(base), F.hour(base) * 60 + F.minute(base)

    def fits(d: Column) -> Column:
        day, weekday = F.array_contains(sets["day"], F.dayofmonth(d)), F.array_contains(sets["weekday"], F.dayofweek(d) - 1)
        either = F.when(sets["any_day"], weekday).when(sets["any_weekday"], day).otherwise(day | weekday)
        return F.array_contains(sets["month"], F.month(d)) & either

    times = F.flatten(F.transform(sets["hour"], lambda h: F.transform(sets["minute"], lambda m: h * 60 + m)))

    def at(d: Column, minute: Column) -> Column:
        return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.floor(minute / 60).cast("int"), (minute % 60).cast("int"), F.lit(0))

    def found(t: Column) -> Column:
        later = F.get(F.filter(t, lambda m: m > now), 0)
        first = lambda a, b: F.get(F.filter(F.sequence(F.date_add(today, a), F.date_add(today, b)), fits), 0)
        day = F.coalesce(first(1, SOON), first(SOON + 1, AHEAD))
        return F.when(fits(today) & later.isNotNull(), at(today, later)).otherwise(let(day, lambda d: at(d, F.get(t, 0))))

    return F.when(sets.isNotNull() & base.isNotNull(), let(times, found))


def evaluate(triggers: DataFrame, now: Column, default: str | None = None) -> DataFrame:
    """Triggers (trigger_id, cron_expr, last_fired_at) with state and next_fire, and last_fired_at as it is afterwards.

    Without an expression the platform's ``default`` holds, without either a trigger is skipped. One that has never fired is anchored at
    ``now`` and does not fire; it is due once the first time after its last firing has come.
    """
    cron = F.coalesce(F.when(F.trim("cron_expr") != "", F.col("cron_expr")), F.lit(default).cast("string"))
    known = triggers.withColumn("_cron", cron).withColumn("_sets", parsed(F.col("_cron"))).withColumn("next_fire", next_time(F.col("_sets"), F.coalesce("last_fired_at", now)))
    never = F.col("last_fired_at").isNull()
    state = F.when(F.col("_cron").isNull(), "skipped").when(F.col("_sets").isNull(), "invalid").when(never, "anchored").when(F.col("next_fire") <= now, "due").otherwise("not_due")
    fired = F.when(F.col("state").isin("anchored", "due"), now).otherwise(F.col("last_fired_at"))
    return known.withColumn("state", state).withColumn("last_fired_at", fired).drop("_cron", "_sets")
