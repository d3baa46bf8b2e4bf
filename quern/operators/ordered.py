"""Running figures of ordered rows in two levels: inside a range of rows, and over the ranges of a key.

Rows are laid out in ranges of (key, order) and written with their range. A few figures of each range and key are
computed where the rows are, a window over the ranges of a key carries them on, and a window inside the
range does the rest. No task holds all rows of a key: a hot key's rows lie in as many ranges as they fill, and the window over its
ranges sees one row for each.

Defined cases: a null key is a key; equal places in the order stay in one range, in no order among themselves; nulls
count as no value in sums; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import materialize

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def ranges(rows: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``part``, the number of their range; greater keys and later rows have greater numbers."""
    dealt = rows.repartitionByRange(parts, by, *order) if parts else rows.repartitionByRange(by, *order)
    return materialize(dealt.withColumn("part", F.spark_partition_id()), "ordered-ranges")


def carried(laid: DataFrame, by: str, figures: dict[str, Column]) -> DataFrame:
    """part, key and ``figures`` (aggregates) of each range and key; over ``Window.partitionBy(key).orderBy("part")`` they are carried on."""
    return laid.groupBy("part", by).agg(*(c.alias(n) for n, c in figures.items()))


def _joined(laid: DataFrame, by: str, known: DataFrame) -> DataFrame:
    same = known.withColumnRenamed("part", "_part").withColumnRenamed(by, "_by")
    return laid.join(same, (F.col("part") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by"))).drop("_part", "_by")


def sums(rows: DataFrame, by: str, order: list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with running sums of ``values`` (by name), each row included, and ``part``."""
    laid = ranges(rows.withColumns({f"_{n}": v for n, v in values.items()}), by, order, parts)
    own = carried(laid, by, {f"_{n}_sum": F.sum(f"_{n}") for n in values})
    over, inside = Window.partitionBy(by).orderBy("part").rowsBetween(*_BEFORE), Window.partitionBy("part", by).orderBy(*order).rowsBetween(*_SO_FAR)
    before = own.select("part", by, *(F.sum(f"_{n}_sum").over(over).alias(f"_{n}_before") for n in values))
    both = _joined(laid, by, before)

    def total(n: str) -> Column:  # null until there is a value, as a plain running sum is
        now, then = F.sum(f"_{n}").over(inside), F.col(f"_{n}_before")
        return F.coalesce(now + then, now, then)

    return both.withColumns({n: total(n) for n in values}).drop(*(c for n in values for c in (f"_{n}", f"_{n}_before")))


def neighbours(rows: DataFrame, by: str, order: list[str], mark: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the mark of the row before (``before``) and whether it is its key's last (``last``)."""
    laid = ranges(rows, by, order, parts)
    own = carried(laid, by, {"_end": F.max(F.struct(*order, F.col(mark).alias("_mark")))})
    over = Window.partitionBy(by).orderBy("part")
    known = own.select("part", by, F.lag("_end").over(over)["_mark"].alias("_before"), F.lead("part").over(over).isNull().alias("_ends"))
    inside = Window.partitionBy("part", by).orderBy(*order)
    both = _joined(laid, by, known).withColumn("_first", F.row_number().over(inside) == 1)
    out = both.withColumn("before", F.when(F.col("_first"), F.col("_before")).otherwise(F.lag(mark).over(inside)))
    return out.withColumn("last", F.col("_ends") & F.lead(F.lit(1)).over(inside).isNull()).drop("_before", "_ends", "_first", "part")
