"""Quantiles from mergeable summaries: Spark's own KLL sketches of bigints, with exact ranks beside them.

Rows are (group, batch, x, weight). One sketch is made of each group's batch, and the whole of a group is
the fold of its batches' sketches, never of its rows. What a sketch keeps and answers is read from it; the exact
rank of an answer comes from prefix sums over the values: counts are laid out in ranges of (group,
batch, x), each range is summed, the sums before a range are carried into it, and a window inside the range
does the rest. Everything is DataFrame functions.

No group is held by one task: a range has as many distinct values as another; a window over a group sees
one row for each range that it touches, and at most one sketch for each batch; weights above ``PIECE`` are cut into pieces
that are dealt before a sketch takes them one by one. Nothing but the small rows of ranges and sketches is joined.

A sketch of ``K`` holds fewer than 1,000 values up to 10**11 rows of one group, and all values of up to ``K`` rows.
Its error of rank is about 1 % (99 of 100 sketches). Sketches draw random bits, so answers may differ from
run to run; the table of sketches is written once, and all columns speak of the same answers.

Defined cases: rows lacking a group, a batch, a value or a weight take no part; repeated rows count each;
equal values are one value with a count; summaries of fewer than ``least`` rows are merged but not
reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import materialize

#: Size of sketches, units that one row feeds to a sketch.
K, PIECE = 280, 1 << 14
WHOLE = -1
BATCHES, PARTS, LEAST, PER_MILLE = 4, 4, 20, 20


def counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, batch, x and c (how many) of each distinct value, with the whole as a batch of its own; sums combine before they move."""
    complete = F.lit(True)
    for k in (*keys, "batch", "x", "weight"):
        complete &= F.col(k).isNotNull()
    by = rows.where(complete).groupBy(*keys, F.col("batch").cast("int").alias("batch"), F.col("x").cast("long").alias("x")).agg(F.sum(F.col("weight").cast("long")).alias("c")).where("c > 0")
    kept = materialize(by, "quantile-batches")
    whole = kept.groupBy(*keys, "x").agg(F.sum("c").alias("c")).select(*keys, F.lit(WHOLE).alias("batch"), "x", "c")
    return kept.unionByName(whole)


def laid_out(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counts in ranges of (keys, batch, x), each row with its range; written, so that ranges stay what they are."""
    order = [*keys, "batch", "x"]
    return materialize(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "quantile-ranges")


def sketches(ranges: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """keys, batch and sketch of every batch, and of every whole as the fold of its batches' sketches."""
    once = ranges.where(F.col("batch") != WHOLE)
    # Each value is fed as often as it occurs: long runs in pieces, which are dealt anew.
    long = once.where(F.col("c") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / PIECE) - 1))).repartition(*keys, "batch", "x", "piece")
    long = long.withColumn("c", F.least(F.lit(PIECE).cast("long"), F.col("c") - F.col("piece") * PIECE)).drop("piece")
    fed = once.where(F.col("c") <= PIECE).unionByName(long).select(*keys, "batch", F.explode(F.array_repeat("x", F.col("c").cast("int"))).alias("x"))
    each = materialize(fed.groupBy(*keys, "batch").agg(F.kll_sketch_agg_bigint("x", k).alias("sketch")), "quantile-sketches")
    held = F.transform(F.array_sort(F.collect_list(F.struct("batch", "sketch"))), lambda s: s["sketch"])
    fold = F.aggregate(F.slice(F.col("held"), 2, F.greatest(F.size("held") - 1, F.lit(1))), F.element_at("held", 1), F.kll_sketch_merge_bigint)
    whole = each.groupBy(*keys).agg(held.alias("held")).select(*keys, F.lit(WHOLE).alias("batch"), fold.alias("sketch"))
    return each.unionByName(whole)


def answers(made: DataFrame, keys: Sequence[str], parts: int, least: int) -> DataFrame:
    """What the sketches of at least ``least`` rows keep (points) and answer for the ranks ceil(i * n / parts)."""
    n = F.kll_sketch_get_n_bigint("sketch")
    kept = F.regexp_extract(F.kll_sketch_to_string_bigint("sketch"), r"Retained Items\s*:\s*(\d+)", 1).cast("long")
    known = made.withColumn("n", n).where(F.col("n") >= least)
    # A sketch answers for a share r with the smallest value whose rank is ceil(r * n) or more, which is the target.
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return known.select(*keys, "batch", F.col("n").alias("sketch_n"), kept.alias("points"), F.kll_sketch_get_quantile_bigint("sketch", ranks).alias("answers"))


def target(i: int, parts: int) -> Column:
    """ceil(i * n / parts) in whole numbers."""
    return F.expr(f"({i} * n + {parts - 1}) div {parts}")


def quantiles(rows: DataFrame, keys: Sequence[str] = ("stream", "grp"), parts: int = PARTS, least: int = LEAST, k: int = K) -> DataFrame:
    """keys, batch, i, n, target, exact_x, points, answer, n_below, n_upto and rank_error of every summary of at least ``least`` rows.

    ``rows`` have the columns named by ``keys``, and batch, x and weight.
    """
    ranges = laid_out(counted(rows, keys), keys)
    told = materialize(answers(sketches(ranges, keys, k), keys, parts, least), "quantile-answers")
    named = [*keys, "batch"]
    sums = ranges.groupBy(*named, "part").agg(F.sum("c").alias("s"))
    over = Window.partitionBy(*named)
    before = F.coalesce(F.sum("s").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    carried = sums.withColumn("before", before).withColumn("n", F.sum("s").over(over)).where(F.col("n") >= least).join(told, named).drop("s", "sketch_n")
    inside = Window.partitionBy("part", *named).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranges.join(carried, [*named, "part"]).withColumn("upto", F.col("before") + F.sum("c").over(inside)).withColumn("below", F.col("upto") - F.col("c"))
    facts = []
    for i in range(1, parts):
        t = target(i, parts)
        hit, mine = (F.col("below") < t) & (t <= F.col("upto")), F.col("answers")[i - 1] == F.col("x")
        facts.append(F.when(hit | mine, F.struct(F.lit(i).alias("i"), t.alias("target"), F.when(hit, F.col("x")).alias("exact_x"), F.when(mine, F.col("x")).alias("answer"), F.when(mine, F.col("below")).alias("n_below"), F.when(mine, F.col("upto")).alias("n_upto"))))
    found = ranked.withColumn("fact", F.array_compact(F.array(*facts))).where(F.size("fact") > 0).select(*named, "n", "points", F.explode("fact").alias("f")).select(*named, "n", "points", "f.*")
    most = [F.max(c).alias(c) for c in ("n", "points", "target", "exact_x", "answer", "n_below", "n_upto")]
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return found.groupBy(*named, "i").agg(*most).withColumn("rank_error", error)


def batch_of(number: Column, batches: int = BATCHES) -> Column:
    return (F.crc32(number.cast("string").cast("binary")) % batches).cast("int")


def clicks_and_prices(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Both streams as stream, grp, batch, x and weight.

    Of the rows of one click the earliest to arrive counts. A line's value depends on its item and its batch
    alone, so lines are counted by these before they meet their items, and no item is hot.
    """
    x = lambda money: F.floor(100 * money + 0.5) + 1000 * F.col("batch")
    real = lambda money: F.when(F.isnan(money) | (F.abs(money) == float("inf")), None).otherwise(money)
    click = clicks.groupBy("click_id").agg(F.min_by("client_id", "arrived_at").alias("client_id"), F.min_by("value", "arrived_at").alias("value"))
    value = click.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), real(F.col("value")).alias("money"), F.lit(1).cast("long").alias("weight"))
    line = lines.where("item_id IS NOT NULL").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count(F.lit(1)).alias("weight"))
    price = line.join(items.select("item_id", "brand", "price"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", real(F.col("price")).alias("money"), "weight")
    return value.unionByName(price).select("stream", "grp", "batch", x(F.col("money")).alias("x"), "weight")


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks_and_prices(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sale_lines", "items")))
    return quantiles(rows).withColumn("within", 1000 * F.col("rank_error") <= PER_MILLE * F.col("n"))
