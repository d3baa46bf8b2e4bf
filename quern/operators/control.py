"""Evaluation sweeps, gates, ledger, queue, deletion and catalogue rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import ordered
from quern.session import materialize

ACTIVE = ("queued", "claimed", "running", "paused")


def stratified_sample(docs: DataFrame, stratum: str, target: int, key: Column) -> DataFrame:
    """``target`` rows in proportion to the strata, at least one of each, largest remainders first.

    No quota passes its stratum's size, and with more strata than ``target`` the first ones in order give one
    row each. Within a stratum rows go in order of a hash (``key``, hexadecimal): only rows below a cut of it
    that holds several times the quota are ranked, and a stratum whose cut holds too few is ranked whole.
    """
    sizes = docs.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total, strata = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return docs.select("doc_id", stratum).limit(0)
    aim = min(target, total)
    share = F.col("n") * F.lit(aim) / F.lit(total)
    if strata > aim:
        quota = sizes.withColumn("turn", F.row_number().over(Window.orderBy(stratum))).select(stratum, "n", (F.col("turn") <= aim).cast("long").alias("quota"))
    else:
        base = sizes.withColumn("base", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(share)))).withColumn("rest", share - F.floor(share)).withColumn("slack", (F.col("n") > F.col("base")).cast("long"))
        spare = max(0, aim - base.agg(F.sum("base")).first()[0])
        turn = F.sum("slack").over(Window.orderBy(F.desc("rest"), stratum).rowsBetween(Window.unboundedPreceding, 0))
        quota = base.select(stratum, "n", (F.col("base") + F.when((F.col("slack") > 0) & (turn <= spare), 1).otherwise(0)).alias("quota"))
    # The first 15 digits of the hash as a share of all values; four times the quota and 64 more lie below the cut.
    place = F.conv(F.substring(key, 1, 15), 16, 10).cast("double") / float(16**15)
    rows = docs.select("doc_id", stratum, key.alias("turn_key"), place.alias("place")).join(F.broadcast(quota), stratum)
    cut = (4 * F.col("quota") + 64) / F.col("n")
    w = Window.partitionBy(stratum).orderBy("turn_key", "doc_id")
    early = rows.where(F.col("place") < cut).withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("quota")).select("doc_id", stratum)
    short = early.groupBy(stratum).agg(F.count(F.lit(1)).alias("got")).join(quota, stratum, "right").where(F.coalesce("got", F.lit(0)) < F.col("quota")).select(stratum)
    short = materialize(short, "sample-short")
    if not short.count():
        return early
    whole = rows.join(F.broadcast(short), stratum, "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("quota")).select("doc_id", stratum)
    return early.join(F.broadcast(short), stratum, "left_anti").unionByName(whole)


def candidate_grid(spark: SparkSession, strategies: tuple[str, ...] = ("recursive_char", "structure_aware"), sizes: tuple[int, ...] = (256, 512, 1024), overlaps: tuple[int, ...] = (0, 64), modes: tuple[str, ...] = ("dense", "hybrid")) -> DataFrame:
    """All settings of a sweep: a fixed handful, made on the driver."""
    rows = [(i, s, n, o, m) for i, (s, n, o, m) in enumerate((s, n, o, m) for s in strategies for n in sizes for o in overlaps for m in modes)]
    return spark.createDataFrame(rows, "candidate int, strategy string, max_tokens int, overlap_tokens int, retrieval string")


def sweep_rank(scores: DataFrame, reference: int, margin: float = 0.02) -> DataFrame:
    """Candidates by gain in recall, then precision, over the reference; near-optimal if the best gains little.

    In that case the reference wins. A sweep holds a few dozen candidates.
    """
    ref = scores.where(F.col("candidate") == reference).select(F.col("recall").alias("r0"), F.col("precision").alias("p0")).first()
    gain = scores.withColumn("d_recall", F.round(F.col("recall") - ref["r0"], 6)).withColumn("d_precision", F.round(F.col("precision") - ref["p0"], 6))
    best = gain.agg(F.max("d_recall")).first()[0]
    near = best <= margin
    w = Window.orderBy(F.desc("d_recall"), F.desc("d_precision"), "candidate")
    return gain.withColumn("place", F.row_number().over(w)).withColumn("near_optimal", F.lit(near)).withColumn("winner", (F.col("candidate") == reference) if near else (F.col("place") == 1))


def drift(baseline: DataFrame, current: DataFrame, on: str, limit: float = 0.05) -> DataFrame:
    """Baseline against current scores: no_baseline, not_scored, regressed, improved or stable."""
    both = baseline.select(on, F.col("score").alias("baseline")).join(current.select(on, F.col("score").alias("current")), on, "full_outer")
    delta = F.round(F.col("baseline") - F.col("current"), 6)
    status = F.when(F.col("baseline").isNull(), "no_baseline").when(F.col("current").isNull(), "not_scored").when(delta > limit, "regressed").when(delta < 0, "improved").otherwise("stable")
    return both.select(on, "baseline", "current", delta.alias("delta"), status.alias("status"))


def gates(previous: DataFrame, current: DataFrame, on: str, tolerance: float = 0.20) -> DataFrame:
    """Class by class counts of a new index against the last: lost classes fail, large changes fail, new ones pass."""
    both = previous.groupBy(on).agg(F.count(F.lit(1)).alias("previous")).join(current.groupBy(on).agg(F.count(F.lit(1)).alias("current")), on, "full_outer")
    p, c = F.coalesce("previous", F.lit(0)), F.coalesce("current", F.lit(0))
    status = F.when((p > 0) & (c == 0), "class_to_zero").when((p > 0) & (F.abs(c - p) > tolerance * p), "out_of_tolerance").otherwise("passed")
    return both.select(on, p.alias("previous"), c.alias("current"), status.alias("gate"))


def accrued(ledger: DataFrame, by: list[str], cost: str) -> DataFrame:
    return ledger.groupBy(*by).agg(F.coalesce(F.sum(F.col(cost).cast("decimal(18,9)")), F.lit(0).cast("decimal(18,9)")).alias("accrued"))


def budget_guard(accounts: DataFrame, cap: Column, projected: Column, workspace_cap: Column, workspace: Column) -> DataFrame:
    """allow, pause_kb_cap or pause_workspace_cap; an account's own cap is looked at first."""
    return accounts.withColumn("decision", F.when(F.col("accrued") + projected > cap, "pause_kb_cap").when(workspace + projected > workspace_cap, "pause_workspace_cap").otherwise("allow"))


def running_total(ledger: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    return ordered.sums(ledger, by, order, {"running": F.col(value).cast("decimal(18,6)")}).drop("part")


def streaks(rows: DataFrame, by: str, order: list[str], hit: Column, least: int = 3) -> DataFrame:
    """Runs of consecutive hits of at least ``least`` rows."""
    marked = ordered.sums(rows.withColumn("hit", F.coalesce(hit, F.lit(False))), by, order, {"i": F.lit(1), "k": F.col("hit").cast("int")})
    # Among hits, the rows so far less the hits so far stay the same until a row is none.
    runs = marked.where("hit").groupBy(by, (F.col("i") - F.col("k")).alias("run")).agg(F.min("i").cast("int").alias("first_row"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).select(by, "first_row", "n")


def dedupe_jobs(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The first active job of each key; map-side minimum, no sort."""
    by = jobs.where(F.col("state").isin(*ACTIVE)).groupBy(*keys).agg(F.min(F.struct("created_at", "job_id")).alias("x"))
    return by.select(*keys, "x.job_id")


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.where("state = 'queued'").orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


def stale(jobs: DataFrame, now: Column, timeout_s: int = 60) -> DataFrame:
    return jobs.where(F.col("state").isin("claimed", "running") & (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {timeout_s} SECONDS")))


def orphans(points: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return points.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row of each key: a map-side maximum rather than a sort."""
    cols = [c for c in table.columns if c != key]
    by = table.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("x"))
    return by.select(key, *(F.col(f"x.{c}").alias(c) for c in cols))


def history(scores: DataFrame, by: str, at: str, mark: str) -> DataFrame:
    """Type-2 history: the current row, and where the mark changed from the one before."""
    rows = ordered.neighbours(scores, by, [at, "event_id"], mark)
    return rows.withColumn("changed", F.coalesce(F.col(mark) != F.col("before"), F.lit(False))).withColumnRenamed("last", "is_current").drop("before")


def exclusion_report(decompose: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Exclusions with confirmed decisions that are not among them, counted by reason."""
    rest = confirmed.join(decompose, ["doc_id", "reason"], "left_anti")
    return decompose.select("doc_id", "reason").unionByName(rest.select("doc_id", "reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def retention(snapshots: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return snapshots.where(F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def reconcile(aliases: DataFrame, records: DataFrame) -> DataFrame:
    """Aliases against control records: repair a lagging record, report what has only one side."""
    both = aliases.select("kb", F.col("target").alias("alias_target")).join(records.select("kb", F.col("target").alias("record_target")), "kb", "full_outer")
    state = F.when(F.col("record_target").isNull(), "failed_manual").when(F.col("alias_target").isNull(), "orphan_record").when(F.col("alias_target") != F.col("record_target"), "repair_record").otherwise("in_sync")
    return both.select("kb", state.alias("state"))


def fingerprint(hashes: DataFrame, column: str) -> DataFrame:
    """One digest of a table's content hashes, in no order: their number and the sums of four parts of them."""
    parts = [F.sum(F.conv(F.substring(column, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return hashes.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("fingerprint"))
