"""Filtered dense top-k with threshold, status and explanation, and retrieval metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import materialize, ship

MAX_K, OVERFETCH, MAX_FETCH = 100, 10, 1000
#: Decimals of a score that ranks; what is returned is rounded to six. Sums in another order differ beyond them.
RANKED = 12
#: Queries of one block, on average at most.
MOST_QUERIES = 4096


def clamp(k: int) -> int:
    return max(1, min(k, MAX_K))


def payload_filter(frame: DataFrame, conditions: dict) -> DataFrame:
    """Conjunction of equalities on (dotted) columns, or of membership in an array ({"__contains__": v})."""
    for path, v in conditions.items():
        frame = frame.where(F.array_contains(F.col(path), v["__contains__"]) if isinstance(v, dict) else F.col(path) == v)
    return frame


def topk(points: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """query_id, rank, point_id and score of each query's best points, by cosine, ties to the smaller id.

    Ranks go by ``RANKED`` decimals, ``rounded`` gives the score that is shown.

    ``queries`` (query_id, qvec, and tenant if ``same`` names the points' column of it) may be of any number:
    a block of bounded size, made unit vectors once, is broadcast, points are multiplied with it by Arrow
    batch where they are read, and only each batch's best move. More queries are dealt into blocks by a hash of
    their id, each block's rows are written before the next one starts.
    """
    blocks = max(1, math.ceil(queries.count() / MOST_QUERIES))
    if blocks == 1:
        return _block(points, queries, k, same)
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [materialize(_block(points, queries.where(own == i), k, same), "topk-block") for i in range(blocks)])


def _score(batches: Iterator[pa.RecordBatch], held, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """A task's best points of each query; points with null or empty vectors score 0 against all."""
    ids, tenants, q = held.value
    for batch in batches:
        rows = batch.column(1).to_pylist()
        dim = q.shape[1]
        v = np.array([r if r is not None and len(r) == dim else [0.0] * dim for r in rows], np.float64).reshape(len(rows), dim)
        length = np.sqrt((v * v).sum(1))
        length[length == 0] = 1.0
        points = batch.column(0).to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(ids), 256):
            score = np.round((v @ q[a : a + 256].T) / length[:, None], RANKED) + 0.0
            ok = points[:, None] != ids[a : a + 256][None, :]
            if same:
                ok &= np.array(batch.column(2).to_pylist(), object)[:, None] == tenants[a : a + 256][None, :]
            score[~ok] = -np.inf
            for i in range(score.shape[1]):
                s = score[:, i]
                at = np.flatnonzero(np.isfinite(s)) if len(s) <= k else np.flatnonzero(np.isfinite(s) & (s >= np.partition(s, len(s) - k)[len(s) - k]))
                at = at[np.lexsort((points[at], -s[at]))][:k]
                out.append((np.full(len(at), ids[a + i]), points[at], s[at]))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], names=["query_id", "point_id", "score"])


def _block(points: DataFrame, queries: DataFrame, k: int, same: str | None) -> DataFrame:
    spark = points.sparkSession
    ship(spark)
    asked = sorted(queries.collect(), key=lambda r: r["query_id"])
    dim = max((len(r["qvec"] or []) for r in asked), default=0)
    q = np.array([r["qvec"] if r["qvec"] is not None and len(r["qvec"]) == dim else [0.0] * dim for r in asked], np.float64).reshape(len(asked), dim)
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    norm[norm == 0] = 1.0
    tenants = np.array([r["tenant"] if same else None for r in asked], object)
    held = spark.sparkContext.broadcast((np.array([r["query_id"] for r in asked], np.int64), tenants, q / norm))
    rows = points.select(F.col("point_id").cast("long"), F.col("vec").cast("array<double>"), *([same] if same else []))
    scored = rows.mapInArrow(lambda b: _score(b, held, k, bool(same)), "query_id long, point_id long, score double")
    local = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k)


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def respond(found: DataFrame, queries: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Results after the threshold, and one status per query: matches, no_matches or filtered_to_zero."""
    kept = found.where(F.col("score") >= threshold)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))).where(F.col("rank") <= k)
    by = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum((F.col("score") >= threshold).cast("long")).alias("n_survivors"))
    n, s = F.coalesce("n_candidates", F.lit(0)), F.coalesce("n_survivors", F.lit(0))
    status = F.when(n == 0, "no_matches").when(s == 0, "filtered_to_zero").otherwise("matches")
    return ranked, queries.select("query_id").join(by, "query_id", "left").select("query_id", n.alias("n_candidates"), s.alias("n_survivors"), status.alias("status"))


def explain(found: DataFrame, k: int, threshold: float) -> DataFrame:
    """Every candidate with the filter that left it out, if any."""
    why = F.when(F.col("score") < threshold, "score_threshold").when(F.col("rank") > k, "top_k")
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.coalesce(why, F.lit("returned")).alias("outcome"))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / F.size(F.array_distinct(gold)))


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    top = F.slice(retrieved, 1, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.filter(top, lambda x: F.array_contains(gold, x))) / F.size(top))


def evaluate(answers: DataFrame, k: int, by: str) -> DataFrame:
    """Mean recall (over questions with a gold list) and precision by type and in all."""
    scored = answers.select(by, (F.size("gold") > 0).alias("scorable"), recall_at(F.col("retrieved"), F.col("gold"), k).alias("r"), precision_at(F.col("retrieved"), F.col("gold"), k).alias("p"))
    return scored.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("scorable"), F.col("r"))), 6).alias("recall"), F.round(F.avg("p"), 6).alias("precision"))


def hits(asked: DataFrame, found: DataFrame, hit: Column) -> DataFrame:
    """``asked`` (query_id, n_gold, ...) with recall and precision of what was found, hits counted by query.

    Without gold, or with nothing found, the figure is 0.
    """
    by = asked.join(found, "query_id", "left").groupBy(*asked.columns).agg(F.count(F.col(found.columns[1])).alias("n_found"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("n_hits"))
    share = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.col("n_hits") / F.col(n))
    return by.select(*asked.columns, share("n_gold").alias("recall"), share("n_found").alias("precision"))
