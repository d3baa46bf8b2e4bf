"""Streaming queries over ``events`` and ``clicks`` and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans.registry import QUERIES, SQL, query
from quern.session import table
from quern.streaming import heartbeats, limits

RATE = 0.0005
BURST = 4000
#: Event after event of each user, by recursion: what is in the bucket, and whether the event passes.
BUCKETS = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, event_id, t, i, {RATE * BURST}::DOUBLE AS held FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, least({RATE * BURST}::DOUBLE, CASE WHEN b.held >= 1 THEN b.held - 1 ELSE b.held END + (e.t - b.t) * {RATE}::DOUBLE) FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.i = b.i + 1)
SELECT event_id, user_id, held >= 1 AS allowed FROM b"""


@query("token_bucket", "events", BUCKETS)
def token_bucket(events: DataFrame) -> DataFrame:
    return limits.token_bucket_batch(events, RATE, BURST)


def _stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files, whether it is a file or a folder of files."""
    known, path = table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet"
    new = spark.readStream.schema(known.schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return new.parquet(path)
    return new.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.drain(spark, limits.token_bucket(_stream(spark, sf_dir), RATE, BURST), "bucket")


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.drain(spark, limits.ledger(_stream(spark, sf_dir)), "ledger", "complete")


QUERIES["stream_token_bucket"] = stream_token_bucket
SQL["stream_token_bucket"] = BUCKETS
QUERIES["stream_ledger"] = stream_ledger
SQL["stream_ledger"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, sum(value::DECIMAL(18,6))::DOUBLE AS cost, count(*) AS n FROM events GROUP BY 1, 2"

REAP = heartbeats.Rule(timeout=3600, forget=86400, most=3, slot=600, late=7200)
# A client's clicks stand for the heartbeats of its job: islands of beats, then islands of reaps.
REAPS = f"""WITH b AS (SELECT client_id AS job, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT (max(t) // 1000 * 1000 - {REAP.late}000000) // {REAP.slot}000000 * {REAP.slot}000000 AS sure FROM b),
m AS (SELECT job, t, coalesce(t - lag(t) OVER (PARTITION BY job ORDER BY t) > {REAP.timeout}000000, true)::INT AS new FROM b),
i AS (SELECT job, t, sum(new) OVER (PARTITION BY job ORDER BY t) AS i FROM m),
s AS (SELECT job, i, min(t) AS f, max(t) AS l, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT *, coalesce(f - lag(l) OVER (PARTITION BY job ORDER BY f) > {REAP.forget}000000, true)::INT AS again FROM s),
r AS (SELECT *, sum(again) OVER (PARTITION BY job ORDER BY f) AS run FROM g),
a AS (SELECT *, row_number() OVER (PARTITION BY job, run ORDER BY f)::INT AS attempt FROM r)
SELECT job, make_timestamp(f) AS first_beat, make_timestamp(l) AS last_beat, n AS n_beats, make_timestamp(l + {REAP.timeout}000000) AS reaped_at, attempt, CASE WHEN attempt >= {REAP.most} THEN 'failed' ELSE 'requeued' END AS action
FROM a, w WHERE l + {REAP.timeout}000000 < sure"""


@query("heartbeat_reaps", "clicks", REAPS)
def heartbeat_reaps(clicks: DataFrame) -> DataFrame:
    return heartbeats.reaps_batch(clicks, "client_id", "ts", REAP)


def stream_heartbeat_reaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.drain(spark, heartbeats.reaps(_stream(spark, sf_dir, "clicks"), "client_id", "ts", REAP), "reaps")


QUERIES["stream_heartbeat_reaps"] = stream_heartbeat_reaps
SQL["stream_heartbeat_reaps"] = REAPS
