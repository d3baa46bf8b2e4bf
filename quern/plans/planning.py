"""Queries of statistics, retrieval, evaluation and control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import PY_SPACE
from quern.functions.text import word_count as words
from quern.operators import annotate, control, retrieval, schedules, stats, sweep
from quern.plans.annotations import _script, _vote
from quern.plans.registry import QUERIES, SQL, query
from quern.session import table

COUNT = f"len(regexp_extract_all(text, '[^{PY_SPACE}]+'))"


def _sql_stats(by: str) -> str:
    q = lambda p: f"round(CASE WHEN n < {1 if p == 50 else 4} THEN most::DOUBLE WHEN n = 1 THEN v[1] ELSE v[j{p}] + ({p / 100}::DOUBLE * (n + 1) - j{p}) * (v[j{p} + 1] - v[j{p}]) END, 6)"
    j = ", ".join(f"greatest(1, least(floor({p / 100}::DOUBLE * (n + 1))::INT, n - 1))::INT AS j{p}" for p in (50, 75, 90, 95))
    return f"""st AS (SELECT {by}, n AS segment_count, least AS min_tokens, most AS max_tokens, mean AS mean_tokens, {q(50)} AS median_tokens, {q(75)} AS p75_tokens, {q(90)} AS p90_tokens, {q(95)} AS p95_tokens
FROM (SELECT *, {j} FROM (SELECT {by}, count(*) AS n, min(t) AS least, max(t) AS most, round(sum(t) / count(*), 6) AS mean, list_sort(list(t::DOUBLE)) AS v FROM (SELECT {by}, {COUNT} AS t FROM documents) GROUP BY 1)))"""


@query("class_token_quantiles", "documents", f"WITH {_sql_stats('source')} SELECT * FROM st")
def class_token_quantiles(docs: DataFrame) -> DataFrame:
    return stats.class_stats(docs, "source", words(F.col("text")))


@query("class_stats", "documents", f"WITH {_sql_stats('lang')} SELECT * FROM st")
def class_stats(docs: DataFrame) -> DataFrame:
    return stats.class_stats(docs, "lang", words(F.col("text")))


KIND = "CASE lang WHEN 'de' THEN 'table' WHEN 'fr' THEN 'code' WHEN 'es' THEN 'boilerplate' ELSE 'prose' END"


@query("recommended_rules", "documents", f"""WITH {_sql_stats('lang')}, r AS (SELECT lang, {KIND} AS kind, CASE WHEN segment_count < 5 THEN CASE {KIND} WHEN 'table' THEN 1024 ELSE 512 END ELSE least(2048, greatest(64, (ceil(p90_tokens / 64) * 64)::INT)) END AS max_tokens FROM st)
SELECT lang, max_tokens::INT AS max_tokens, CASE WHEN kind IN ('table', 'code') THEN 0 ELSE greatest(32, max_tokens // 8) END::INT AS overlap_tokens,
CASE kind WHEN 'table' THEN 'table_atomic' WHEN 'code' THEN 'code_syntax' ELSE 'recursive_char' END AS strategy,
CASE WHEN kind IN ('boilerplate', 'front_matter') THEN 'boilerplate' ELSE 'primary,supporting' END AS salience_filter, kind NOT IN ('code', 'scanned_region', 'boilerplate', 'front_matter', 'cross_reference') AS rerank_eligible FROM r""")
def recommended_rules(docs: DataFrame) -> DataFrame:
    """Languages stand for segment classes."""
    kind = F.when(F.col("lang") == "de", "table").when(F.col("lang") == "fr", "code").when(F.col("lang") == "es", "boilerplate").otherwise("prose")
    return stats.recommend(stats.class_stats(docs, "lang", words(F.col("text"))), "lang", kind)


DOCS = "SELECT doc_id AS id, text FROM documents"


@query("language_support", "documents", f"""WITH {_vote(DOCS)}, x AS (SELECT coalesce({_script('text')}, code, 'und') AS language, count(*) AS n FROM documents d LEFT JOIN vote ON vote.id = d.doc_id GROUP BY 1)
SELECT language, n, round(n / (SELECT count(*) FROM documents), 4) AS share, CASE WHEN language IN ('und', 'en') OR round(n / (SELECT count(*) FROM documents), 4) < 0.02 THEN 'supported' ELSE 'unsupported' END AS decision FROM x""")
def language_support(docs: DataFrame) -> DataFrame:
    return stats.language_support(docs, annotate.language(F.col("text")), ("en",))


@query("ingestion_cost", "documents", f"""WITH t AS (SELECT {COUNT} AS t FROM documents), c AS (SELECT t, CASE WHEN t <= 512 THEN least(t, 1) ELSE ceil((t - 512) / 448) + 1 END::BIGINT AS c FROM t)
SELECT sum(c)::BIGINT AS n_chunks, sum(CASE WHEN t <= 512 THEN t ELSE t + 64 * (c - 1) END)::BIGINT AS n_tokens, (sum(CASE WHEN t <= 512 THEN t ELSE t + 64 * (c - 1) END)::DECIMAL(18,0) * {stats.PRICE}::DECIMAL(9,8))::DECIMAL(18,9)::VARCHAR AS cost_usd FROM c""")
def ingestion_cost(docs: DataFrame) -> DataFrame:
    return stats.ingestion_cost(docs, words(F.col("text")))


def _points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec"), F.col("label").alias("tenant"))


def _asks(embeddings: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 50 asks."""
    return embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("tenant"))


def _sql_top(where: str, k: int = 10) -> str:
    return f"""pairs AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS raw FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id {where} WHERE q.vec_id % 50 = 0),
top AS (SELECT *, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, point_id)::INT AS rank FROM pairs QUALIFY rank <= {k})"""


@query("dense_topk", "embeddings", f"WITH {_sql_top('')} SELECT query_id, rank, point_id, score FROM top")
def dense_topk(embeddings: DataFrame) -> DataFrame:
    return retrieval.rounded(retrieval.topk(_points(embeddings), _asks(embeddings), 10))


@query("dense_topk_filtered", "embeddings", f"WITH {_sql_top('AND p.label = q.label')} SELECT query_id, rank, point_id, score FROM top")
def dense_topk_filtered(embeddings: DataFrame) -> DataFrame:
    """Labels stand for tenants: the filter is part of the search."""
    return retrieval.rounded(retrieval.topk(_points(embeddings), _asks(embeddings), 10, same="tenant"))


@query("threshold_status", "embeddings", f"""WITH {_sql_top('AND p.label = q.label', 100)}
SELECT q.vec_id AS query_id, count(point_id) AS n_candidates, coalesce(sum((raw >= 0.35)::INT), 0)::BIGINT AS n_survivors,
CASE WHEN count(point_id) = 0 THEN 'no_matches' WHEN sum((raw >= 0.35)::INT) = 0 THEN 'filtered_to_zero' ELSE 'matches' END AS status
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN top ON top.query_id = q.vec_id GROUP BY 1""")
def threshold_status(embeddings: DataFrame) -> DataFrame:
    asks = _asks(embeddings)
    return retrieval.respond(retrieval.topk(_points(embeddings), asks, 100, same="tenant"), asks, 10, 0.35)[1]


@query("explain_exclusions", "embeddings", f"WITH {_sql_top('AND p.label = q.label', 100)} SELECT query_id, point_id, score, CASE WHEN raw < 0.35 THEN 'score_threshold' WHEN rank > 10 THEN 'top_k' ELSE 'returned' END AS outcome FROM top")
def explain_exclusions(embeddings: DataFrame) -> DataFrame:
    return retrieval.explain(retrieval.topk(_points(embeddings), _asks(embeddings), 100, same="tenant"), 10, 0.35)


ANSWERS = f"""{_sql_top('')},
gold AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
m AS (SELECT q.vec_id AS query_id, q.label, gold.n - 1 AS g, count(t.point_id) AS r, coalesce(sum((p.label = q.label)::INT), 0) AS hits FROM embeddings q JOIN gold ON gold.label = q.label LEFT JOIN top t ON t.query_id = q.vec_id LEFT JOIN embeddings p ON p.vec_id = t.point_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_id, label, g, CASE WHEN g = 0 THEN 0.0 ELSE hits / g END AS rec, CASE WHEN r = 0 THEN 0.0 ELSE hits / r END AS prec FROM m)"""


def _answers(embeddings: DataFrame) -> DataFrame:
    """Gold of a query: all other vectors of its label; what is found is counted, so no gold list is gathered."""
    asks = _asks(embeddings)
    got = retrieval.topk(_points(embeddings), asks, 10)
    of = embeddings.select(F.col("vec_id").alias("point_id"), F.col("label").alias("found"))
    gold = embeddings.groupBy(F.col("label").alias("tenant")).agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    return retrieval.hits(asks.select("query_id", "tenant").join(gold, "tenant"), got.join(of, "point_id").select("query_id", "found"), F.col("found") == F.col("tenant")).withColumnRenamed("tenant", "label")


@query("eval_by_type", "embeddings", f"WITH {ANSWERS} SELECT coalesce(label::VARCHAR, 'all') AS label, count(*) AS n, round(avg(CASE WHEN g > 0 THEN rec END), 6) AS recall, round(avg(prec), 6) AS precision FROM s GROUP BY ROLLUP (s.label)")
def eval_by_type(embeddings: DataFrame) -> DataFrame:
    scored = _answers(embeddings)
    by = scored.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("n_gold") > 0, F.col("recall"))), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))
    return by.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("all")))


@query("recall_precision_at_k", "embeddings", f"WITH {ANSWERS} SELECT query_id, round(rec, 6) AS recall, round(prec, 6) AS precision FROM s")
def recall_precision_at_k(embeddings: DataFrame) -> DataFrame:
    return _answers(embeddings).select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("stratified_sample", "documents", """WITH s AS (SELECT source, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1),
b AS (SELECT source, n, least(n, greatest(1, floor(share)))::BIGINT AS base, share - floor(share) AS rest FROM s),
t AS (SELECT source, base, n > base AS slack, sum((n > base)::INT) OVER (ORDER BY rest DESC, source ROWS UNBOUNDED PRECEDING) AS turn FROM b),
q AS (SELECT source, base + (slack AND turn <= 100 - (SELECT sum(base) FROM b))::INT AS quota FROM t),
p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS k FROM documents)
SELECT doc_id, source FROM p JOIN q USING (source) WHERE k <= quota""")
def stratified_sample(docs: DataFrame) -> DataFrame:
    return control.stratified_sample(docs, "source", 100, F.sha2(F.col("doc_id").cast("string"), 256))


def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.candidate_grid(spark)


QUERIES["candidate_grid"] = candidate_grid
SQL["candidate_grid"] = """SELECT (row_number() OVER (ORDER BY a, b, c, d) - 1)::INT AS candidate, s AS strategy, n::INT AS max_tokens, o::INT AS overlap_tokens, m AS retrieval
FROM (VALUES (0, 'recursive_char'), (1, 'structure_aware')) x(a, s), (VALUES (0, 256), (1, 512), (2, 1024)) y(b, n), (VALUES (0, 0), (1, 64)) z(c, o), (VALUES (0, 'dense'), (1, 'hybrid')) w(d, m)"""

SCORES = "SELECT label::INT AS candidate, round(avg(embedding[1]::DOUBLE), 6) + 0.5 AS recall, round(avg(embedding[2]::DOUBLE), 6) + 0.5 AS precision FROM embeddings GROUP BY 1"


def _scores(embeddings: DataFrame) -> DataFrame:
    """Mean components by label stand for candidates' scores."""
    at = lambda i: F.round(F.avg(F.element_at("embedding", i).cast("double")), 6) + 0.5
    return embeddings.groupBy(F.col("label").alias("candidate")).agg(at(1).alias("recall"), at(2).alias("precision"))


@query("sweep_costs", "documents", """WITH w AS (SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n FROM documents)
SELECT unnest([0, 1, 2])::INT AS candidate, n AS tokens FROM w""")
def sweep_costs(docs: DataFrame) -> DataFrame:
    """Settings without overlap cut the same words; the texts are read once for all of them."""
    return sweep.costs(sweep.cut(docs, [sweep.Setting(n, 0) for n in (64, 256, 1024)])).select("candidate", "tokens")


CRONS = ["*/15 * * * *", "0 3 * * *", "30 2 * * 1-5", "0 0 1 * *", "15 6,18 1-7 * mon", "5 4 29 2 *"]
# What each of these means, minute by minute of the years to come.
_WHEN = ["minute(m) % 15 = 0", "hour(m) = 3 AND minute(m) = 0", "hour(m) = 2 AND minute(m) = 30 AND dayofweek(m) BETWEEN 1 AND 5", "day(m) = 1 AND hour(m) = 0 AND minute(m) = 0",
         "hour(m) IN (6, 18) AND minute(m) = 15 AND (day(m) <= 7 OR dayofweek(m) = 1)", "month(m) = 2 AND day(m) = 29 AND hour(m) = 4 AND minute(m) = 5"]


@query("next_runs", "events", f"""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2028-03-01', INTERVAL 1 MINUTE)) AS m),
w AS ({' UNION ALL '.join(f'SELECT {i} AS c, m FROM m WHERE {w}' for i, w in enumerate(_WHEN))}), e AS (SELECT event_id, event_id % 6 AS c, ts FROM events)
SELECT event_id, w.m AS next_run FROM e ASOF JOIN w ON w.c = e.c AND w.m > e.ts""")
def next_runs(events: DataFrame) -> DataFrame:
    """Events stand for the last run of a schedule each."""
    cron = F.element_at(F.array(*map(F.lit, CRONS)), (F.col("event_id") % len(CRONS) + 1).cast("int"))
    return events.select("event_id", schedules.next_time(schedules.parsed(cron), F.col("ts")).cast("timestamp").alias("next_run"))


@query("sweep_rank", "embeddings", f"""WITH s AS ({SCORES}), r AS (SELECT recall AS r0, precision AS p0 FROM s WHERE candidate = 0), d AS (SELECT candidate, round(recall - r0, 6) AS d_recall, round(precision - p0, 6) AS d_precision FROM s, r),
o AS (SELECT *, row_number() OVER (ORDER BY d_recall DESC, d_precision DESC, candidate)::INT AS place, max(d_recall) OVER () <= 0.02 AS near_optimal FROM d)
SELECT *, CASE WHEN near_optimal THEN candidate = 0 ELSE place = 1 END AS winner FROM o""")
def sweep_rank(embeddings: DataFrame) -> DataFrame:
    return control.sweep_rank(_scores(embeddings), 0).drop("recall", "precision")


@query("drift_check", "embeddings", f"""WITH a AS (SELECT candidate, recall AS baseline FROM ({SCORES}) WHERE candidate % 5 <> 1), b AS (SELECT candidate, precision AS current FROM ({SCORES}) WHERE candidate % 5 <> 2)
SELECT candidate, baseline, current, round(baseline - current, 6) AS delta, CASE WHEN baseline IS NULL THEN 'no_baseline' WHEN current IS NULL THEN 'not_scored' WHEN round(baseline - current, 6) > 0.05 THEN 'regressed' WHEN round(baseline - current, 6) < 0 THEN 'improved' ELSE 'stable' END AS status
FROM a FULL JOIN b USING (candidate)""")
def drift_check(embeddings: DataFrame) -> DataFrame:
    s = _scores(embeddings)
    return control.drift(s.where("candidate % 5 <> 1").select("candidate", F.col("recall").alias("score")), s.where("candidate % 5 <> 2").select("candidate", F.col("precision").alias("score")), "candidate")


@query("validation_gates", "documents", """WITH a AS (SELECT source, count(*) AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT source, count(*) AS c FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT source, coalesce(p, 0) AS previous, coalesce(c, 0) AS current, CASE WHEN coalesce(p, 0) > 0 AND coalesce(c, 0) = 0 THEN 'class_to_zero' WHEN coalesce(p, 0) > 0 AND abs(coalesce(c, 0) - p) > 0.2 * p THEN 'out_of_tolerance' ELSE 'passed' END AS gate FROM a FULL JOIN b USING (source)""")
def validation_gates(docs: DataFrame) -> DataFrame:
    """Even and odd ids stand for the last index and the new one."""
    return control.gates(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source")


@query("class_zero_regression", "documents", "SELECT DISTINCT lang FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE n_chars < 300 AND doc_id % 7 = 0)")
def class_zero_regression(docs: DataFrame) -> DataFrame:
    return control.gates(docs, docs.where("n_chars < 300 AND doc_id % 7 = 0"), "lang").where("gate = 'class_to_zero'").select("lang")


@query("exclusion_report", "documents labels", """WITH d AS (SELECT doc_id, 'too_short' AS reason FROM documents WHERE n_chars < 200), c AS (SELECT doc_id, 'low_quality' AS reason FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'too_short' FROM labels WHERE quality = 0)
SELECT reason, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = c.doc_id AND d.reason = c.reason)) GROUP BY 1""")
def exclusion_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    bad = labels.where("quality = 0")
    confirmed = bad.select("doc_id", F.lit("low_quality").alias("reason")).unionByName(bad.select("doc_id", F.lit("too_short").alias("reason")))
    return control.exclusion_report(docs.where("n_chars < 200").select("doc_id", F.lit("too_short").alias("reason")), confirmed)


@query("baseline_history", "events", "SELECT event_id, user_id, coalesce(event_type <> lag(event_type) OVER w, false) AS changed, lead(1) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def baseline_history(events: DataFrame) -> DataFrame:
    return control.history(events, "user_id", "ts", "event_type").select("event_id", "user_id", "changed", "is_current")


@query("orphan_scan", "lineitem orders", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def orphan_scan(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return control.orphans(lineitem.select(F.col("l_orderkey").alias("key")), orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key")), "key")


@query("unreplayed_tombstones", "documents labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreplayed_tombstones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return control.orphans(docs, labels, "doc_id")


@query("cost_accrual", "events", "SELECT user_id, event_type, sum(value::DECIMAL(18,9))::DOUBLE AS accrued FROM events GROUP BY 1, 2")
def cost_accrual(events: DataFrame) -> DataFrame:
    return control.accrued(events, ["user_id", "event_type"], "value").withColumn("accrued", F.col("accrued").cast("double"))


@query("budget_guard", "events", """WITH a AS (SELECT user_id, sum(value::DECIMAL(18,9)) AS s FROM events GROUP BY 1), t AS (SELECT sum(s) AS w FROM a)
SELECT user_id, CASE WHEN s + 10 > 800 THEN 'pause_kb_cap' WHEN w + 10 > 100000000 THEN 'pause_workspace_cap' ELSE 'allow' END AS decision FROM a, t""")
def budget_guard(events: DataFrame) -> DataFrame:
    by = control.accrued(events, ["user_id"], "value")
    workspace = F.lit(events.agg(F.sum(F.col("value").cast("decimal(18,9)"))).first()[0])
    return control.budget_guard(by, F.lit(800), F.lit(10), F.lit(100000000), workspace).select("user_id", "decision")


@query("cost_running_total", "events", "SELECT event_id, sum(value::DECIMAL(18,6)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM events")
def cost_running_total(events: DataFrame) -> DataFrame:
    return control.running_total(events, "user_id", ["ts", "event_id"], "value").select("event_id", F.col("running").cast("double").alias("running"))


@query("cap_hit_streak", "events", """WITH m AS (SELECT user_id, value > 20 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM m WHERE hit) SELECT user_id, min(i)::INT AS first_row, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
def cap_hit_streak(events: DataFrame) -> DataFrame:
    return control.streaks(events, "user_id", ["ts", "event_id"], F.col("value") > 20)


STATE = "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'claimed' END"


def _jobs(events: DataFrame) -> DataFrame:
    """Events stand for jobs."""
    state = F.element_at(F.array(*(F.lit(x) for x in ("queued", "running", "done", "claimed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(F.col("event_id").alias("job_id"), "user_id", "event_type", state.alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("heartbeat_at"), F.floor("value").cast("long").alias("priority"))


@query("job_dedupe", "events", f"SELECT user_id, event_type, arg_min(event_id, {{'a': ts, 'b': event_id}}) AS job_id FROM events WHERE {STATE} <> 'done' GROUP BY 1, 2")
def job_dedupe(events: DataFrame) -> DataFrame:
    return control.dedupe_jobs(_jobs(events), ["user_id", "event_type"])


@query("job_claim", "events", f"SELECT event_id AS job_id, floor(value)::BIGINT AS priority FROM events WHERE {STATE} = 'queued' ORDER BY floor(value) DESC, ts, event_id LIMIT 1")
def job_claim(events: DataFrame) -> DataFrame:
    return control.claim(_jobs(events)).select("job_id", "priority")


@query("stale_reap", "events", f"SELECT event_id AS job_id FROM events WHERE {STATE} IN ('claimed', 'running') AND ts < (SELECT max(ts) FROM events) - INTERVAL 3600 SECONDS")
def stale_reap(events: DataFrame) -> DataFrame:
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return control.stale(_jobs(events), now, 3600).select("job_id")


@query("upsert_points", "events", "SELECT user_id, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY 1")
def upsert_points(events: DataFrame) -> DataFrame:
    rows = events.select("user_id", "value", F.struct("ts", "event_id").alias("version"))
    return control.upsert(rows.where("version.event_id % 2 = 0"), rows.where("version.event_id % 2 = 1"), "user_id", "version").select("user_id", "value")


@query("snapshot_retention", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAYS")
def snapshot_retention(orders: DataFrame) -> DataFrame:
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    return control.retention(orders.withColumn("created_at", F.col("o_orderdate")), now).select("o_orderkey")


@query("alias_reconcile", "customer supplier", """SELECT coalesce(c.c_custkey, s.s_suppkey) AS kb, CASE WHEN s.s_nationkey IS NULL THEN 'failed_manual' WHEN c.c_nationkey IS NULL THEN 'orphan_record' WHEN c.c_nationkey <> s.s_nationkey THEN 'repair_record' ELSE 'in_sync' END AS state
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def alias_reconcile(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    a = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("kb"), F.col("c_nationkey").alias("target"))
    return control.reconcile(a, supplier.select(F.col("s_suppkey").alias("kb"), F.col("s_nationkey").alias("target")))


PARTS = ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))


@query("inventory_fingerprint", "documents", f"SELECT sha256(concat_ws('|', count(*)::VARCHAR, {PARTS})) AS fingerprint FROM (SELECT sha256(text) AS h FROM documents)")
def inventory_fingerprint(docs: DataFrame) -> DataFrame:
    return control.fingerprint(docs.select(F.sha2("text", 256).alias("h")), "h")


@query("findings_summary", "documents", f"""SELECT count(*) AS n_documents, sum((regexp_matches(text, '{annotate.MOJIBAKE}'))::INT)::BIGINT AS n_mojibake, sum((length(text) < 50)::INT)::BIGINT AS n_near_empty, count(DISTINCT sha256(text)) AS n_distinct FROM documents""")
def findings_summary(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(t.rlike(annotate.MOJIBAKE).cast("long")).alias("n_mojibake"), F.sum((F.length(t) < 50).cast("long")).alias("n_near_empty"), F.countDistinct(F.sha2(t, 256)).alias("n_distinct"))


def active_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants are finite: orders stand for them, four days long."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    return orders.where((F.col("o_orderstatus") != "F") & (F.col("o_orderdate") + F.expr("INTERVAL 4 DAYS") > now)).select("o_orderkey")


QUERIES["active_grants"] = active_grants
SQL["active_grants"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 4 DAYS > (SELECT max(o_orderdate) FROM orders)"
