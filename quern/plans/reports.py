"""Queries of a run's reports: statistics by class, findings, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import decompose, dedup, reports, stats
from quern.plans.documents import BLOCKS, COMPONENTS
from quern.plans.engine import CODES, _parsed, _regions, sql_pick
from quern.plans.planning import COUNT
from quern.plans.registry import query

STATUS = ["failed", "excluded_pre_parse", "parsed"]
_P = f"p AS (SELECT doc_id, {sql_pick('doc_id', CODES)} AS code, {sql_pick('doc_id', STATUS)} AS status FROM documents)"


def _listed(m: str) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias(m)


def _sql_map(of: str, name: str, where: str = "true") -> str:
    return f"{name}_ AS (SELECT segment_type, string_agg(k || ':' || n, ',' ORDER BY k) AS {name} FROM (SELECT segment_type, {of} AS k, count(*) AS n FROM s WHERE {where} GROUP BY 1, 2) GROUP BY 1)"


def _sql_words(p: int) -> str:
    """Exclusive quantiles of sorted words ``w``, and below four values the greatest, but the median as it is."""
    at = f"greatest(1, least(floor({p / 100}::DOUBLE * (n + 1))::INT, n - 1))::INT"
    few = "n < 4" if p != 50 else "false"
    return f"round(CASE WHEN {few} THEN w[n]::DOUBLE WHEN n = 1 THEN w[1] ELSE w[{at}] + ({p / 100}::DOUBLE * (n + 1) - {at}) * (w[{at} + 1] - w[{at}]) END, 6)"


# A table's columns are the parts between its bars, less one, so a bar at both ends gives one more than there are cells.
@query("corpus_stats", "documents labels", f"""WITH s0 AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'heading' WHEN 2 THEN 'prose' ELSE source END AS segment_type, doc_id % 5 AS depth, coalesce(lang, 'und') AS language,
CASE quality WHEN 0 THEN 'excluded' WHEN 1 THEN 'primary' ELSE 'supporting' END AS tier, CASE WHEN doc_id % 3 = 0 THEN (n_chars % 1000) / 1000.0 END AS c,
CASE WHEN doc_id % 7 = 0 THEN '| a | b |' || chr(10) || '|--|--|' || repeat(chr(10) || '| c | x |', doc_id % 3) ELSE text END AS text FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)),
s AS (SELECT *, {COUNT} AS t, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND NOT regexp_full_match(x, '[-|+: ]*'))) || 'x' || (len(string_split(string_split(text, chr(10))[1], '|')) - 1) AS shape FROM s0),
e AS (SELECT segment_type, count(*) AS segment_count, segment_type IN ('prose', 'heading') OR avg(depth) >= 2 AS has_headings FROM s GROUP BY 1),
w AS (SELECT segment_type, count(*) AS n, round(sum(t) / count(*), 6) AS mean_tokens, list_sort(list(t::DOUBLE)) AS w FROM s WHERE text IS NOT NULL GROUP BY 1),
ws AS (SELECT segment_type, n AS text_count, w[1]::BIGINT AS min_tokens, w[n]::BIGINT AS max_tokens, mean_tokens, {_sql_words(50)} AS median_tokens, {_sql_words(75)} AS p75_tokens, {_sql_words(90)} AS p90_tokens, {_sql_words(95)} AS p95_tokens FROM w),
o AS (SELECT segment_type, count(*) AS n, sum(c::DECIMAL(20,12))::DOUBLE / count(*) AS m, list_sort(list(c::DOUBLE)) AS v, greatest(1, least(floor(0.1::DOUBLE * (count(*) + 1))::INT, count(*) - 1))::INT AS j FROM s WHERE c IS NOT NULL GROUP BY 1),
os AS (SELECT segment_type, n AS ocr_count, round(m, 6) AS ocr_mean, round(CASE WHEN n < 10 THEN v[1] ELSE v[j] + (0.1::DOUBLE * (n + 1) - j) * (v[j + 1] - v[j]) END, 6) AS ocr_p10, round(v[1], 6) AS ocr_min FROM o),
{_sql_map('shape', 'table_shapes', "segment_type = 'table'")}, {_sql_map('language', 'languages')}, {_sql_map('tier', 'tiers')}
SELECT * FROM e LEFT JOIN ws USING (segment_type) LEFT JOIN os USING (segment_type) LEFT JOIN table_shapes_ USING (segment_type) LEFT JOIN languages_ USING (segment_type) LEFT JOIN tiers_ USING (segment_type)""")
def corpus_stats(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents stand for segments of their source's class; some are headings, prose, or tables of up to three rows."""
    i, q = F.col("doc_id"), F.col("quality")
    kind = F.when(i % 7 == 0, "table").when(i % 7 == 1, "heading").when(i % 7 == 2, "prose").otherwise(F.col("source"))
    cells = F.concat(F.lit("| a | b |\n|--|--|"), F.array_join(F.array_repeat(F.lit("\n| c | x |"), (i % 3).cast("int")), ""))
    tier = F.when(q == 0, "excluded").when(q == 1, "primary").otherwise("supporting")
    own = docs.join(labels.select("doc_id", "quality").distinct(), "doc_id", "left")
    found = own.select("doc_id", kind.alias("segment_type"), F.when(i % 7 == 0, cells).otherwise(F.col("text")).alias("text"), F.col("lang").alias("language"), tier.alias("salience_tier"), F.when(i % 3 == 0, (F.col("n_chars") % 1000) / 1000.0).alias("ocr_confidence"))
    return reports.corpus_stats(found, i % 5).withColumns({m: _listed(m) for m in ("table_shapes", "languages", "tiers")})


@query("corpus_findings", "documents labels", f"""WITH RECURSIVE {COMPONENTS}, b AS (WITH {BLOCKS} SELECT * FROM known), {_P}, every AS (SELECT count(*) AS n FROM documents),
f AS (SELECT 'documents' AS figure, '' AS key, n::DOUBLE AS value FROM every UNION ALL SELECT 'parse_status', status, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'invisible_content', '', count(*) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'documents_with_injection', '', count(DISTINCT doc_id) FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT 'version_families', '', count(DISTINCT label) FROM label UNION ALL SELECT 'boilerplate_blocks', '', count(*) FROM b
UNION ALL SELECT 'language_fraction', coalesce(lang, 'und'), round(sum(0.75::DECIMAL(20,12))::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents), 4) FROM documents WHERE lang IS NOT NULL AND lang <> 'und' GROUP BY 2
UNION ALL SELECT 'language_fraction', 'und', round(sum(CASE WHEN lang IS NULL OR lang = 'und' THEN 1 ELSE 0.25 END::DECIMAL(20,12))::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents), 4) FROM documents
UNION ALL SELECT 'language_warning', lang, 1 FROM documents WHERE lang NOT IN ('en', 'und') GROUP BY 2 HAVING round(count(*) / (SELECT n FROM every), 4) >= 0.02)
SELECT * FROM f""")
def corpus_findings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Families and blocks are found; every third of a text's languages is unknown, and every second text hides something."""
    i, lang = F.col("doc_id"), F.coalesce("lang", F.lit("und"))
    scored = docs.select("doc_id", F.when(i % 11 == 0, 0.5).otherwise(0.0).alias("injection_suspicion"))
    shares = docs.select("doc_id", lang.alias("language"), F.lit(0.75).alias("fraction")).unionByName(docs.select("doc_id", F.lit("und").alias("language"), F.lit(0.25).alias("fraction")))
    return reports.findings(_parsed(docs), scored, dedup.members(docs)[0], dedup.boilerplate(docs), docs.where(i % 2 == 0), shares, stats.language_support(docs, lang, ("en",)))


@query("exclusion_entries", "documents labels", f"""WITH RECURSIVE {COMPONENTS}, {_P}, g AS (SELECT doc_id, 'reg-' || doc_id || '-' || o AS region_id FROM documents, unnest([0, 1, 2]) AS u(o) WHERE doc_id % 5 <> 0),
r AS (SELECT p.doc_id, region_id, coalesce(reason, CASE WHEN status = 'failed' THEN 'parse_failed' ELSE 'other' END) AS reason, coalesce(region_id, 'doc-level') AS k, NULL::BIGINT AS primary_doc
FROM p LEFT JOIN g ON g.doc_id = p.doc_id LEFT JOIN (VALUES {', '.join(f"('{c}', '{r}')" for c, r in decompose.EMPTY)}) v(c, reason) ON c = code WHERE status <> 'parsed'
UNION ALL SELECT node, NULL, 'superseded_version', 'superseded', primary_doc FROM label JOIN best USING (label) WHERE node <> primary_doc),
said AS (SELECT DISTINCT doc_id, 'parse_failed' AS reason FROM labels WHERE quality = 0)
SELECT 'excl-' || substr(sha256(doc_id || ':excl:' || k), 1, 24) AS exclusion_id, doc_id, region_id, CASE WHEN reason IN ('other', 'too_short', 'empty_region', 'duplicate') THEN 'segment' ELSE 'document' END AS scope, reason, primary_doc::VARCHAR AS primary_doc, false AS from_plan FROM r
UNION ALL SELECT 'plan-' || doc_id || '-' || reason, doc_id, NULL, 'document', reason, NULL, true FROM said WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = said.doc_id AND r.reason = said.reason)""")
def exclusion_entries(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that were not parsed, members of families that others stand for, and a plan's decisions."""
    first = reports.superseded_by(dedup.members(docs)[0])
    old = decompose._excluded(first, "superseded", "superseded_version").withColumn("region_id", F.lit(None).cast("string"))
    records = decompose.empty_sets(_parsed(docs), _regions(docs)).unionByName(old)
    confirmed = labels.where("quality = 0").select("doc_id", F.lit("parse_failed").alias("reason"))
    return reports.exclusions(records, confirmed, first).drop("user_action").withColumn("primary_doc", F.col("primary_doc").cast("string"))
