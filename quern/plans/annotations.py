"""Queries of the annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import PY_SPACE
from quern.operators import annotate as A
from quern.plans.registry import query


def _script(t: str) -> str:
    cases = " ".join(f"WHEN len(regexp_extract_all(substr({t}, 1, {A.SCRIPT_CHARS}), '{p}')) >= {A.SCRIPT_SHARE} * length(substr({t}, 1, {A.SCRIPT_CHARS})) THEN '{c}'" for c, p in A.SCRIPTS)
    return f"CASE WHEN length({t}) = 0 THEN NULL {cases} END"


def _vote(source: str) -> str:
    """CTEs that end in vote(id, code)."""
    lexicon = ", ".join(f"({k}, '{c}', '{w}')" for k, (c, ws) in enumerate(A.LEXICON.items()) for w in dict.fromkeys(ws.split()))
    edge = A.EDGE.replace("'", "''")
    return f"""lexicon(pri, code, w) AS (VALUES {lexicon}),
words AS (SELECT id, regexp_replace(x, '^[{edge}]+|[{edge}]+$', '', 'g') AS w FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[{PY_SPACE}]+')) AS x FROM ({source}))),
good AS (SELECT id, w FROM words WHERE regexp_matches(w, '^\\p{{L}}+$')),
tot AS (SELECT id, count(*) AS n FROM good GROUP BY id),
hit AS (SELECT g.id, pri, code, count(*) AS h FROM (SELECT DISTINCT id, w FROM good) g JOIN lexicon USING (w) GROUP BY 1, 2, 3),
top AS (SELECT id, arg_max(code, h * 100 - pri) AS code, max(h) AS h FROM hit GROUP BY id),
vote AS (SELECT top.id, code FROM top JOIN tot USING (id) WHERE n >= {A.MIN_WORDS} AND h >= {A.RATIO} * n)"""


@query("script_language", "documents", f"SELECT doc_id, coalesce({_script('text')}, 'latin') AS script FROM documents")
def script_language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(A.script(F.col("text")), F.lit("latin")).alias("script"))


DOCS = "SELECT doc_id AS id, text FROM documents"
TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query("stopword_language", "documents", f"WITH {_vote(DOCS)} SELECT d.doc_id, coalesce({_script('text')}, code, 'und') AS language FROM documents d LEFT JOIN vote ON vote.id = d.doc_id")
def stopword_language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", A.language(F.col("text")).alias("language"))


@query("turn_language", "conversations", f"WITH {_vote(TURNS)} SELECT c.conv_id, c.turn, coalesce({_script('text')}, code, 'und') AS language FROM conversations c LEFT JOIN vote ON vote.id = c.conv_id * 1000 + c.turn")
def turn_language(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", A.language(F.col("text")).alias("language"))


@query("language_confusion", "documents", f"WITH {_vote(DOCS)} SELECT lang, coalesce({_script('text')}, code, 'und') AS language, count(*) AS n FROM documents d LEFT JOIN vote ON vote.id = d.doc_id GROUP BY 1, 2")
def language_confusion(docs: DataFrame) -> DataFrame:
    return docs.select("lang", A.language(F.col("text")).alias("language")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


WEIGHT = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0.0 END::DOUBLE" for _, w, p in A.INJECTION)
SCORE = f"CASE WHEN {WEIGHT} > 0 THEN round(1 - exp(-({WEIGHT}) * least(1.0, ln(501.0) / ln(1 + length(text)))), 4) ELSE 0.0 END"


@query("injection_scores", "documents", f"SELECT doc_id, {SCORE}::DOUBLE AS injection_suspicion FROM documents")
def injection_scores(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", A.injection_score(F.col("text")).alias("injection_suspicion"))


@query("injection_turns", "conversations", f"SELECT conv_id, turn, {SCORE}::DOUBLE AS injection_suspicion FROM conversations")
def injection_turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", A.injection_score(F.col("text")).alias("injection_suspicion"))


@query("role_marker_turns", "conversations", "SELECT conv_id, turn, regexp_matches(role || ': ' || text, '(?im)^(system|assistant|user)\\s*:') AS has_marker FROM conversations")
def role_marker_turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").rlike(A.INJECTION[2][2]).alias("has_marker"))


@query("secret_scan", "documents", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in A.DENYLIST) + ") AS findings FROM documents")
def secret_scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", A.denylist(F.col("text")).alias("findings"))




#: What few texts of the test tables hold, put at the end of some of them so that there is something to find.
PLANTED = [" \ufffd", " \u00e2\u20acx", " \x01", " see section 4.2", " aB3dE5fG7hI9jK1lM2nO4pQ6", " as shown in Table 3", " Refer to appendix C"]


def planted(rows: DataFrame, key: str, col: str) -> DataFrame:
    more = F.element_at(F.array(*(F.lit(x) for x in PLANTED)), (F.col(key) % 13 + 1).cast("int"))
    return rows.withColumn(col, F.when(F.col(key) % 13 < len(PLANTED), F.concat(F.col(col), more)).otherwise(F.col(col)))


def sql_planted(name: str, key: str, col: str) -> str:
    return f"(SELECT {key}, {col} || CASE {key} % 13 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PLANTED)) + f" ELSE '' END AS {col} FROM {name})"


DOCS_PLANTED = sql_planted("documents", "doc_id", "text")

ISSUES = f"""SELECT {{0}}, 'replacement_chars' AS kind, 'medium' AS severity FROM {{1}} WHERE contains({{2}}, chr(65533))
UNION ALL SELECT {{0}}, 'mojibake', 'low' FROM {{1}} WHERE regexp_matches({{2}}, '{A.MOJIBAKE}')
UNION ALL SELECT {{0}}, 'control_chars', 'low' FROM {{1}} WHERE regexp_matches({{2}}, '{A.CONTROL.replace("{", "{{").replace("}", "}}")}')"""


@query("token_entropy", "documents", f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\\s,;:"''\\[\\]{{}}()]+'), lambda x: length(x) >= 20)) AS token FROM {DOCS_PLANTED}),
h AS (SELECT doc_id, token, length(token) AS s, map_values(list_histogram(string_split(token, ''))) AS ns FROM t)
SELECT doc_id, token, round(-list_sum(list_transform(ns, lambda n: n / s * log2(n / s))), 6) AS bits FROM h WHERE bits >= 4.5""")
def token_entropy(docs: DataFrame) -> DataFrame:
    return A.suspect_tokens(planted(docs, "doc_id", "text"))


@query("encoding_issues", "documents", ISSUES.format("doc_id", DOCS_PLANTED, "text"))
def encoding_issues(docs: DataFrame) -> DataFrame:
    return A.encoding_issues(planted(docs, "doc_id", "text"))


@query("page_encoding_issues", "pages", ISSUES.format("page_id", sql_planted("pages", "page_id", "html"), "html"))
def page_encoding_issues(pages: DataFrame) -> DataFrame:
    return A.encoding_issues(planted(pages, "page_id", "html"), "page_id", "html")


@query("extraction_quality", "documents", """SELECT doc_id, n_pages, round(0.7::DOUBLE * least(1.0, mean / 200.0) + 0.3::DOUBLE * (1 - empty / n_pages) + 1e-9, 4) AS overall, round(rich / n_pages + 1e-9, 4) AS text_extraction_ratio, rich / n_pages < 0.2 AS near_empty
FROM (SELECT doc_id, count(*) AS n_pages, avg(length(l)) AS mean, sum((length(l) = 0)::INT) AS empty, sum((length(l) > 50)::INT) AS rich FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1)""")
def extraction_quality(docs: DataFrame) -> DataFrame:
    """Each line stands for a page."""
    return A.extraction_quality(docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")), "doc_id", F.length("l"))


S = f"regexp_replace(l, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')"


@query("heading_lines", "documents", f"""WITH l AS (SELECT doc_id, {S} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
SELECT doc_id, count(*) AS n_lines, sum((s <> '' AND length(s) <= 120 AND NOT regexp_matches(s, '[.?!]$') AND (regexp_matches(s, '{A.HEADING}') OR (upper(s) = s AND lower(s) <> s AND length(s) >= 4) OR length(s) <= 60))::INT)::BIGINT AS n_headings FROM l GROUP BY 1""")
def heading_lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(A.is_heading(F.col("l")).cast("long")).alias("n_headings"))


@query("cross_reference_candidates", "documents", f"SELECT doc_id, regexp_extract(text, '{A.CROSS_REFERENCE}', 0) AS target FROM {DOCS_PLANTED} WHERE regexp_matches(text, '{A.CROSS_REFERENCE}')")
def cross_reference_candidates(docs: DataFrame) -> DataFrame:
    return planted(docs, "doc_id", "text").where(F.col("text").rlike(A.CROSS_REFERENCE)).select("doc_id", F.regexp_extract("text", A.CROSS_REFERENCE, 0).alias("target"))


@query("salience_override", "lineitem", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.60 THEN 'excluded' WHEN l_discount * 10 < 0.80 THEN 'supporting' ELSE 'primary' END AS salience_tier, (1 + (l_discount * 10 < 0.80)::INT)::INT AS n_signals FROM lineitem""")
def salience_override(lineitem: DataFrame) -> DataFrame:
    """Discounts stand for OCR confidences."""
    start = F.array(F.struct(F.lit("segment_type").alias("kind"), F.lit("primary").alias("implied_tier"), F.lit(True).alias("won")))
    rows = lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("ocr_confidence"), F.lit("primary").alias("salience_tier"), start.alias("salience_signals"))
    return A.salience(rows).select("l_orderkey", "l_linenumber", "salience_tier", F.size("salience_signals").alias("n_signals"))


@query("sheet_triage", "orders lineitem", """SELECT o_orderkey, CASE WHEN f / n >= 0.30 THEN 'model' WHEN s = 1 AND n >= 2 THEN 'database' ELSE 'report' END AS triage
FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS f, count(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1)""")
def sheet_triage(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders stand for workbooks and their lines for cells."""
    by = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("formula_cells"), F.countDistinct("l_linestatus").alias("n_sheets"))
    return A.sheet_triage(by.withColumn("n_rows", F.col("cells") * 25).withColumn("uniform", F.lit(True))).select("o_orderkey", "triage")
