"""Host-level quality rules, in DataFrame functions only.

Documents get counts and rule failures. Failures are summed by host, each host's failure rate is
shrunk by a beta prior fitted to all hosts' rates by moments, and the host's standing goes back to its
documents: a document that fails a hard rule goes; one that fails a soft rule goes unless its host is
trusted; all of a rejected host's documents go.

Hot hosts cost nothing: sums combine before they move, and the hosts' table is broadcast only when it
is small by count; beyond that both sides are salted.

Defined cases: a null text has no words (and so fails the word rule); a null host is a host of its
own; a null doc_id and repeated rows stay as they are, each row counting once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: Soft rules, in percent: symbols a word, repeated lines, capitals among word characters, words equal to the one before.
MAX_SYMBOL_PCT = 30
MAX_DUP_LINE_PCT = 50
MAX_UPPER_PCT = 50
MAX_ADJACENT_PCT = 50
#: A host's shrunk failure rate below which soft failures are forgiven, and from which all goes.
TRUSTED, REJECTED = 0.02, 0.9
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
BROADCAST_HOSTS = 50_000
SALTS = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text.

    Windows are compared by two 64-bit hashes of their words' hashes. A first look at one hash alone
    spares most texts the sort.
    """
    size = F.size(words)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(F.slice(hashes, i + 1, WINDOW)))

    def marked(w2: Column, w1: Column) -> Column:
        pairs = F.sort_array(F.transform(w1, lambda h, i: F.struct(h.alias("h"), F.get(w2, i).alias("g"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (a["g"] == b["g"])

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

        def positions(s: Column) -> Column:
            kept = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        return let(pairs, lambda s: let(positions(s), covered))

    def found(hashes: Column) -> Column:
        return let(
            windows(hashes),
            lambda w1: F.when(F.size(F.array_distinct(w1)) == F.size(w1), F.lit(0).cast("long")).otherwise(
                let(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(1))), lambda other: let(windows(other), lambda w2: marked(w2, w1)))
            ),
        )

    return F.when(size < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), found))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """One narrow row per document: its counts and what it fails; ``carry`` adds the whole row as ``doc``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = [F.struct(*docs.columns).alias("doc")] if carry else []
    kept = ["doc"] if carry else []
    base = docs.select(*whole, F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    got = base.select(
        *kept,
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_adjacent"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    flat = got.withColumn("n_lines", F.col("lines.n").cast("long")).withColumn("n_dup_lines", F.col("lines.dup").cast("long")).drop("lines")
    hard = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines")) | (100 * F.col("n_upper") > MAX_UPPER_PCT * F.col("word_chars")) | (100 * F.col("n_adjacent") > MAX_ADJACENT_PCT * F.col("n_words"))
    return flat.withColumn("base_failed", hard).withColumn("soft_failed", soft)


def hosts(found: DataFrame) -> DataFrame:
    """Each host's documents, failures and shrunk failure rate; the prior's two numbers pass the driver."""
    failed = F.col("base_failed") | F.col("soft_failed")
    by = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    m, v = by.agg(F.avg(rate), F.coalesce(F.var_pop(rate), F.lit(0.0))).first()
    m = min(max(m or 0.0, 1e-6), 1 - 1e-6)
    weight = MOST_WEIGHT if not v else min(max(m * (1 - m) / v - 1, LEAST_WEIGHT), MOST_WEIGHT)
    return by.withColumn("shrunk_rate", (F.col("k") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """Counts, failures, the host's shrunk rate and the verdict of every document."""
    found = materialize(counts(docs, id_col, text_col, host_col, carry), "rules-counts")
    by = materialize(hosts(found).select(F.coalesce("host", F.lit("")).alias("host_key"), F.col("host").isNull().alias("host_null"), "shrunk_rate"), "rules-hosts")
    left = found.withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("host_null", F.col("host").isNull())
    keys = ["host_key", "host_null"]
    if by.count() <= BROADCAST_HOSTS:
        joined = left.join(F.broadcast(by), keys)
    else:
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS))
        joined = left.withColumn("salt", salt).join(by.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "salt"]).drop("salt")
    gone = F.col("base_failed") | (F.col("shrunk_rate") >= REJECTED) | (F.col("soft_failed") & (F.col("shrunk_rate") >= TRUSTED))
    return joined.drop(*keys).withColumn("kept", ~gone)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
         FROM w, unnest(range(1, len(words) - {WINDOW} + 2)) AS u(i) WHERE len(words) >= {WINDOW}),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS g FROM twice),
rep AS (SELECT doc_id, sum(g) AS n FROM covered GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
f AS (SELECT w.doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(list_filter(words, lambda x, i: i > 1 AND words[i - 1] = x)) AS n_adjacent
      FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
      100 * n_symbols > {MAX_SYMBOL_PCT} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines OR 100 * n_upper > {MAX_UPPER_PCT} * word_chars
      OR 100 * n_adjacent > {MAX_ADJACENT_PCT} * n_words AS soft_failed FROM f),
h AS (SELECT host, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS k FROM r GROUP BY host),
p AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v = 0 THEN {MOST_WEIGHT} ELSE least(greatest(m * (1 - m) / v - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) END AS wt FROM p),
s AS (SELECT host, (k + m * wt) / (n + wt) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate >= {REJECTED} OR (soft_failed AND rate >= {TRUSTED})) AS kept
FROM r JOIN s ON r.host IS NOT DISTINCT FROM s.host
"""
