"""What a run reports, as tables: statistics of every segment class, the corpus's findings, and each exclusion with its scope.

Each function takes the tables that earlier passes leave and counts them where they are; results have a row for each class, figure or
exclusion. Confidences have about as many values as rows, so their quantile comes from running sums in two levels.

Defined cases: segments without a class are class ``unknown``; a class without any text has null lengths, one without confidences null
confidences; a table without a line of cells has no shape; a plan's repeated decisions are one; empty tables give no rows, and
counts of 0 among the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lifecycle, ordered, stats

# Reasons that leave out a whole document; others leave out a part of it.
DOCUMENT_REASONS = ("superseded_version", "unservable_content", "spreadsheet_database", "spreadsheet_model", "encrypted", "parse_failed")
# How many confidences a tenth percentile needs; with fewer it is the least of them.
LEAST_OCR = 10


def shape(t: Column) -> Column:
    """``rows x columns`` of a piped table as text, null where no line has cells; separators are no rows, but may give the columns."""
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n", -1), lambda x: T.strip(x)), lambda x: x.contains("|"))
    wide = F.greatest(F.lit(1), F.size(F.split(F.get(lines, F.lit(0)), r"\|", -1)) - 1)
    return F.when(F.size(lines) > 0, F.concat_ws("x", F.size(F.filter(lines, lambda x: ~x.rlike(r"^[-|+: ]*$"))).cast("string"), wide.cast("string")))


def ocr_stats(found: DataFrame) -> DataFrame:
    """segment_type, and count, mean, tenth percentile (exclusive) and minimum of its confidences."""
    hist = found.where("ocr_confidence IS NOT NULL").groupBy("segment_type", F.col("ocr_confidence").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    per = hist.groupBy("segment_type").agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.sum(F.col("v").cast("decimal(20,12)") * F.col("c")).alias("total"))
    place = F.greatest(F.lit(1), F.least(F.floor(F.lit(0.1) * (F.col("n") + 1)), F.col("n") - 1))
    at = ordered.sums(hist, "segment_type", ["v"], {"s": F.col("c")}).join(per.select("segment_type", "n"), "segment_type")
    two = at.groupBy("segment_type").agg(*(F.min(F.when(F.col("s") >= place + d, F.col("v"))).alias(f"v{d}") for d in (0, 1)))
    p10 = F.when(F.col("n") < LEAST_OCR, F.col("least")).otherwise(F.col("v0") + (F.lit(0.1) * (F.col("n") + 1) - place) * (F.col("v1") - F.col("v0")))
    return per.join(two, "segment_type").select("segment_type", F.col("n").alias("ocr_count"), F.round(F.col("total").cast("double") / F.col("n"), 6).alias("ocr_mean"), F.round(p10, 6).alias("ocr_p10"), F.round("least", 6).alias("ocr_min"))


def corpus_stats(segments: DataFrame, depth: Column) -> DataFrame:
    """One row for each class of segments (segment_type, text, language, salience_tier and, if known, ocr_confidence).

    Number of segments; count, extremes, mean and quantiles of words; whether the class has headings above it (``depth``); how often each
    shape of table, language and tier occurs, as maps; confidences. Maps hold as many entries as there are values.
    """
    c = segments.withColumn("segment_type", F.coalesce("segment_type", F.lit("unknown"))).withColumn("path_depth", depth)
    if "ocr_confidence" not in c.columns:
        c = c.withColumn("ocr_confidence", F.lit(None).cast("double"))
    every = c.groupBy("segment_type").agg(F.count(F.lit(1)).alias("segment_count"))
    words = stats.class_stats(c.where("text IS NOT NULL"), "segment_type", T.word_count(F.col("text"))).withColumnRenamed("segment_count", "text_count")
    tables = lifecycle.count_map(c.where("segment_type = 'table'").withColumn("shape", shape(F.col("text"))).where("shape IS NOT NULL"), "segment_type", "shape", "table_shapes")
    maps = [lifecycle.count_map(c.withColumn(of, F.coalesce(of, F.lit(other))), "segment_type", of, name) for of, name, other in (("language", "languages", "und"), ("salience_tier", "tiers", "supporting"))]
    out = every.join(lifecycle.heading_structure(c).select("segment_type", F.col("has_structure").alias("has_headings")), "segment_type")
    for part in (words, tables, *maps, ocr_stats(c)):
        out = out.join(part, "segment_type", "left")
    return out


def findings(parsed: DataFrame, segments: DataFrame, members: DataFrame, blocks: DataFrame, invisible: DataFrame, shares: DataFrame, support: DataFrame) -> DataFrame:
    """figure, key and value of a corpus's findings.

    ``parsed``: parse_status of each document; ``segments``: doc_id and injection_suspicion; ``members``: label of each member of a family;
    ``blocks``: boilerplate; ``invisible``: a row for each detection; ``shares``: doc_id, language and fraction of each
    document; ``support``: language and decision. Fractions are means over documents that have any.
    """
    def one(figure: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(F.lit(figure).alias("figure"), F.lit("").alias("key"), "value")

    def by(figure: str, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.lit(figure).alias("figure"), F.col(key).alias("key"), F.col("value").cast("double").alias("value"))

    n = F.count(F.lit(1))
    status = parsed.groupBy(F.coalesce("parse_status", F.lit("unknown")).alias("status")).agg(n.alias("value"))
    with_any = shares.agg(F.countDistinct("doc_id").alias("n"))
    mean = shares.groupBy(F.coalesce("language", F.lit("und")).alias("language")).agg(F.sum(F.col("fraction").cast("decimal(20,12)")).cast("double").alias("f")).join(F.broadcast(with_any), F.col("n") > 0)  # one row
    parts = [
        one("documents", parsed, n), by("parse_status", status, "status"), one("invisible_content", invisible, n),
        one("documents_with_injection", segments.where("injection_suspicion > 0").select("doc_id").distinct(), n),
        one("version_families", members.select("label").distinct(), n), one("boilerplate_blocks", blocks, n),
        by("language_fraction", mean.select("language", F.round(F.col("f") / F.col("n"), 4).alias("value")), "language"),
        by("language_warning", support.where("decision <> 'supported'").select("language", F.lit(1).alias("value")), "language"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def superseded_by(members: DataFrame) -> DataFrame:
    """doc_id and primary_doc of every member of a family that is not its primary; ``members`` as ``dedup.members`` gives them."""
    best = members.groupBy("label").agg(F.max_by("node", "content_hash").alias("primary_doc"))
    return members.join(best, "label").where("node <> primary_doc").select(F.col("node").alias("doc_id"), "primary_doc")


def exclusions(records: DataFrame, confirmed: DataFrame, primaries: DataFrame) -> DataFrame:
    """Every exclusion once: scope, what a user may do, and of a superseded document the one that stands for it.

    ``records``: exclusion_id, doc_id, region_id and reason, from the decomposition. ``confirmed``: doc_id, reason and, if known, remediation
    of a plan; only what the records lack is added, under an id of its own. ``primaries``: doc_id and primary_doc.
    """
    known = F.create_map(*(F.lit(x) for kv in lifecycle.REMEDIES.items() for x in kv))
    own = records.select("exclusion_id", "doc_id", "region_id", F.coalesce("reason", F.lit("other")).alias("reason"), F.lit(None).cast("string").alias("remediation"), F.lit(False).alias("from_plan"))
    said = confirmed if "remediation" in confirmed.columns else confirmed.withColumn("remediation", F.lit(None).cast("string"))
    plan = said.groupBy("doc_id", F.coalesce("reason", F.lit("other")).alias("reason")).agg(F.min("remediation").alias("remediation")).join(own.select("doc_id", "reason").distinct(), ["doc_id", "reason"], "left_anti")
    named = plan.select(F.concat_ws("-", F.lit("plan"), F.col("doc_id").cast("string"), "reason").alias("exclusion_id"), "doc_id", F.lit(None).cast("string").alias("region_id"), "reason", "remediation", F.lit(True).alias("from_plan"))
    every = own.unionByName(named).join(primaries.select("doc_id", "primary_doc"), "doc_id", "left")
    action = F.coalesce("remediation", F.element_at(known, F.when(F.col("reason").isin(*lifecycle.REMEDIES), F.col("reason")).otherwise("other")))
    first = F.when((F.col("reason") == "superseded_version") & ~F.col("from_plan"), F.col("primary_doc"))
    scope = F.when(F.col("reason").isin(*DOCUMENT_REASONS), "document").otherwise("segment")
    return every.select("exclusion_id", "doc_id", "region_id", scope.alias("scope"), "reason", action.alias("user_action"), first.alias("primary_doc"), "from_plan")
