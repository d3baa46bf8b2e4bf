"""Segments as one pass: scanned regions, salience, boilerplate, taxonomy, language, injection, superseded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids
from quern.operators import annotate, dedup, segments
from quern.session import materialize

# Lines that decide on boilerplate; confidences below which scanned text is left out, or only supports.
BOILERPLATE_LINES, BOILERPLATE_SHARE = 3, 0.70
OCR_FLOOR, OCR_WARN = 0.60, 0.80
# Kinds of signals.
PRIOR, FLOOR, WARN, BLOCK, OLD = "segment_type_prior", "ocr_confidence_floor", "ocr_confidence_warn", "boilerplate_detection", "superseded_version"
# Why a document gives no segments, by its findings, in order.
EMPTY = [
    ("password_protected", "encrypted"),
    ("unservable_image_only", "unservable_content"),
    ("unservable_audio", "unservable_content"),
    ("unservable_video", "unservable_content"),
    ("unservable_cad", "unservable_content"),
    ("spreadsheet_database_excluded", "spreadsheet_database"),
    ("spreadsheet_model_excluded", "spreadsheet_model"),
]
SIGNAL = "struct<kind:string,implied_tier:string,won:boolean,detail:string>"


def ocr_regions(regions: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Scanned regions below the confidence that are one segment each, and those that are still to be cut."""
    low = F.col("ocr_confidence").isNotNull() & (F.col("ocr_confidence") < segments.OCR_WHOLE)
    whole = regions.where(low).select(id_col, "ord", F.lit("scanned_region").alias("segment_type"), "text", "ocr_confidence")
    return whole, regions.where(~F.coalesce(low, F.lit(False)))


def signal(kind: str, tier: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), tier.alias("implied_tier"), F.lit(True).alias("won"), detail.alias("detail"))


def initial(found: DataFrame) -> DataFrame:
    """Tier and signal that a segment's type gives it."""
    tier = F.coalesce(annotate.tier(F.col("segment_type")), F.lit("supporting"))
    own = signal(PRIOR, tier, F.concat(F.lit("by its type: "), F.coalesce("segment_type", F.lit("none"))))
    return found.withColumn("salience_tier", tier).withColumn("salience_basis", F.lit(PRIOR)).withColumn("salience_signals", F.array(own).cast(f"array<{SIGNAL}>"))


def override(found: DataFrame, hit: Column, tier: str | Column, basis: str, kind: str | None = None, detail: Column | None = None) -> DataFrame:
    """Another tier for the segments that ``hit`` marks; their old signals stay, marked as lost, and the new one has won."""
    tier = F.lit(tier) if isinstance(tier, str) else tier
    lost = F.transform("salience_signals", lambda s: s.withField("won", F.lit(False)))
    now = F.array_append(lost, signal(basis, tier, F.lit(None).cast("string") if detail is None else detail).cast(SIGNAL))
    out = found.withColumn("hit_now", F.coalesce(hit, F.lit(False)))
    for c, x in (("salience_signals", now), ("salience_tier", tier), ("salience_basis", F.lit(basis)), *([("segment_type", F.lit(kind))] if kind else [])):
        out = out.withColumn(c, F.when(F.col("hit_now"), x).otherwise(F.col(c)))
    return out.drop("hit_now")


def scanned(found: DataFrame) -> DataFrame:
    """Segments of scanned text: left out below ``OCR_FLOOR``, supporting below ``OCR_WARN``; other segments stay."""
    c = F.col("ocr_confidence")
    said = F.format_string("confidence %.4f", c)
    return override(override(found, c < OCR_FLOOR, "excluded", FLOOR, detail=said), (c >= OCR_FLOOR) & (c < OCR_WARN), "supporting", WARN, detail=said)


def boilerplate_segments(found: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of segments whose text is a known block, or of whose three lines or more seven in ten are: one pass over the texts, only ids come back."""
    hits = dedup.known_lines(found, "segment_id", known)
    return hits.where(F.col("whole") | ((F.col("n") >= BOILERPLATE_LINES) & (F.col("k") >= BOILERPLATE_SHARE * F.col("n")))).select("segment_id")


def retype_boilerplate(found: DataFrame, known: DataFrame) -> DataFrame:
    """Segments that are boilerplate get its type and tier. Their ids are written first, so that few are broadcast."""
    marked = found.join(materialize(boilerplate_segments(found, known), "boilerplate-segments").withColumn("is_block", F.lit(True)), "segment_id", "left")
    return override(marked, F.col("is_block"), "boilerplate", BLOCK, "boilerplate", F.lit("a block of many documents")).drop("is_block")


def promote_types(found: DataFrame) -> DataFrame:
    """A region's hint promotes a segment's type; tier, basis and a winning signal of the new type follow, unless OCR has set the tier."""
    out = found.withColumn("new_type", annotate.taxonomy(F.col("segment_type"), F.col("region_hint")))
    moved = (F.col("new_type") != F.col("segment_type")) & ~F.col("salience_basis").isin(FLOOR, WARN)
    out = override(out, moved, F.coalesce(annotate.tier(F.col("new_type")), F.lit("supporting")), PRIOR, detail=F.concat(F.lit("by its region's hint: "), "region_hint"))
    return out.withColumn("segment_type", F.col("new_type")).drop("new_type")


def superseded(found: DataFrame, roles: DataFrame, index_superseded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments and exclusions once superseded documents are known: left out, or kept at the excluded tier."""
    old = roles.where("dedup_role = 'superseded'").select("doc_id")
    if index_superseded:
        marked = found.join(old.withColumn("is_old", F.lit(True)), "doc_id", "left")
        return override(marked, F.col("is_old"), "excluded", OLD).drop("is_old"), _excluded(old.limit(0), "superseded", "superseded_version")
    return found.join(old, "doc_id", "left_anti"), _excluded(old, "superseded", "superseded_version")


def _excluded(docs: DataFrame, suffix: str, reason: str) -> DataFrame:
    return docs.select(ids.exclusion_id(F.col("doc_id").cast("string"), F.lit(suffix)).alias("exclusion_id"), "doc_id", F.lit(reason).alias("reason"))


def empty_reason(findings: Column, status: Column) -> Column:
    """Why a document without segments has none: the first finding of the order, else how it was parsed."""
    out = F.when(status == "failed", "parse_failed").otherwise("other")
    for code, reason in reversed(EMPTY):
        out = F.when(F.array_contains(findings, code), reason).otherwise(out)
    return out


def empty_sets(parsed: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Exclusions of documents (doc_id, findings, parse_status) that failed or were excluded: one for each region (doc_id, region_id), or one for a document without any."""
    bad = parsed.where(F.col("parse_status").isin("failed", "excluded_pre_parse")).select("doc_id", empty_reason(F.col("findings"), F.col("parse_status")).alias("reason"))
    known = bad.withColumn("region_id", F.lit(None).cast("string")) if regions is None else bad.join(regions.where("region_id <> ''").select("doc_id", "region_id"), "doc_id", "left")
    return known.select(ids.exclusion_id(F.col("doc_id").cast("string"), F.coalesce("region_id", F.lit("doc-level"))).alias("exclusion_id"), "doc_id", "region_id", "reason")


def decompose(cut: DataFrame, blocks: DataFrame, roles: DataFrame, index_superseded: bool = False) -> tuple[DataFrame, DataFrame]:
    """All passes in their order over cut segments (ocr_confidence and region_hint may be missing)."""
    for c, kind in (("ocr_confidence", "double"), ("region_hint", "string")):
        if c not in cut.columns:
            cut = cut.withColumn(c, F.lit(None).cast(kind))
    now = promote_types(retype_boilerplate(scanned(initial(cut)), blocks))
    now = now.withColumn("language", annotate.language(F.col("text"))).withColumn("injection_suspicion", annotate.injection_score(F.col("text")))
    return superseded(now, roles, index_superseded)


def cut_regions(parsed: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments and exclusions of the regions of parsed documents, written once, since segments, exclusions and references all read them."""
    live = parsed.where(~F.col("parse_status").isin("failed", "excluded_pre_parse")).select("doc_id")
    return materialize(segments.of_regions(regions.join(live, "doc_id", "left_semi"), "doc_id"), "decompose-cut")


def region_exclusions(parsed: DataFrame, regions: DataFrame, cut: DataFrame, old: DataFrame) -> DataFrame:
    """Every exclusion: of regions that gave nothing, of documents that were not parsed, and ``old`` ones. No text is looked at again."""
    gone = cut.where("exclusion is not null").join(regions.select("doc_id", "ord", "region_id"), ["doc_id", "ord"])
    key = F.when(F.col("exclusion") == "too_short", F.concat_ws(":", "region_id", F.col("document_order").cast("string"))).otherwise(F.col("region_id"))
    left_out = gone.select(ids.exclusion_id(F.col("doc_id").cast("string"), key).alias("exclusion_id"), "doc_id", "region_id", F.col("exclusion").alias("reason"))
    return left_out.unionByName(empty_sets(parsed, regions)).unionByName(old.withColumn("region_id", F.lit(None).cast("string")))


def decompose_regions(parsed: DataFrame, regions: DataFrame, blocks: DataFrame, roles: DataFrame, index_superseded: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From parsed documents to segments with their evidence, exclusions and resolved cross references.

    ``parsed``: doc_id, findings, parse_status. ``regions``: doc_id, region_id, ord, kind, text, and if known page,
    extract_status, ocr_confidence and region_hint. Documents that were not parsed give one exclusion for each
    of their regions; the others' regions are cut, and what has no text, failed or is too short is an exclusion
    of its region.
    """
    cut = cut_regions(parsed, regions)
    kept, old = decompose(cut.where("exclusion is null").drop("exclusion"), blocks, roles, index_superseded)
    return kept, region_exclusions(parsed, regions, cut, old), segments.cross_references(segments.candidates(cut), cut)
