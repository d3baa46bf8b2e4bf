"""Files to an inventory: recursive scan, media types, timestamps, identifiers, parser routing, early exclusion."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids

# Extensions by parser, in the order in which parsers are asked, and what the first three say.
PARSERS = {
    "audio": (".wav", ".mp3", ".aac", ".flac", ".ogg", ".m4a"),
    "video": (".mp4", ".mov", ".avi", ".mkv", ".webm"),
    "cad": (".dwg", ".dxf", ".step", ".stp", ".iges", ".igs"),
    "html": (".html", ".htm"),
    "spreadsheet": (".xlsx", ".xls", ".ods", ".csv"),
    "pdf": (".pdf",),
}
FINDINGS = {"audio": "unservable_audio", "video": "unservable_video", "cad": "unservable_cad", "fallback": "excluded_content_type_other"}
OCTETS = "application/octet-stream"
# Media types of office files, which the standard library's own table may lack.
OFFICE = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odt": "application/vnd.oasis.opendocument.text",
}


def extension(path: Column) -> Column:
    """The last part of a file's name from its last dot on, in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.?(\.[^./]+)$", 1))


def media_type(path: Column) -> Column:
    """By extension, from the standard library's own table; unknown ones are octet streams."""
    known = OFFICE | mimetypes.MimeTypes().types_map[True]
    kinds = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
    return F.coalesce(F.element_at(kinds, extension(path)), F.lit(OCTETS))


def parser(path: Column) -> Column:
    """The first parser that takes a file; the last one takes all."""
    ext, out = extension(path), F.lit("fallback")
    for name, some in reversed(PARSERS.items()):
        out = F.when(ext.isin(*some), name).otherwise(out)
    return out


def finding(parser_name: Column) -> Column:
    """Code of the finding with which a file is excluded before it is parsed, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in FINDINGS.items() for x in kv)), parser_name)


def family(kind: Column) -> Column:
    """Stratum of a media type: its part before the slash, with documents and tables told apart."""
    return F.when(kind.rlike("spreadsheet|excel|csv"), "spreadsheet").when(kind.rlike("pdf"), "pdf").otherwise(F.substring_index(kind, "/", 1))


def describe(files: DataFrame, path: str = "source_path") -> DataFrame:
    """media_type, parser, parse_status and finding beside each file's row."""
    p = F.col(path)
    out = files.withColumn("media_type", media_type(p)).withColumn("parser", parser(p))
    code = finding(F.col("parser"))
    return out.withColumn("finding_code", code).withColumn("parse_status", F.when(code.isNull(), "pending").otherwise("excluded_pre_parse"))


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One row for each file below ``root``: path within it, size, time, hash, ids, media type and routing.

    Names and sizes are listed without opening a file. Files that cannot be read stay, with the status
    ``unreadable`` and no hash. Contents are hashed in spans (``tree.hashed``) where Arrow opens the file system that the folder
    lies in; elsewhere Spark reads each file whole, and one over 2 GB stops the job.
    """
    from quern.sources import tree

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    names = spark.createDataFrame([(n,) for n in reader.load(root).inputFiles()], "file string")
    listed = reader.load(root).select("path", F.col("modificationTime").alias("source_modified_at"), F.col("length").alias("size_bytes"))
    inside = F.expr(f"substring(path, {len(base) + 2})")
    # Spark's readers pass over files without a byte: these come back from the list of names.
    # A list of names has file:///x where paths have file:/x, and both have host and bucket as they are; a plus is no blank.
    bare = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9+.-]+):///+", "$1:/")
    sized = names.join(listed, bare == F.col("path"), "left")
    sized = sized.select(F.coalesce("path", bare).alias("path"), "source_modified_at", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
    own = F.regexp_replace(inside, "^/+", "")
    if (real := tree.opened_by_arrow(spark, root)) is not None:
        micros = F.unix_micros("source_modified_at")
        both = tree.hashed(spark, real, sized.select(own.alias("path"), "size_bytes", (micros * 1000).alias("modified_ns"), F.lit("listed").alias("status")))
        both = both.withColumnsRenamed({"path": "source_path"}).withColumn("source_modified_at", F.timestamp_micros(F.expr("modified_ns div 1000")))
    else:
        read = reader.option("ignoreCorruptFiles", "true").load(root).select(F.col("path").alias("read_path"), F.sha2("content", 256).alias("content_hash"))
        both = sized.join(read, F.col("path") == F.col("read_path"), "left").withColumn("content_hash", F.when(F.col("size_bytes") == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("content_hash"))).withColumn("source_path", own)
    named = both.select("source_path", "size_bytes", "source_modified_at", "content_hash", F.when(F.col("content_hash").isNotNull(), ids.document_id(F.col("content_hash"))).alias("document_id"))
    return describe(named).withColumn("status", F.when(F.col("content_hash").isNull(), "unreadable").otherwise("collected"))


def duplicates(inventory: DataFrame) -> DataFrame:
    """duplicate_of beside each file: the smallest path of those with equal content, null for that one and single files."""
    first = inventory.where("content_hash is not null").groupBy("content_hash").agg(F.min("source_path").alias("first_path"), F.count(F.lit(1)).alias("n_copies"))
    both = inventory.join(first, "content_hash", "left")
    return both.withColumn("duplicate_of", F.when((F.col("n_copies") > 1) & (F.col("first_path") != F.col("source_path")), F.col("first_path"))).drop("first_path", "n_copies")


def delta_pages(changes: DataFrame, watermark: str | None = None) -> DataFrame:
    """Files of a change feed (item_id, kind, deleted, version): folders and deletions are skipped, the newest version of each stays.

    Deletions are not turned into tombstones here: ``tombstones`` names them.
    """
    new = changes if watermark is None else changes.where(F.col("version") > F.lit(watermark).cast(changes.schema["version"].dataType))
    live = new.where((F.col("kind") != "folder") & ~F.col("deleted"))
    rest = [c for c in live.columns if c != "item_id"]
    return live.groupBy("item_id").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("item_id", *(F.col(f"x.{c}").alias(c) for c in rest))


def tombstones(changes: DataFrame) -> DataFrame:
    """Items whose newest change is a deletion."""
    last = changes.groupBy("item_id").agg(F.max_by("deleted", "version").alias("gone"))
    return last.where("gone").select("item_id")


class PermissionGap(RuntimeError):
    """Documents whose permissions are unknown were not acknowledged."""


def permission_gate(documents: DataFrame, acknowledged: bool = False, fidelity: str = "permission_fidelity") -> DataFrame:
    """The documents themselves, or an error, before any content is read, where permissions are unavailable."""
    if not acknowledged:
        bad = documents.where(F.col(fidelity).isNull() | (F.col(fidelity) == "unavailable")).count()
        if bad:
            raise PermissionGap(f"{bad} documents have no permissions")
    return documents


def collect(pages: list[DataFrame], acknowledged: bool = False) -> DataFrame:
    """A connector's contract: pages of its listing, the gate over all of them, then the documents."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return permission_gate(out, acknowledged)


def doc_text(regions: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A document's text: its regions' texts in order, stripped, with blank lines between; links are no text."""
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = regions.where("kind <> 'link'").select(id_col, "ord", t.alias("t")).where("t <> ''")
    by = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ord", "t"))).alias("x"))
    return by.select(id_col, F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("text"))
