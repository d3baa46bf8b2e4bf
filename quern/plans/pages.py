"""Queries of parsing, segmentation, transforms and chunking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import text as T
from quern.operators import chunks as C
from quern.operators import dedup, html, segments
from quern.plans.registry import query
from quern.session import materialize


@query("html_regions", "pages")
def html_regions(pages: DataFrame) -> DataFrame:
    return html.regions(pages)


@query("html_links", "pages", """SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"#][^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def html_links(pages: DataFrame) -> DataFrame:
    return html.regions(pages).where("kind = 'link'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("html_region_stats", "pages")
def html_region_stats(pages: DataFrame) -> DataFrame:
    return html.regions(pages).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("html_quality", "pages")
def html_quality(pages: DataFrame) -> DataFrame:
    return html.quality(pages, html.regions(pages))


@query("page_segments", "pages")
def page_segments(pages: DataFrame) -> DataFrame:
    return segments.of_regions(html.regions(pages))


@query("segments", "documents")
def document_segments(docs: DataFrame) -> DataFrame:
    return segments.of_documents(docs)


@query("exclusions", "documents")
def exclusions(docs: DataFrame) -> DataFrame:
    return segments.exclusions(segments.of_documents(docs))


@query("reassembly_digest", "documents")
def reassembly_digest(docs: DataFrame) -> DataFrame:
    return segments.reassembly(segments.of_documents(docs))


@query("xrefs", "documents")
def xrefs(docs: DataFrame) -> DataFrame:
    """References of documents in which every eleventh mentions a section that many segments lie in, one that a single segment has, and one that is not there."""
    planted = F.concat(F.lit("4.2 Setup\n\n"), F.col("text"), F.lit("\n\nThis follows, see section 4.2 for the details.\n\nBut refer to section 9.9 as well.\n\nMore is said, see section 7.3 for all of it.\n\n7.3 Annex"))
    found = materialize(segments.of_documents(docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, planted).otherwise(F.col("text")))), "cut-documents")
    return segments.cross_references(segments.candidates(found), found)


SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m) +$', '', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g')"


@query("tier1_whitespace", "documents", f"SELECT doc_id, sha256({SPACED}) AS digest, {SPACED} <> text AS changed_text FROM documents")
def tier1_whitespace(docs: DataFrame) -> DataFrame:
    out = T.whitespace_repair(F.col("text"))
    return docs.select("doc_id", F.sha2(out, 256).alias("digest"), (out != F.col("text")).alias("changed_text"))


@F.pandas_udf(StringType())
def nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def _sql_marks(t: str) -> str:
    for c in ".,:;!?":
        t = f"regexp_replace({t}, '[{c}]{{4,}}', '{c}', 'g')"
    return t


@query("tier1_ocr_cleanup", "documents", "SELECT doc_id, sha256(nfc_normalize(" + _sql_marks("regexp_replace(text, '[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}\\x{7f}\\x{ad}]', '', 'g')") + ")) AS digest FROM documents")
def tier1_ocr_cleanup(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(nfc(T.ocr_cleanup(F.col("text"))), 256).alias("digest"))


@query("header_inference", "documents", """WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
SELECT doc_id, sha256(CASE WHEN NOT regexp_matches(text, '(?m)^#') AND len(ls) > 1 AND length(ls[1]) < 80 AND NOT regexp_matches(trim(ls[1]), '[.?!]$|^[-*]|^[0-9].{0,2}\\.') AND length(ls[2]) > length(ls[1])
       THEN regexp_replace(text, '\\A((?:[ \\t\\r\\f\\v]*\\n)*)', '\\1# ') ELSE text END) AS digest FROM l""")
def header_inference(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(T.header_inference(F.col("text")), 256).alias("digest"))


@query("chunks", "documents")
def chunks(docs: DataFrame) -> DataFrame:
    return C.chunk(docs, 128, 16)


@query("code_chunks", "documents")
def code_chunks(docs: DataFrame) -> DataFrame:
    return C.chunk(docs, 128, 0, "code_syntax", "python")


@query("chunk_coverage", "documents", "SELECT doc_id, length(text) AS covered, true AS complete FROM documents")
def chunk_coverage(docs: DataFrame) -> DataFrame:
    return C.coverage(C.chunk(docs, 128, 16), docs).select("doc_id", "covered", "complete")


@query("chunk_ids", "documents")
def chunk_ids(docs: DataFrame) -> DataFrame:
    return C.with_ids(C.chunk(docs, 128, 16), dedup.inventory(docs), "v1", F.lit("#0")).select("doc_id", "chunk_index", "chunk_id", "point_id")


@query("embedding_input", "documents", "SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN text ELSE '[context]' || chr(10) || 'Context: ' || source || ' > ' || lang || CASE WHEN lang = 'de' THEN chr(10) || 'Class context: ' || lang ELSE '' END || chr(10) || chr(10) || text END) AS digest FROM documents")
def embedding_input(docs: DataFrame) -> DataFrame:
    crumb = F.when(F.col("lang") != "en", F.array_join(F.array("source", "lang"), " > "))
    return docs.select("doc_id", F.sha2(C.embedding_input(F.col("text"), crumb, F.lit(None).cast("string"), F.when(F.col("lang") == "de", F.col("lang"))), 256).alias("digest"))


@query("fake_embedding", "benchmark", "SELECT item_id, i::INT AS i, ('0x' || substr(repeat(sha256(text), 5), 4 * i::INT + 1, 4))::BIGINT / 65536 AS x FROM benchmark, unnest(range(64)) AS u(i)")
def fake_embedding(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.posexplode(C.digest_vector(F.col("text"))).alias("i", "x"))
