"""Deterministic identifiers. Everything downstream keys on them, so they are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column, n_chars: int) -> Column:
    """The first ``n_chars`` (a multiple of four) base-32 characters of a hex string, four from every five digits."""
    parts = []
    for i in range(n_chars // 4):
        v = F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("DOC"), base32(F.sha2(content, 256), 16))


def group_id(content: Column) -> Column:
    return F.concat(F.lit("GRP"), base32(F.sha2(content, 256), 16))


def family_id(members: Column) -> Column:
    return F.concat(F.lit("fam-"), F.left(F.sha2(F.array_join(F.sort_array(members), ":"), 256), F.lit(24)))


def segment_id(document: Column, order: Column) -> Column:
    return F.concat(F.lit("seg-"), F.left(F.sha2(F.concat_ws(":seg:", document, order.cast("string")), 256), F.lit(24)))


def exclusion_id(document: Column, suffix: Column) -> Column:
    return F.concat(F.lit("excl-"), F.left(F.sha2(F.concat_ws(":excl:", document, suffix), 256), F.lit(24)))


def region_id(kind: Column, path: Column) -> Column:
    return F.concat(F.lit("reg-html-"), F.left(F.sha2(F.concat(F.lit("html:"), kind, F.lit(":"), path), 256), F.lit(20)))


def _chunk_digest(document: Column, content: Column, config: Column, path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", document, content, config, path, index.cast("string")), 256)


def chunk_id(document: Column, content: Column, config: Column, path: Column, index: Column) -> Column:
    """The lower-case base-32 digest's first 26 characters after a mark."""
    return F.concat(F.lit("chk_"), F.left(F.lower(base32(_chunk_digest(document, content, config, path, index), 28)), F.lit(26)))


def point_id(document: Column, content: Column, config: Column, path: Column, index: Column) -> Column:
    """The digest's first 16 bytes in UUID form."""
    h = _chunk_digest(document, content, config, path, index)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut))
