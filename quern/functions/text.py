"""Column functions on text, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() sees it.
PY_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of white-space separated words, Unicode white space included."""
    return F.regexp_count(text, F.lit(f"[^{PY_SPACE}]+")).cast("long")


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens; empty where there are fewer."""
    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) < n, none).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))))


def shingle_hashes(tokens: Column, n: int = 5) -> Column:
    """64-bit hashes of the distinct runs of n tokens: of the hashes of their tokens, so that no run is written out as a string."""
    none = F.array().cast("array<long>")
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(n))))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(h) < n, none).otherwise(F.array_distinct(runs(h))))


def normal_block(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{PY_SPACE}]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def quantile_exclusive(values: Column, p: float) -> Column:
    """Exclusive (R-6) quantile of a sorted array of two or more doubles, which may pass its ends."""
    def body(v: Column) -> Column:
        n = F.size(v)
        pos = F.lit(p) * (n + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(pos).cast("int"), n - 1))
        return F.element_at(v, j) + (pos - j) * (F.element_at(v, j + 1) - F.element_at(v, j))

    return let(values, body)


def whitespace_repair(text: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, no blanks before line ends, at most two empty lines in a row, none at the ends."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" +(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def ocr_cleanup(text: Column) -> Column:
    """Drop soft hyphens and control characters but tab and line ends; four or more equal marks become one.

    Composition to NFC is the caller's, since the JVM functions have none.
    """
    t = F.regexp_replace(text, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{ad}]", "")
    return F.regexp_replace(t, r"([.,:;!?])\1{3,}", "$1")


def header_inference(text: Column) -> Column:
    """Mark a short first line as a heading where the text has no marked ones."""
    def body(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        bare = F.trim(first)
        fits = (F.length(first) < 80) & ~bare.rlike(r"[.?!]$|^[-*]|^[0-9].{0,2}\.") & (F.length(second) > F.length(first))
        return F.when(fits, F.regexp_replace(text, r"\A((?:[^\S\n]*\n)*)", "$1# ")).otherwise(text)

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.when(text.rlike(r"(?m)^#"), text).otherwise(F.coalesce(let(lines, body), text))


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    def body(chars: Column) -> Column:
        n = F.size(chars)
        parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
        return -F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p))

    return let(F.filter(F.split(token, ""), lambda c: c != ""), body)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
