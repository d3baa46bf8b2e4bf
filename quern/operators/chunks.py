"""Texts to chunks: separator-aware windows with overlap, code at its boundaries, identifiers and embedding input."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids
from quern.session import batch_bytes, ship, tidy

#: Bytes of texts that a worker cuts at once.
BATCH = 1 << 20
# Separators in order of preference.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
# Names of languages, and how a line that starts a unit of code begins in each.
PYTHON, SCRIPT, GO = ("python", "py"), ("javascript", "typescript", "js", "ts", "jsx", "tsx"), ("go",)
PYTHON_UNIT = re.compile(r"^(def |class |async def )")
SCRIPT_UNIT = re.compile(r"^(export\s+default\s+(async\s+)?function\b|export\s+(async\s+)?function\b|export\s+class\b|export\s+const\s+\w+\s*=|(async\s+)?function\b|class\b|const\s+\w+\s*=\s*(async\s+)?\(|const\s+\w+\s*=\s*(async\s+)?function\b)")
GO_UNIT = re.compile(r"^func\b")
BOUNDARIES = {**dict.fromkeys(PYTHON, PYTHON_UNIT), **dict.fromkeys(SCRIPT, SCRIPT_UNIT), **dict.fromkeys(GO, GO_UNIT)}
# Languages whose units are brace blocks, and how the line of such a unit begins.
BRACES = ("c", "cpp", "c++", "java", "rust", "rs", "csharp", "cs", "swift", "kotlin")
BRACE_UNIT = re.compile(r"^((public|private|protected|static|final|override|virtual|inline|extern)?\s*[\w:<>*&]+\s+\w+\s*\(|(pub\s+)?(async\s+)?fn\s+\w+|(pub|private|protected)?\s*(static\s+)?(void|int|bool|string|auto|var)\s+\w+)")


class Words:
    """Word counts of any range of a text in logarithmic time, from the places of its words."""

    def __init__(self, text: str):
        self.starts, self.ends, at = [], [], 0
        for w in text.split():
            a = text.index(w, at)
            at = a + len(w)
            self.starts.append(a)
            self.ends.append(at)

    def count(self, a: int, b: int) -> int:
        return max(0, bisect.bisect_left(self.starts, b) - bisect.bisect_right(self.ends, a))


def windows(text: str, most: int, overlap: int, words: Words | None = None) -> list[tuple[int, int, int]]:
    """(start, end, words) of chunks that cover the text; each next one steps back by the overlap's share."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("needs 0 <= overlap < most words")
    words, n, at, out = words or Words(text), len(text), 0, []
    while True:
        left = words.count(at, n)
        if left <= most:
            out.append((at, n, left))
            return out
        width = min(int((n - at) / left * most) + 1, n - at)
        cut = next((k + len(s) for s in SEPARATORS if (k := text.rfind(s, at, at + width)) >= 0), at + width)
        own = words.count(at, cut)
        out.append((at, cut, own))
        if cut >= n:
            return out
        back = int((cut - at) * min(overlap, own - 1) / own) if own and overlap else 0
        at = max(cut - back, at + 1)


def code_units(text: str, most: int, language: str) -> list[tuple[int, int, int]]:
    """Chunks that tile code at its boundary lines; too large units are cut on without overlap."""
    language = language.lower().strip()
    boundary, starts, at = BOUNDARIES.get(language), [0], 0
    marks, depth = None, 0  # where the decorators right above a line of Python begin
    for line in text.split("\n"):
        hit = bool(boundary and boundary.match(line))
        if language in BRACES:
            opened = line.count("{") - line.count("}")
            hit = depth == 0 and opened > 0 and bool(BRACE_UNIT.match(line.lstrip()))
            depth = max(0, depth + opened)
        start = at if marks is None else marks
        if hit and start:
            starts.append(start)
        decorated = language in PYTHON and line.startswith("@")
        marks = start if decorated else None
        at += len(line) + 1
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        out += [(a + s, a + e, w) for s, e, w in windows(text[a:b], most, 0)]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int, overlap: int, strategy: str, language: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            spans = code_units(t, most, language) if strategy == "code_syntax" else windows(t, most, overlap)
            rows += [(i, k, a, b, t[a:b], w) for k, (a, b, w) in enumerate(spans)]
        c = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["doc_id", "chunk_index", "char_start", "char_end", "text", "token_count"])


def chunk(docs: DataFrame, most: int = 512, overlap: int = 64, strategy: str = "recursive_char", language: str = "unknown") -> DataFrame:
    """Chunks of every whole text; no shuffle. Only code has a strategy of its own."""
    windows("", most, overlap)
    ship(docs.sparkSession)
    batch_bytes(docs.sparkSession, BATCH)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(lambda b: (yield from _chunks(b, most, overlap, strategy, language))), "doc_id long, chunk_index int, char_start long, char_end long, text string, token_count long")


#: What a row may say about how its text is cut.
RULE = {"strategy": "string", "max_tokens": "int", "overlap_tokens": "int", "language": "string"}
CUT = "chunk_index int, char_start long, char_end long, text string, token_count long"


def by_rule(rows: DataFrame, rule: str = "rule") -> DataFrame:
    """Chunks of every row's text, each by the row's own rule (a struct of ``RULE``, language may be missing), in one pass.

    The row's other columns go on beside each of its chunks. Code is cut by its language's units, at unknown
    languages like other text without overlap.
    """
    ship(rows.sparkSession)
    batch_bytes(rows.sparkSession, BATCH)
    rest = [f for f in rows.schema.fields if f.name not in ("text", rule)]
    known = rows.schema[rule].dataType.names
    own = [F.col(f"{rule}.{n}").cast(t).alias(f"_{n}") if n in known else F.lit("unknown").alias(f"_{n}") for n, t in RULE.items()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i, (t, strategy, most, overlap, language) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", *(f"_{n}" for n in RULE))), strict=True)):
                t = t or ""
                spans = code_units(t, most, language or "unknown") if strategy == "code_syntax" else windows(t, most, overlap)
                at += [i] * len(spans)
                made += [(k, a, b, t[a:b], w) for k, (a, b, w) in enumerate(spans)]
            c = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            taken = batch.select([f.name for f in rest]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, t) for x, t in zip(c, kinds, strict=True))], names=[*taken.schema.names, "chunk_index", "char_start", "char_end", "text", "token_count"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.select(*(f.name for f in rest), "text", *own).mapInArrow(tidy(cut), f"{fields}, {CUT}" if fields else CUT)


def with_ids(chunks: DataFrame, content: DataFrame, config: str, path: Column) -> DataFrame:
    """chunk_id and point_id from document, content, configuration, path and index."""
    joined = chunks.join(content.select("doc_id", "document_id", "content_hash"), "doc_id")
    key = (F.col("document_id"), F.col("content_hash"), F.lit(config), path, F.col("chunk_index"))
    return joined.withColumn("chunk_id", ids.chunk_id(*key)).withColumn("point_id", ids.point_id(*key))


def coverage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document: chunks, characters covered at least once, and whether all are."""
    from pyspark.sql.window import Window

    before = F.max("char_end").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("char_end") - F.greatest(F.col("char_start"), F.coalesce(before, F.lit(0))))
    by = chunks.withColumn("new", new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("new").alias("covered"))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(by, "doc_id").select("doc_id", "n_chunks", "covered", (F.col("covered") == F.col("n_chars")).alias("complete"))


def embedding_input(text: Column, breadcrumb: Column, description: Column, class_context: Column) -> Column:
    """The text behind a frame of whatever context there is; the text itself without any."""
    lines = F.concat_ws("\n", F.concat(F.lit("Context: "), breadcrumb), F.concat(F.lit("Description: "), description), F.concat(F.lit("Class context: "), class_context))
    return F.when(lines == "", text).otherwise(F.concat(F.lit("[context]\n"), lines, F.lit("\n\n"), text))


def digest_vector(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding: 16-bit numbers of the text's SHA-256, repeated."""
    digits = F.repeat(F.sha2(text, 256), dims // 16 + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digits, F.lit(4) * i + 1, F.lit(4)), 16, 10).cast("double") / 65536)
