"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

A text is its words (letters and digits, lower-cased). Every run of K words gets a hash; winnowing keeps the
least of every window of W hashes, so a shared run of K + W - 1 words shares a fingerprint. Templates'
fingerprints form a small inverted index (templates are a parameter, bounded by it). A document's hits
vote for diagonals of a template; around each voted diagonal a banded Smith-Waterman alignment of words gives
the matched words, their share of the template and the span in the text. Before, a count of the template's words
that the band holds at all leaves out diagonals that cannot reach the coverage. Of overlapping matches the one with
the best alignment stays, so a notice within a header is the header's. The default templates are short notices,
standard headers and full texts (``license_set``); with them, SPDX tags are read as well, each id of a tag a row.

Defined cases: a null text is an empty text and matches nothing; a null doc_id and repeated rows pass
through; templates without words match nothing; equally good overlapping matches of several licenses are all reported; a template's
license is its name up to a ``#``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import license_set
from quern.session import batch_bytes, ship, tidy

K, W = 3, 2
BAND = 8
#: Share of a template's words that a reported match covers.
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|[ \t]+)+)")
SPDX_ID = re.compile(r"(\bWITH[ \t]+)?([A-Za-z0-9][A-Za-z0-9.+:-]*)")

#: Short notices, which the standard set holds besides its own.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


def tokens(text: str) -> list[str]:
    """Words, lower-cased."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


_WORD: dict[str, int] = {}


def hashes(words: list[str]) -> np.ndarray:
    """A hash of each word."""
    found: list = list(map(_WORD.get, words))
    if None in found:
        if len(_WORD) > 1_500_000:
            _WORD.clear()
        for i, x in enumerate(found):
            if x is None:
                found[i] = _WORD[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(found, dtype=np.uint64)


def grams(words: list[str]) -> np.ndarray:
    """Hashes of every run of K words."""
    if len(words) < K:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    n = len(h) - K + 1
    return sum((h[k : k + n] * STEPS[k] for k in range(1, K)), h[:n] * STEPS[0])


def spdx(text: str) -> list[tuple[str, int, int, float]]:
    """(id, start, end, 1.0) of every id of every SPDX tag; exceptions after WITH are not licenses."""
    out = []
    for m in SPDX.finditer(text):
        for x in SPDX_ID.finditer(text, m.start(1), m.end(1)):
            if x[2] in ("AND", "OR", "WITH"):
                continue
            if not x[1]:
                out.append((x[2].rstrip(".:-"), m.start(), x.start(2) + len(x[2].rstrip(".:-")), 1.0))
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the rightmost least hash of every window of W hashes."""
    if len(hashes) < W:
        return np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, W)
    return np.unique(np.arange(len(view)) + W - 1 - view[:, ::-1].argmin(1))


class Templates:
    """The templates' words and the inverted index of their fingerprints.

    The index holds a template's winnowed fingerprints, one hash of every W in a row at least. Every hash of a
    document asks, so a shared run of K + W - 1 words is never missed.
    """

    def __init__(self, texts: dict[str, str]):
        self.words = {n: tokens(t) for n, t in sorted(texts.items())}
        self.hashes = {n: hashes(w) for n, w in self.words.items()}
        self.index: dict[int, list[tuple[str, int]]] = {}
        for n, w in self.words.items():
            h = grams(w)
            for i in winnow(h).tolist():
                self.index.setdefault(int(h[i]), []).append((n, i))
        self.known = np.array(sorted(self.index), dtype=np.uint64)

    def candidates(self, words: list[str]) -> set[tuple[str, int]]:
        """(template, diagonal) that a document's fingerprints vote for, diagonals in steps of the band."""
        h = grams(words)
        if not len(h) or not len(self.known):
            return set()
        hit = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        return {(n, (p - i) // BAND) for p in np.flatnonzero(hit).tolist() for n, i in self.index[int(h[p])]}

    def fits(self, n: str, words: list[str], own: np.ndarray) -> int:
        """How many of a template's words the band holds: no alignment in it can match more."""
        t = self.words[n]
        if len(t) <= 2 * BAND:
            held = set(words)
            return sum(w in held for w in t)
        want, hit = self.hashes[n], np.zeros(len(t), dtype=bool)
        for k in range(-BAND, 3 * BAND):  # word i of the template and word i + k
            a, b = max(0, -k), min(len(t), len(own) - k)
            if a < b:
                hit[a:b] |= want[a:b] == own[a + k : b + k]
        return int(hit.sum())

    def scan(self, text: str, coverage: float) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of matches, in code points, end exclusive."""
        words = tokens(text)
        found = self.candidates(words)
        if not found:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        own = hashes(words)
        out: dict[tuple[str, int, int], tuple[int, float]] = {}
        tries = []
        for n, d in sorted(found):
            t = self.words[n]
            lo, hi = max(0, d * BAND - BAND), min(len(words), max(0, d * BAND - BAND) + len(t) + 3 * BAND)
            if hi - lo >= coverage * len(t) and (held := self.fits(n, words[lo:hi], own[lo:hi])) >= coverage * len(t):
                tries.append((-held, n, lo, hi))
        seen: dict[str, list[tuple[int, int]]] = {}
        for _, n, lo, hi in sorted(tries):
            t = self.words[n]
            ranges = [(lo, hi)]
            while ranges:  # a window may hold a notice twice: what lies beside a match is looked at again
                lo, hi = ranges.pop()
                least = coverage * len(t)
                if hi - lo < least or self.fits(n, words[lo:hi], own[lo:hi]) < least:
                    continue
                # Of a long template: what a match leaves of the window has no room for another one.
                if len(t) > 8 * BAND and any(x < hi and lo <= y and x - lo < least and hi - y - 1 < least for x, y in seen.get(n, ())):
                    continue
                got = align(t, words[lo:hi])
                if got and got[2] >= least:
                    seen.setdefault(n, []).append((lo + got[0], lo + got[1]))
                    key = (n.split("#")[0], places[lo + got[0]][0], places[lo + got[1]][1])
                    out[key] = max(out.get(key, (0, 0.0)), (got[3], got[2] / len(t)))
                    ranges += [(lo, lo + got[0]), (lo + got[1] + 1, hi)]
        kept: list[tuple[str, int, int, float, int]] = []
        for (n, s, e), (score, c) in sorted(out.items(), key=lambda x: (-x[1][0], -x[1][1], x[0][1], x[0][2] - x[0][1], x[0][0])):
            if not any((k[0] == n or k[4] > score) and s < k[2] and k[1] < e for k in kept):
                kept.append((n, s, e, c, score))
        return sorted((k[:4] for k in kept), key=lambda k: (k[1], k[0]))


def align(template: list[str], words: list[str]) -> tuple[int, int, int, int] | None:
    """First and last aligned word of ``words``, the number of equal words and the score of the best local alignment."""
    best, where = 0, None
    prev = [(0, 0, 0)] * (len(words) + 1)
    for i, t in enumerate(template):
        row = [(0, 0, 0)] * (len(words) + 1)
        lo, hi = max(0, i - BAND), min(len(words), i + 3 * BAND)
        for j in range(lo, hi):
            s, n, a = prev[j]
            hit = t == words[j]
            x = (s + (MATCH if hit else MISMATCH), n + hit, a if s else j)
            y = (prev[j + 1][0] + GAP, *prev[j + 1][1:])
            z = (row[j][0] + GAP, *row[j][1:])
            top = max(x, y, z, key=lambda c: c[0])
            row[j + 1] = top if top[0] > 0 else (0, 0, 0)
            if hit and row[j + 1][0] > best:
                best, where = row[j + 1][0], (row[j + 1][2], j, row[j + 1][1], row[j + 1][0])
        prev = row
    return where


_HELD: dict[str, Templates] = {}


@tidy
def _scan(batches: Iterator[pa.RecordBatch], shared, coverage: float, tags: bool) -> Iterator[pa.RecordBatch]:
    texts: dict[str, str] = shared.value
    key = repr(sorted(texts.items()))
    if (held := _HELD.get(key)) is None:
        held = _HELD[key] = Templates(texts)
    for batch in batches:
        rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in [*held.scan(t, coverage), *(spdx(t) if tags else [])]]
        c = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.types[0]), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64())], names=["doc_id", "license", "start", "end", "coverage"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start, end and coverage of every match in every whole text."""
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    tags = not templates
    own = spark.sparkContext.broadcast(dict(templates or license_set.standard(TEMPLATES)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, own, coverage, tags), "doc_id long, license string, start long, end long, coverage double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
