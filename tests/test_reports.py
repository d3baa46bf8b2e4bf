"""Statistics by class against Python's own, findings and exclusions of small corpora, odd rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators import reports, stats

SEG = "segment_type string, text string, language string, salience_tier string, ocr_confidence double, depth int"


def stat_rows(spark, rows):
    return {r.segment_type: r for r in reports.corpus_stats(spark.createDataFrame(rows, SEG), F.col("depth")).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 57])
def test_numbers_equal_pythons(spark, n):
    rng = random.Random(n)
    rows = [("prose", "w " * rng.randint(0, 30), "en", "primary", rng.choice([0.1, 0.5, rng.random()]), 0) for _ in range(n)]
    got = stat_rows(spark, rows)["prose"]
    t, c = sorted(len(r[1].split()) for r in rows), sorted(r[4] for r in rows)
    q = statistics.quantiles(t, n=100) if n >= 4 else [float(t[-1])] * 99
    assert (got.segment_count, got.text_count, got.min_tokens, got.max_tokens) == (n, n, t[0], t[-1])
    assert [got.mean_tokens, got.median_tokens, got.p75_tokens, got.p90_tokens, got.p95_tokens] == pytest.approx([statistics.mean(t), statistics.median(t), q[74], q[89], q[94]], abs=1e-6)
    p10 = statistics.quantiles(c, n=100)[9] if n >= 10 else c[0]
    assert [got.ocr_mean, got.ocr_p10, got.ocr_min] == pytest.approx([statistics.mean(c), p10, c[0]], abs=1e-6) and got.ocr_count == n


def test_maps_headings_and_classes_without_text(spark):
    got = stat_rows(spark, [
        ("prose", "a b", "en", "primary", None, 0), ("prose", "c", "de", None, None, 0), ("heading", "h", "en", "supporting", None, 0),
        ("code", "x", None, "primary", None, 2), ("code", "y", "en", "primary", None, 3), ("list", "z", "en", "primary", None, 1), ("figure", None, "en", "primary", None, 0), (None, "q", "en", "primary", None, 0),
    ])
    assert {k: r.has_headings for k, r in got.items()} == {"prose": True, "heading": True, "code": True, "list": False, "figure": False, "unknown": False}
    assert got["prose"].languages == {"de": 1, "en": 1} and got["prose"].tiers == {"primary": 1, "supporting": 1} and got["code"].languages == {"en": 1, "und": 1}
    assert got["figure"].segment_count == 1 and got["figure"].text_count is None and got["figure"].median_tokens is None and got["prose"].ocr_count is None
    assert all(r.table_shapes is None for r in got.values())


def test_shapes_of_tables(spark):
    texts = ["| a | b |\n|---|---|\n| 1 | 2 |", "a|b\r\n1|2\n3|4", "no cells", None, "", "|--|", "  x | y  \n\nnote\n+-|-+\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(reports.shape(F.col("t"))).collect()] == ["2x3", "3x1", None, None, None, "0x2", "1x1"]
    got = stat_rows(spark, [("table", t, "en", "primary", None, 0) for t in texts + texts[:1]])["table"]
    assert got.table_shapes == {"0x2": 1, "1x1": 1, "2x3": 2, "3x1": 1}


def test_median_of_few(spark):
    rows = [("a", 3), ("b", 1), ("b", 4), ("c", 1), ("c", 9), ("c", 2)]
    got = {r.k: (r.median_tokens, r.p90_tokens) for r in stats.class_stats(spark.createDataFrame(rows, "k string, v long"), "k", F.col("v")).collect()}
    assert got == {"a": (3.0, 3.0), "b": (2.5, 4.0), "c": (2.0, 9.0)}


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_findings(spark):
    got = reports.findings(
        table(spark, "doc_id long, parse_status string", (1, "parsed"), (2, "parsed"), (3, None)),
        table(spark, "doc_id long, injection_suspicion double", (1, 0.2), (1, 0.4), (2, 0.0), (3, None)),
        table(spark, "label long, node long", (1, 1), (1, 2), (5, 5), (5, 6)),
        table(spark, "block string", ("b",)),
        table(spark, "doc_id long", (1,), (1,)),
        table(spark, "doc_id long, language string, fraction double", (1, "en", 1.0), (2, "en", 0.5), (2, "de", 0.5), (3, None, 1.0)),
        table(spark, "language string, decision string", ("en", "supported"), ("de", "unsupported")),
    )
    assert {(r.figure, r.key): r.value for r in got.collect()} == {
        ("documents", ""): 3, ("parse_status", "parsed"): 2, ("parse_status", "unknown"): 1, ("invisible_content", ""): 2, ("documents_with_injection", ""): 1, ("version_families", ""): 2,
        ("boilerplate_blocks", ""): 1, ("language_fraction", "en"): 0.5, ("language_fraction", "de"): 0.1667, ("language_fraction", "und"): 0.3333, ("language_warning", "de"): 1,
    }


def test_findings_of_nothing(spark):
    e = lambda s: spark.createDataFrame([], s)
    got = reports.findings(e("doc_id long, parse_status string"), e("doc_id long, injection_suspicion double"), e("label long, node long"), e("block string"), e("doc_id long"), e("doc_id long, language string, fraction double"), e("language string, decision string"))
    assert {(r.figure, r.value) for r in got.collect()} == {(f, 0.0) for f in ("documents", "invisible_content", "documents_with_injection", "version_families", "boilerplate_blocks")}


def test_exclusions_name_scope_primary_and_what_to_do(spark):
    records = table(spark, "exclusion_id string, doc_id long, region_id string, reason string", ("e1", 1, None, "superseded_version"), ("e2", 1, "r", "too_short"), ("e3", 2, None, "encrypted"), ("e4", 3, "r", None), ("e5", None, None, "superseded_version"))
    confirmed = table(spark, "doc_id long, reason string, remediation string", (2, "encrypted", "mine"), (2, "parse_failed", "look"), (2, "parse_failed", "look"), (4, "duplicate", None))
    members = table(spark, "label long, node long, content_hash string", (1, 1, "a"), (1, 7, "c"), (1, 8, "b"))
    first = reports.superseded_by(members)
    assert sorted(map(tuple, first.collect())) == [(1, 7), (8, 7)]
    got = {r.exclusion_id: r for r in reports.exclusions(records, confirmed, first).collect()}
    assert {k: (r.scope, r.reason, r.primary_doc, r.from_plan) for k, r in got.items()} == {
        "e1": ("document", "superseded_version", 7, False), "e2": ("segment", "too_short", None, False), "e3": ("document", "encrypted", None, False), "e4": ("segment", "other", None, False),
        "e5": ("document", "superseded_version", None, False), "plan-2-parse_failed": ("document", "parse_failed", None, True), "plan-4-duplicate": ("segment", "duplicate", None, True),
    }
    assert got["plan-2-parse_failed"].user_action == "look" and "decrypt" in got["e3"].user_action and all(r.user_action for r in got.values())
