"""Segments with their evidence, code units, builds that stop and go on, and answers with damaged payloads: literal rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import build, chunks, decompose, segments, serve
from quern.plans.catalog import QUERIES
from quern.sources.store import ArtifactError

SEGMENT = "doc_id long, segment_id string, segment_type string, salience_tier string, text string"
RULE = "rule_order int, segment_class string, strategy string, max_tokens int, overlap_tokens int"
DEFAULT = {"strategy": "recursive_char", "max_tokens": 128, "overlap_tokens": 16}


def units(text: str, language: str, most: int = 100) -> list[str]:
    return [text[a:b] for a, b, _ in chunks.code_units(text, most, language)]


def test_python_units_take_their_decorators():
    code = '"""Doc."""\nimport a\n\n@one\n@two(x)\ndef f():\n    return 1\n\nasync def g():\n    pass\nclass C:\n    def m(self):\n        pass\n@late\n\ndef h(): pass\n'
    got = units(code, "python")
    assert got == ['"""Doc."""\nimport a\n\n', "@one\n@two(x)\ndef f():\n    return 1\n\n", "async def g():\n    pass\n", "class C:\n    def m(self):\n        pass\n@late\n\n", "def h(): pass\n"]
    assert units(code, " PY ") == got and "".join(got) == code
    assert units("@a\ndef f(): pass\n", "py") == ["@a\ndef f(): pass\n"]
    assert units("defer = 1\nclassy = 2\nasync  def f(): pass\n", "python") == ["defer = 1\nclassy = 2\nasync  def f(): pass\n"]


@pytest.mark.parametrize("language", ["javascript", "typescript", "js", "ts", "jsx", "tsx"])
def test_script_units(language):
    parts = ["import x\n", "export default async function a() {}\n", "export function b() {}\n", "export class C {}\n", "export const d = 1\n", "async function e() {}\n", "class F {}\n", "const g = (x) => x\n", "const h = async (x) => x\n", "const i = function () {}\nlet j = 1\nexport { j }\nconst k = 3\n  function inner() {}\n"]
    assert units("".join(parts), language) == parts


def test_go_and_unknown_units():
    code = "package a\ntype T struct {}\nfunc f() {\n}\nfunc (t T) g() {\n}\n"
    assert units(code, "go") == ["package a\ntype T struct {}\n", "func f() {\n}\n", "func (t T) g() {\n}\n"]
    assert units(code, "unknown") == [code] and units("", "go") == [""]
    assert units("a\x0cdef b\x0b\ndef c(): pass", "python") == ["a\x0cdef b\x0b\n", "def c(): pass"]


def test_front_matter_failed_and_scanned_regions(spark):
    rows = [
        (1, 0, "prose", "Version 3 of this handbook for all readers here.", 1, "ok", None),
        (1, 1, "prose", "Author of this other part is somebody well known.", 2, "ok", None),
        (1, 2, "prose", "never read", 2, "failed", None),
        (1, 3, "prose", " \n", 2, "empty", None),
        (1, 4, "prose", "Title\n\nsome scanned words that stay together here.", 3, "ok", 0.7),
        (1, 5, "prose", "SCANNED TITLE\n\nsome scanned words that can be cut well.", 3, "ok", 0.9),
        (2, 0, "prose", "Prepared by the very same people as ever before.", 2, "ok", None),
        (3, 0, "prose", "Approved by somebody else who is not on a page.", None, "ok", None),
    ]
    regions = spark.createDataFrame([(*r, f"r{r[0]}-{r[1]}") for r in rows], "doc_id long, ord int, kind string, text string, page int, extract_status string, ocr_confidence double, region_id string")
    got = [(r["doc_id"], r["segment_type"], r["exclusion"], r["ocr_confidence"]) for r in segments.of_regions(regions, "doc_id").orderBy("doc_id", "document_order").collect()]
    assert got == [
        (1, "front_matter", None, None), (1, "prose", None, None), (1, "unknown", "parse_failed", None), (1, "unknown", "empty_region", None),
        (1, "scanned_region", None, 0.7), (1, "heading", None, 0.9), (1, "prose", None, 0.9), (2, "prose", None, None), (3, "front_matter", None, None),
    ]

    parsed = spark.createDataFrame([(1, [], "parsed"), (2, ["password_protected"], "failed"), (3, [], "parsed"), (4, ["unservable_audio"], "excluded_pre_parse"), (5, [], "failed")], "doc_id long, findings array<string>, parse_status string")
    none = spark.createDataFrame([], "block string")
    kept, gone, refs = decompose.decompose_regions(parsed, regions, none, spark.createDataFrame([(3, "superseded")], "doc_id long, dedup_role string"))
    want = {(1, "r1-2", "parse_failed"), (1, "r1-3", "empty_region"), (2, "r2-0", "encrypted"), (4, None, "unservable_content"), (5, None, "parse_failed"), (3, None, "superseded_version")}
    assert {(r["doc_id"], r["region_id"], r["reason"]) for r in gone.collect()} == want and len({r["exclusion_id"] for r in gone.collect()}) == 6
    first = {r["segment_type"]: r for r in kept.where("doc_id = 1").collect()}
    assert set(first) == {"front_matter", "prose", "scanned_region", "heading"} and kept.where("doc_id <> 1").count() == 0
    assert (first["scanned_region"]["salience_tier"], first["scanned_region"]["salience_basis"]) == ("supporting", "ocr_confidence_warn")
    assert [(s["kind"], s["won"]) for s in first["scanned_region"]["salience_signals"]] == [("segment_type_prior", False), ("ocr_confidence_warn", True)]
    assert refs.count() == 0


def test_promotion_writes_its_signal_but_scans_keep_theirs(spark):
    rows = [("a", "prose", None, "code"), ("b", "prose", 0.5, "code"), ("c", "prose", 0.95, "code"), ("d", "heading", None, "code"), ("e", "prose", None, None)]
    found = spark.createDataFrame(rows, "segment_id string, segment_type string, ocr_confidence double, region_hint string")
    got = {r["segment_id"]: r for r in decompose.promote_types(decompose.scanned(decompose.initial(found))).collect()}
    said = {k: (r["segment_type"], r["salience_basis"], [(s["kind"], s["won"]) for s in r["salience_signals"]]) for k, r in got.items()}
    prior = "segment_type_prior"
    assert said["a"] == said["c"] == ("code", prior, [(prior, False), (prior, True)])
    assert said["b"] == ("code", "ocr_confidence_floor", [(prior, False), ("ocr_confidence_floor", True)]) and got["b"]["salience_tier"] == "excluded"
    assert said["d"] == ("heading", prior, [(prior, True)]) and said["e"] == ("prose", prior, [(prior, True)])
    assert got["a"]["salience_signals"][1]["implied_tier"] == got["a"]["salience_tier"] and "code" in got["a"]["salience_signals"][1]["detail"]


def test_build_cuts_code_and_fills_missing_rules(spark):
    code = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(20))
    segs = spark.createDataFrame([(1, "s1", "code", "primary", code, "python", 7), (2, "s2", "list", "primary", "word " * 300, None, 8), (3, "s3", "odd", "primary", "word " * 300, None, 9)], SEGMENT + ", code_language string, vector_id int")
    rules = spark.createDataFrame([(0, "code", "code_syntax", 64, 0), (1, "list", None, 64, None), (2, "odd", "table_atomic", None, None)], RULE)
    made, _ = build.build(segs, rules, DEFAULT)
    n = {r["segment_id"]: r["count"] for r in made.groupBy("segment_id").count().collect()}
    assert n["s1"] == 20 and n["s2"] >= 5 and n["s3"] >= 3
    assert made.where("vector_id = 8").count() == n["s2"] and made.where("max_tokens is null" if "max_tokens" in made.columns else "false").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        build.build(segs, spark.createDataFrame([(0, "code", "code_syntax", 8, 8)], RULE), DEFAULT)


class Stop(Exception):
    pass


def test_build_stops_and_goes_on(spark, tmp_path):
    rows = [(i, f"s{i}-{j}", "prose", "excluded" if i % 7 == 0 else "primary", f"text {i} {j} " * (5 + 40 * (i % 3))) for i in range(40) for j in range(2)] + [(50, "s50", "prose", "primary", " ")]
    segs = spark.createDataFrame(rows, SEGMENT)
    inventory = spark.createDataFrame([(i, f"DOC{i}", f"h{i}", ["p"]) for i in [*range(40), 50, 60]], "doc_id long, document_id string, content_hash string, permission_principals array<string>")
    rules = spark.createDataFrame([(0, "code", "code_syntax", 64, 0)], RULE)
    ask = lambda root, **more: build.Builds(spark, f"{tmp_path}/{root}", "b1").run(segs, inventory, rules, DEFAULT, "kb", "v1", batches=4, **more)
    told = lambda made: sorted((r["point_id"], r["doc_id"], r["chunk_index"], r["text"]) for r in made.collect())
    whole, rolled, ok = ask("a")
    assert ok and len({r[0] for r in told(whole)}) == whole.count()
    for stop in range(3):

        def after(b: int, stop: int = stop) -> None:
            if b == stop:
                raise Stop

        with pytest.raises(Stop):
            ask(f"b{stop}", after=after)
        builds = build.Builds(spark, f"{tmp_path}/b{stop}", "b1")
        assert builds.committed() == list(range(stop + 1))
        # What a stopped run has left of its next batch is not read, and is written over.
        whole.limit(3).write.parquet(f"{builds.root}/points/{stop + 1}")
        again, roll, fine = ask(f"b{stop}")
        assert fine and told(again) == told(whole)
        assert sorted(map(tuple, roll.collect())) == sorted(map(tuple, rolled.collect()))
    counts = {r["doc_id"]: (r["n_chunks"], r["skip_reason"]) for r in rolled.collect()}
    assert counts[7] == (0, "all_segments_excluded") and counts[50] == (0, "all_segments_excluded") and counts[60] == (0, "no_text_segments") and counts[1][0] >= 2
    assert sum(n for n, _ in counts.values()) == whole.count()
    one = whole.first()
    assert one["tenancy"]["permission_principals"] == ["p"] and one["provenance"]["source_document_version"] == f"h{one['doc_id']}" and len(one["vector"]) == 64
    with pytest.raises(ArtifactError):
        build.Builds(spark, f"{tmp_path}/a", "b1").run(segs, inventory, rules, DEFAULT, "kb", "v2", batches=4)


def test_damaged_payloads_count_where_they_are_kept(spark):
    """Query 1 keeps a damaged point, query 2 only fetches one, query 3 keeps nothing, query 4 finds nothing near."""
    point = lambda i, v, ok: (i, v, ok, ("kb1", None, ["p1"]))
    points = spark.createDataFrame(
        [point(10, [1.0, 0.0], False), point(11, [0.9, 0.1], True), point(20, [0.0, 1.0], True), point(21, [0.1, 0.9], True), point(22, [0.2, 0.8], False)],
        "point_id long, vec array<double>, payload_ok boolean, tenancy struct<kb_id:string,workspace_id:string,permission_principals:array<string>>",
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0])], "query_id long, qvec array<double>")
    kb, who = serve.Collection("kb1", points), serve.Principal("p1", ("kb1",))
    found, states = serve.retrieve(kb, asked, who, k=2, threshold=0.5)
    assert {r["query_id"]: (r["n_candidates"], r["n_survivors"], r["status"]) for r in states.collect()} == {1: (5, 2, "error"), 2: (5, 3, "matches"), 3: (5, 0, "filtered_to_zero")}
    assert sorted((r["query_id"], r["rank"], r["point_id"]) for r in found.collect()) == [(2, 1, 20), (2, 2, 21)]
    why, states = serve.retrieve(kb, asked, who, k=2, threshold=0.5, explain=True)
    assert {r["query_id"]: r["status"] for r in states.collect()} == {1: "error", 2: "matches", 3: "filtered_to_zero"}
    assert sorted((r["query_id"], r["point_id"], r["outcome"]) for r in why.where("query_id = 2").collect()) == [(2, 10, "score_threshold"), (2, 11, "score_threshold"), (2, 20, "returned"), (2, 21, "returned")]
    assert why.where("query_id = 1").count() == 0 and why.where("query_id = 3").count() == 5
    bare, states = serve.retrieve(serve.Collection("kb1", points.limit(0)), asked, who)
    assert bare.count() == 0 and {r["status"] for r in states.collect()} == {"no_matches"}
    assert states.select(F.sum("n_candidates")).first()[0] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_planted_references_end_in_all_states(spark):
    states = {r["status"]: r["count"] for r in QUERIES["xrefs"](spark, "/root/testdata/sf0.001").groupBy("status").count().collect()}
    assert set(states) == {"resolved", "ambiguous", "unresolved"} and len(set(states.values())) == 1


def test_build_counts_rows_without_text_and_rows_of_one_id(spark, tmp_path):
    rows = [(1, "one two", "en"), (2, None, "de"), (3, "  ", "fr"), (5, "", None), (6, "again", "en"), (6, "another", "fr"), (4, "left out", "en"), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # count(*) of the rows where doc_id % 4 <> 0, as its SQL has it
    assert QUERIES["build_chunks"](spark, str(tmp_path)).first()["n_documents"] == 6
