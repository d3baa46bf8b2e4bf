"""Sources, sinks, building, answering and the life of collections on small tables of their real shape."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import build, chunks, control, decompose, lifecycle, retrieval, segments, serve
from quern.session import scratch, scratch_root
from quern.sources import files, store


def test_scan_keeps_every_file(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b" / "copy.HTML").write_text("<p>x</p>")
    (tmp_path / "b" / "song.mp3").write_bytes(b"\0\1")
    (tmp_path / "none").write_bytes(b"")
    got = {r["source_path"]: r for r in files.duplicates(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.html", "b/copy.HTML", "b/song.mp3", "none"}
    assert got["b/copy.HTML"]["duplicate_of"] == "a.html" and got["a.html"]["duplicate_of"] is None
    assert got["b/song.mp3"]["finding_code"] == "unservable_audio" and got["none"]["media_type"] == files.OCTETS
    assert got["a.html"]["size_bytes"] == 8 and got["a.html"]["document_id"].startswith("DOC") and got["a.html"]["status"] == "collected"


def test_permission_gate_fails_closed(spark):
    docs = spark.createDataFrame([(1, "exact"), (2, None)], "doc_id long, permission_fidelity string")
    with pytest.raises(files.PermissionGap):
        files.collect([docs])
    assert files.collect([docs], acknowledged=True).count() == 2


def test_artifacts_check_version_and_columns(spark):
    root, df = scratch(spark, "a"), spark.createDataFrame([(1, "x")], "id long, t string")
    store.save_artifact(df, root, "r", "plan")
    assert store.load_artifact(spark, root, "r", "plan").collect() == df.collect()
    with pytest.raises(store.ArtifactError):
        store.load_artifact(spark, root, "r", "plan", version="2.0.0")
    with pytest.raises(store.ArtifactError):
        store.load_artifact(spark, root, "r", "plan", schema=spark.createDataFrame([], "other int").schema)
    with pytest.raises(store.ArtifactError):
        store.load_artifact(spark, root, "r", "build")


def test_export_names_every_file_and_notices_damage(spark, tmp_path):
    out = str(tmp_path / "kb")
    manifest = store.export(spark.range(25).select("id", F.lit("t").alias("t")).repartition(2), out, {"k": 1}, {"notes.txt": "n"}, per_file=5)
    held = json.loads((tmp_path / "kb" / "manifest.json").read_text())
    assert held["chunk_count"] == 25 and len(held["file_hashes"]) == manifest.count() >= 6 and store.verify_export(spark, out)
    part = next((tmp_path / "kb" / "chunks").glob("part-*"))
    part.write_text(part.read_text() + "{}\n")
    assert not store.verify_export(spark, out)


def test_promotion_rollback_and_restore(spark):
    held = store.Collections(spark, scratch(spark, "c"))
    held.write("v1", spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "doc_id long, kind string"))
    held.write("v2", spark.createDataFrame([(i, "a") for i in range(10)], "doc_id long, kind string"))
    lifecycle.promote(held, "kb", "v1", "kind")
    with pytest.raises(lifecycle.Refused):
        lifecycle.promote(held, "kb", "v2", "kind", previous={"a": 5, "b": 5})
    assert held.resolve("kb") == "v1" and held.names() == ["v1", "v2"]
    assert lifecycle.promote(held, "kb", "v2", "kind") == lifecycle.promote(held, "kb", "v2", "kind")
    assert held.record("kb") == {"target": "v2", "previous": "v1"}
    with pytest.raises(lifecycle.Refused):
        lifecycle.rollback(held, "kb", set(), lambda n: "m")
    assert lifecycle.rollback(held, "kb", {"m"}, lambda n: "m") == "v1" == held.resolve("kb")
    with pytest.raises(lifecycle.Refused):
        lifecycle.retire(held, "v1", "x", {"v1"})
    lifecycle.retire(held, "v2", "v2-cold", {"v1"})
    held.restore("v2-cold", "v3", spark.createDataFrame([(3,), (4,)], "doc_id long"))
    assert held.count("v3") == 8 and held.names() == ["v1", "v3"]
    with pytest.raises(lifecycle.Refused):
        lifecycle.promote(held, "kb", "v3", "kind", replayed=False)
    with pytest.raises(lifecycle.Refused):
        lifecycle.promote(held, "kb", "missing", "kind")


@pytest.mark.parametrize(
    ("kwargs", "last"),
    [
        ({"current": None}, ("collection_exists", "failed")),
        ({"current": {}}, ("non_empty", "failed")),
        ({"current": {}, "declared_empty": True}, ("tier_shift_warning", "skipped")),
        ({"current": {"a": 5}, "most": 4}, ("chunk_count_bounds", "failed")),
        ({"current": {"a": 79}, "previous": {"a": 100}}, ("chunk_count_tolerance", "failed")),
        ({"current": {"a": 100}, "previous": {"a": 99, "b": 1}}, ("no_class_zero_regression", "failed")),
        ({"current": {"a": 1}, "evaluated": True}, ("eval_baseline", "failed")),
        ({"current": {"a": 1}, "score": 0.5, "baseline": 0.56}, ("regression_threshold", "failed")),
        ({"current": {"a": 140}, "previous": {"a": 100}, "tolerance": 50.0}, ("tier_shift_warning", "warning")),
    ],
)
def test_gates_stop_at_the_first_failure(kwargs, last):
    assert lifecycle.gates(**kwargs)[-1] == last


def test_states_only_follow_the_table():
    assert lifecycle.may_follow("PROMOTING", "LIVE") and not lifecycle.may_follow("LIVE", "INGESTING")
    assert not lifecycle.may_follow("TOMBSTONE_REPLAY", "LIVE") and not lifecycle.may_follow("LIVE", "HOT_STANDBY") and lifecycle.may_follow("RETIRING", "HOT_STANDBY")
    assert len(lifecycle.STATES) == 19 and all(s in lifecycle.STATES for some in lifecycle.STATES.values() for s in some)


def test_configuration_layers_and_diff():
    config = store.load_config('{"a": {"b": 1}, "c": "x"}', {"QUERN_A__B": "2", "QUERN_D": "text", "OTHER": "1"}.items())
    assert config == {"a": {"b": 2}, "c": "x", "d": "text"}
    diff = lifecycle.diff_configs({"a": 1, "b": [1]}, {"b": [2], "c": 0})
    assert (diff["a_only"], diff["b_only"], list(diff["changed"]), diff["same"], diff["config_version_changed"]) == (["a"], ["c"], ["b"], False, True)
    assert store.load_descriptions([{"segment_class": " prose ", "description": "d "}]) == [{"segment_class": "prose", "description": "d"}]
    with pytest.raises(ValueError):
        store.load_descriptions([{"segment_class": "a", "description": "d"}, {"segment_class": "a", "description": "e"}])
    with pytest.raises(lifecycle.Refused):
        lifecycle.incremental_allowed("v1", "v2")
    assert lifecycle.banner("reviewed", 3, 0).startswith("REVIEWED") and "PROVISIONAL" in lifecycle.banner("reviewed", 3, 1)
    assert len(lifecycle.reference_fingerprint()) == 64 and "| b | 2 |" in lifecycle.report({"b": 2}, [("too_short", 1)])


def test_plan_has_its_parts_in_order(spark):
    docs = spark.createDataFrame([(1, "exact")], "doc_id long, permission_fidelity string")
    segs = spark.createDataFrame([("heading", 1, "en"), ("prose", 0, "de")], "segment_type string, path_depth int, language string")
    rules = spark.createDataFrame([("prose", 512)], "segment_class string, max_tokens int")
    out = lifecycle.plan(docs, segs, rules, spark.createDataFrame([("x", 1, "too_short")], "exclusion_id string, doc_id long, reason string"), [], {"kb": "k"})
    assert {r["segment_type"]: r["has_structure"] for r in out["statistics"].collect()} == {"heading": True, "prose": True}
    assert out["decisions"].first()["decision"] == "other" and out["config_version"] == store.config_version(out["config"])


def test_jobs_pause_at_the_budget_and_name_failures():
    def bad(j):
        raise ValueError("no")

    jobs = [{"job_id": i, "kind": k, "priority": p, "created_at": i, "projected": c} for i, k, p, c in ((1, "ok", 0, 5.0), (2, "bad", 9, 0.0), (3, "ok", 5, 5.0), (4, "ok", 0, 1.0))]
    assert lifecycle.run_jobs(jobs, {"ok": lambda j: None, "bad": bad}, 0.0, 9.0) == [(2, "failed: no"), (3, "done"), (1, "paused"), (4, "done")]


def collection(spark, **about):
    t = "struct<kb_id:string,workspace_id:string,permission_principals:array<string>>"
    rows = [(i, [1.0, i / 10.0], ("kb", None, ["p1"] if i % 2 else ["p2"]), i != 5) for i in range(8)]
    return serve.Collection("kb", spark.createDataFrame(rows, f"point_id long, vec array<double>, tenancy {t}, payload_ok boolean"), **about)


def test_retrieval_fails_closed(spark):
    asked = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, qvec array<double>")
    who = serve.Principal("p1", ("kb",))
    for w, about, kw, code in ((None, {}, {}, "ACCESS_DENIED"), (serve.Principal("p1", ("other",)), {}, {}, "ACCESS_DENIED"), (serve.Principal("a", admin=True), {}, {}, "ACCESS_DENIED"), (serve.Principal("p1", ("kb",), "w2"), {"workspace_id": "w1"}, {}, "ACCESS_DENIED"), (who, {"status": "INGESTING"}, {}, "KB_NOT_READY"), (who, {"model": "m"}, {}, "MODEL_MISMATCH"), (serve.Principal("a", admin=True), {}, {"break_glass": True}, "AUDIT_FAILED")):
        with pytest.raises(serve.Denied) as e:
            serve.retrieve(collection(spark, **about), asked, w, **kw)
        assert e.value.code == code
    found, states = serve.retrieve(collection(spark), asked, who, k=2)
    assert [r["point_id"] for r in found.orderBy("rank").collect()] == [1, 3] and states.first()["status"] == "matches"
    assert serve.retrieve(collection(spark), asked, who, k=3)[1].first()["status"] == "error"
    named, _ = serve.retrieve(collection(spark), asked, who, k=2, threshold=0.9, explain=True)
    assert {r["point_id"]: r["outcome"] for r in named.collect()} == {1: "returned", 3: "returned", 5: "score_threshold", 7: "score_threshold"}
    audit: list = []
    every, _ = serve.retrieve(collection(spark), asked, serve.Principal("a", admin=True), k=4, break_glass=True, audit=audit)
    assert {r["point_id"] for r in every.collect()} == {0, 1, 2, 3} and len(audit) == 1
    assert serve.retrieve(collection(spark), asked, who, k=2, threshold=1.1, explain=True)[1].first()["status"] == "filtered_to_zero"


def test_minhash_neighbours_reach_nine_tenths(spark):
    rng = random.Random(3)
    base = [[rng.randrange(1 << 40) for _ in range(60)] for _ in range(40)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b[: 60 - i % 25] + [rng.randrange(1 << 40) for _ in range(i % 12)]) for i, b in enumerate(base)]
    sets = spark.createDataFrame(rows, "doc_id long, s array<long>")
    got = {(r["doc_a"], r["doc_b"]) for r in serve.minhash_neighbours(sets).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    assert got <= want and len(got) >= 0.9 * len(want) > 20


def test_build_over_segments(spark):
    segs = spark.createDataFrame([(1, "s1", "prose", "primary", "word " * 300), (1, "s2", "code", "primary", "def a():\n    pass\n"), (2, "s3", "prose", "excluded", "x"), (3, "s4", "prose", "primary", "  ")], "doc_id long, segment_id string, segment_type string, salience_tier string, text string")
    rules = spark.createDataFrame([(0, "code", "code_syntax", 64, 0)], "rule_order int, segment_class string, strategy string, max_tokens int, overlap_tokens int")
    made, skipped = build.build(segs, rules, {"strategy": "recursive_char", "max_tokens": 128, "overlap_tokens": 16})
    n = {r["segment_id"]: r["count"] for r in made.groupBy("segment_id").count().collect()}
    assert n["s1"] >= 3 and n["s2"] == 1 and set(n) == {"s1", "s2"}
    assert {r["segment_id"]: r["skip_reason"] for r in skipped.collect()} == {"s3": "excluded_salience_tier", "s4": "no_text"}
    assert [t["op"] for t in made.first()["transforms"]] == list(build.TIER1)
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    got = {r["doc_id"]: (r["n_chunks"], r["skip_reason"]) for r in build.roll_up(docs, made, skipped, spark.createDataFrame([(4, 7)], "doc_id long, n_chunks long")).collect()}
    assert got[2] == (0, "all_segments_excluded") and got[4] == (7, None) and got[1][0] == sum(n.values())
    assert build.validate(made, made.count(), docs)[0] and not build.validate(made, 0, docs)[0]
    a = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "y")], "o string, n string").select(build.unified_diff("o", "n").alias("d"))
    assert [r["d"] for r in a.collect()] == ["--- original\n+++ rewritten\n@@ -1,2 +1,2 @@\n a\n-b\n+c", build.SAME, "--- original\n+++ rewritten\n@@ -0,0 +1 @@\n+y"]


def test_passes_run_in_order(spark):
    segs = spark.createDataFrame(
        [(1, "s1", "prose", "Confidential notice to all readers", None, None), (1, "s2", "prose", "other text that stays as it is", 0.5, "code"), (2, "s3", "prose", "an old version of the text here", None, None), (3, "s4", "prose", "one line of text\nshared line number one\nshared line number two\nshared line number three", None, "list")],
        "doc_id long, segment_id string, segment_type string, text string, ocr_confidence double, region_hint string",
    )
    blocks = spark.createDataFrame([("confidential notice to all readers",), ("shared line number one",), ("shared line number two",), ("shared line number three",)], "block string")
    roles = spark.createDataFrame([(2, "superseded")], "doc_id long, dedup_role string")
    kept, gone = decompose.decompose(segs, blocks, roles)
    got = {r["segment_id"]: r for r in kept.collect()}
    assert set(got) == {"s1", "s2", "s4"} and [r["reason"] for r in gone.collect()] == ["superseded_version"]
    assert (got["s1"]["segment_type"], got["s1"]["salience_tier"]) == ("boilerplate", "boilerplate") and got["s4"]["segment_type"] == "boilerplate"
    assert (got["s2"]["segment_type"], got["s2"]["salience_tier"]) == ("code", "excluded") and [s["won"] for s in got["s2"]["salience_signals"]] == [False, True]
    both, none = decompose.decompose(segs, blocks, roles, index_superseded=True)
    assert both.where("segment_id = 's3'").first()["salience_tier"] == "excluded" and none.count() == 0


def test_cross_references_resolve_by_path_and_place(spark):
    rows = [(1, 0, "heading", "4.2 Setup", "4.2 Setup"), (1, 1, "prose", "", "see section 9.1 and see table 2"), (1, 2, "table", "", "a | b"), (1, 3, "table", "", "c | d"), (1, 4, "prose", "", "as shown in table 2 here"), (1, 5, "prose", "", "refer to section 4.2 now"), (1, 6, "figure_caption", "", "Fig"), (1, 7, "prose", "", "see fig 1"), (1, 8, "prose", "", "see chapter 7"), (1, 9, "prose", "7 Long", "7 x"), (1, 10, "prose", "7 Long", "more")]
    found = spark.createDataFrame([(d, i, k, p, t, None, f"s{i}") for d, i, k, p, t in rows], "doc_id long, document_order int, segment_type string, structural_path string, text string, exclusion string, segment_id string")
    got = {r["source_segment"]: (r["status"], r["target_segment"]) for r in segments.cross_references(segments.candidates(found), found).collect()}
    assert got == {"s1": ("unresolved", None), "s4": ("resolved", "s3"), "s5": ("resolved", "s0"), "s7": ("resolved", "s6"), "s8": ("ambiguous", None)}


@pytest.mark.parametrize(("target", "want"), [(2, {"a": 1, "b": 1}), (10, {"a": 9, "b": 1, "c": 1}), (100, {"a": 40, "b": 3, "c": 1}), (0, {})])
def test_stratified_sample_holds_quotas(spark, target, want):
    rows = [(i, "a") for i in range(40)] + [(100 + i, "b") for i in range(3)] + [(200, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, kind string")
    got = {r["kind"]: r["count"] for r in control.stratified_sample(docs, "kind", target, F.sha2(F.col("doc_id").cast("string"), 256)).groupBy("kind").count().collect()}
    assert got == want


def test_brace_languages_split_at_their_units():
    code = "int x;\nint add(int a, int b) {\n    if (a) {\n        return b;\n    }\n    return a;\n}\n\npublic void run() {\n}\n"
    assert [code[a:b].split("(")[0].split("\n")[0] for a, b, _ in chunks.code_units(code, 400, "java")] == ["int x;", "int add", "public void run"]
    assert chunks.code_units(code, 400, "unknown")[0][:2] == (0, len(code))
    rust = "use a;\npub async fn go() {\n}\nfn main() {\n}\n"
    assert len(chunks.code_units(rust, 400, "rust")) == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Checkpoint:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Checkpoint)}))

    with pytest.raises(RuntimeError):
        scratch_root(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def test_a_restored_table_goes_live_only_after_its_tombstones(spark):
    held = store.Collections(spark, scratch(spark, "c"))
    held.write("v1", spark.createDataFrame([(i % 6, "a") for i in range(12)], "doc_id long, kind string"))
    held.snapshot("v1", "cold")
    held.restore_raw("cold", "v2")
    assert held.awaits_replay("v2") and not held.awaits_replay("v1") and held.count("v2") == 12
    with pytest.raises(lifecycle.Refused):
        lifecycle.promote(held, "kb", "v2", "kind")
    with pytest.raises(store.ArtifactError):
        held.restore_raw("cold", "v1")
    gone = spark.createDataFrame([(2,), (2,), (5,), (99,)], "doc_id long")
    assert held.replay("v2", "v3", gone) == 2 and sorted({r[0] for r in held.read("v3").select("doc_id").collect()}) == [0, 1, 3, 4]
    lifecycle.promote(held, "kb", "v3", "kind")
    assert held.resolve("kb") == "v3" and held.awaits_replay("v2")
    # No way back to what still awaits its tombstones; a mark goes with its table.
    held.point("other", "v2")
    held.point("other", "v1")
    with pytest.raises(lifecycle.Refused):
        lifecycle.rollback(held, "other", {"m"}, lambda _: "m")
    held.remove("v2")
    assert not held.awaits_replay("v2") and not held.exists("v2")
