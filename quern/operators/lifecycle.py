"""A collection's life: gates before it goes live, promotion and rollback, deletion, restores, triggers, plans and records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.store import Collections, canonical, config_version

# The states of a build and those that may follow each.
STATES = {
    "TRIGGERED": ("SHADOW_CREATING",),
    "SHADOW_CREATING": ("INGESTING", "FAILED_SHADOW_CREATE"),
    "FAILED_SHADOW_CREATE": (),
    "INGESTING": ("INGESTING", "PAUSED", "VALIDATING", "FAILED_INGESTION"),
    "PAUSED": ("INGESTING",),
    "FAILED_INGESTION": ("INGESTING",),
    "VALIDATING": ("PROMOTING", "VALIDATION_FAILED"),
    "VALIDATION_FAILED": (),
    "PROMOTING": ("LIVE", "PROMOTE_FAILED"),
    "PROMOTE_FAILED": ("PROMOTING",),
    "LIVE": ("RETIRING", "ROLLED_BACK"),
    "ROLLED_BACK": ("LIVE",),
    "RETIRING": ("HOT_STANDBY",),
    "HOT_STANDBY": ("SNAPSHOTTING",),
    "SNAPSHOTTING": ("COLD",),
    "COLD": ("RESTORING", "PURGED"),
    "RESTORING": ("TOMBSTONE_REPLAY",),
    "TOMBSTONE_REPLAY": ("VALIDATING",),
    "PURGED": (),
}
# What to do about an exclusion, in short, and the reasons that a plan calls by another name.
REMEDIES = {
    "unservable_content": "nothing: convert it to a format with text if it is needed",
    "spreadsheet_database": "nothing: rows of a database are not prose; reclassify it if it is a report",
    "spreadsheet_model": "nothing: a model's values go stale; reclassify it if it holds text",
    "encrypted": "decrypt the file or remove it",
    "empty_region": "nothing: there is no text",
    "superseded_version": "nothing: a newer version is indexed; older ones can be indexed by a setting",
    "duplicate": "nothing: one copy is indexed",
    "parse_failed": "find out why the file cannot be parsed and run again",
    "too_short": "nothing: the span is too short for a chunk",
    "other": "see the exclusion report",
}
PLAN_REASONS = {"too_short": "other"}
#: The sweep's reference: sizes and strategy against which candidates are measured.
REFERENCE = {"strategy": "recursive_char", "max_tokens": 512, "overlap_tokens": 75, "retrieval": "dense", "tier": 1}


def may_follow(state: str, then: str) -> bool:
    return then in STATES[state]


def step(builds: DataFrame, then: Column) -> DataFrame:
    """Builds (build_id, state) with the state asked for, or their own where it may not follow."""
    allowed = F.create_map(*(x for k, v in STATES.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)).cast("array<string>"))))
    ok = F.array_contains(F.element_at(allowed, F.col("state")), then)
    return builds.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn("state", F.when(F.col("accepted"), then).otherwise(F.col("state")))


def gates(current: dict[str, int] | None, previous: dict[str, int] | None = None, least: int = 1, most: int | None = None, declared_empty: bool = False, tolerance: float = 20.0, score: float | None = None, baseline: float | None = None, evaluated: bool = False, limit: float = 0.05) -> list[tuple[str, str]]:
    """(gate, passed | failed | skipped | warning) in order, up to the first failure; ``current``: chunks by class, None without a table."""
    out: list[tuple[str, str]] = []

    def add(gate: str, failed: bool, skipped: bool = False) -> bool:
        out.append((gate, "skipped" if skipped else "failed" if failed else "passed"))
        return failed and not skipped

    n, before = sum((current or {}).values()), sum((previous or {}).values())
    if add("collection_exists", current is None) or add("non_empty", n == 0 and not declared_empty):
        return out
    if add("chunk_count_bounds", not declared_empty and (n < least or most is not None and n > most)):
        return out
    if add("chunk_count_tolerance", abs(n - before) > before * tolerance / 100, not before or declared_empty):
        return out
    if add("no_class_zero_regression", any(v > 0 and not current.get(k, 0) for k, v in (previous or {}).items()), previous is None):
        return out
    if add("eval_baseline", score is None, not evaluated and score is None):
        return out
    if add("regression_threshold", score is not None and baseline is not None and baseline - score > limit, score is None or baseline is None):
        return out
    shift = abs(n - before) / before if before and n else None
    out.append(("tier_shift_warning", "skipped" if shift is None else "warning" if shift > 0.30 else "passed"))
    return out


def by_class(points: DataFrame, on: str) -> dict[str, int]:
    """Chunks by class: as many rows as there are classes."""
    return {r[0]: r[1] for r in points.groupBy(on).count().collect()}


def gate_table(current: DataFrame, previous: DataFrame, on: str, tolerance: float = 20.0, least: int = 1) -> DataFrame:
    """The gates on counts as a table (gate, status), up to the first failure."""
    rows = gates(by_class(current, on), by_class(previous, on), least=least, tolerance=tolerance)
    return current.sparkSession.createDataFrame([(i, g, s) for i, (g, s) in enumerate(rows)], "place int, gate string, status string")


class Refused(RuntimeError):
    """A step of a collection's life that may not be taken."""


def promote(store: Collections, alias: str, shadow: str, on: str, replayed: bool = True, **about) -> list[tuple[str, str]]:
    """Gates, then the pointer; again with the same table it changes nothing. A restore must have had its tombstones, by its mark and by the caller's word."""
    if not replayed or store.awaits_replay(shadow):
        raise Refused("tombstones of the restored table are still to be replayed")
    results = gates(by_class(store.read(shadow), on) if store.exists(shadow) else None, **about)
    if any(s == "failed" for _, s in results):
        raise Refused(f"gate {results[-1][0]} failed")
    store.point(alias, shadow)
    return results


def rollback(store: Collections, alias: str, models: set[str], model_of: Callable[[str], str]) -> str:
    """Point at the table before, if the model of its vectors is there."""
    before = store.record(alias).get("previous")
    if not before or not store.exists(before):
        raise Refused("there is nothing to go back to")
    if store.awaits_replay(before):
        raise Refused(f"tombstones of {before} are still to be replayed")
    if model_of(before) not in models:
        raise Refused(f"the model of {before} is not available")
    store.point(alias, before)
    return before


def retire(store: Collections, name: str, label: str, live: set[str]) -> str:
    """Snapshot a table that nothing points at, then remove it."""
    if name in live:
        raise Refused(f"{name} is in use")
    store.snapshot(name, label)
    store.remove(name)
    return label


def delete_document(tombstones: DataFrame, doc_ids: DataFrame, at: Column) -> DataFrame:
    """Tombstones with those of more documents: the first deletion of each counts, all readers apply them."""
    new = doc_ids.select("doc_id", at.alias("deleted_at"))
    return tombstones.select("doc_id", "deleted_at").unionByName(new).groupBy("doc_id").agg(F.min("deleted_at").alias("deleted_at"))


def surviving_questions(questions: DataFrame, gone: DataFrame) -> DataFrame:
    """Questions none of whose sources (an array of segment ids) was deleted."""
    hit = questions.select("question_id", F.explode("sources").alias("segment_id")).join(gone.select("segment_id").distinct(), "segment_id", "left_semi").select("question_id").distinct()
    return questions.join(hit, "question_id", "left_anti")


def usable(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("review_status").isin("reviewed_kept", "reviewed_edited"))


def banner(level: str, total: int, unreviewed: int) -> str:
    """One line that says how far an evaluation's scores may be trusted."""
    if level == "provisional" or unreviewed > 0:
        return f"PROVISIONAL: {unreviewed} of {total} questions are unreviewed; scores are not authoritative"
    return f"{level.upper()}: all {total} questions are reviewed"


def reference_fingerprint(settings: dict = REFERENCE) -> str:
    return hashlib.sha256(canonical(settings).encode("utf-8")).hexdigest()


def diff_configs(a: dict, b: dict) -> dict:
    """Keys of one side only, changed values, and whether the versions differ; top level only."""
    changed = {k: {"a": a[k], "b": b[k]} for k in sorted(a.keys() & b.keys()) if canonical(a[k]) != canonical(b[k])}
    return {"same": canonical(a) == canonical(b), "a_only": sorted(a.keys() - b.keys()), "b_only": sorted(b.keys() - a.keys()), "changed": changed, "config_version_changed": config_version(a) != config_version(b)}


def weakened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classes (segment_class, confidence_floor, salience_filter: array) whose floor fell or went, or whose filter lets more through."""
    p = before.select("segment_class", F.col("confidence_floor").alias("f0"), F.array_distinct("salience_filter").alias("s0"))
    both = p.join(after.select("segment_class", F.col("confidence_floor").alias("f1"), F.array_distinct("salience_filter").alias("s1")), "segment_class")
    floor = both.where("f0 is not null and (f1 is null or f1 < f0)").select("segment_class", F.lit("confidence_floor").alias("field"))
    more = both.where((F.size(F.array_except("s0", "s1")) == 0) & (F.size("s1") > F.size("s0"))).select("segment_class", F.lit("default_salience_filter").alias("field"))
    return floor.unionByName(more)


def exclusion_decisions(exclusions: DataFrame) -> DataFrame:
    """Each exclusion once, with the plan's reason and what to do about it."""
    one = exclusions.groupBy("exclusion_id").agg(F.min(F.struct("doc_id", "reason")).alias("x")).select("exclusion_id", "x.doc_id", "x.reason")
    known = F.create_map(*(F.lit(x) for kv in REMEDIES.items() for x in kv))
    named = F.create_map(*(F.lit(x) for kv in PLAN_REASONS.items() for x in kv))
    reason = F.when(F.col("reason").isin(*REMEDIES), F.coalesce(F.element_at(named, F.col("reason")), F.col("reason"))).otherwise("other")
    return one.select("exclusion_id", "doc_id", reason.alias("decision"), F.coalesce(F.element_at(known, F.col("reason")), F.lit(REMEDIES["other"])).alias("remediation"))


def heading_structure(segments: DataFrame) -> DataFrame:
    """Whether a class has structure: headings anywhere give it to prose and headings, else a mean depth of two."""
    by = segments.groupBy("segment_type").agg(F.avg("path_depth").alias("mean_depth"), F.count(F.lit(1)).alias("n"))
    some = segments.where("segment_type = 'heading'").limit(1).count() > 0
    return by.select("segment_type", F.round("mean_depth", 6).alias("mean_depth"), ((F.lit(some) & F.col("segment_type").isin("prose", "heading")) | (F.col("mean_depth") >= 2)).alias("has_structure"))


def count_map(rows: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """How often each value occurs in a class, as a map; values are counted before they are gathered."""
    n = rows.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(of).cast("string"), "n")))).alias(name))


def plan(documents: DataFrame, segments: DataFrame, rules: DataFrame, exclusions: DataFrame, descriptions: list[dict], settings: dict, acknowledged: bool = False) -> dict:
    """A plan's parts in their order: the gate on permissions, descriptions, statistics, rules, exclusions, and the version of it all."""
    from quern.sources.files import permission_gate
    from quern.sources.store import load_descriptions

    permission_gate(documents, acknowledged)
    known = load_descriptions(descriptions)
    languages = count_map(segments, "segment_type", "language", "languages")
    rows = [r.asDict(recursive=True) for r in rules.orderBy("segment_class").collect()]
    config = settings | {"class_descriptions": known, "class_rules": rows}
    return {"statistics": heading_structure(segments).join(languages, "segment_type", "left"), "rules": rules, "decisions": exclusion_decisions(exclusions), "config": config, "config_version": config_version(config)}


def incremental_allowed(current: str, job: str) -> None:
    if current and job and current != job:
        raise Refused("the configuration changed: a full reindex is needed")


def triggers(state: DataFrame, now: Column) -> DataFrame:
    """What starts a reindex of each knowledge base: its configuration, its content, or its schedule, in that order."""
    why = F.when(~F.col("config_version").eqNullSafe(F.col("built_config_version")), "config_change").when(~F.col("fingerprint").eqNullSafe(F.col("built_fingerprint")), "change_detected").when(F.col("next_run_at") <= now, "scheduled")
    return state.withColumn("trigger", why).where("trigger is not null").select("kb_id", "trigger", F.when(F.col("trigger") == "config_change", "reindex_full").otherwise("reindex_incremental").alias("job"))


def audit_list(log: DataFrame, kb_id: str | None = None, workspace_id: str | None = None, since: object = None, limit: int = 100) -> DataFrame:
    """The newest records of a knowledge base or workspace."""
    for c, v in (("kb_id", kb_id), ("workspace_id", workspace_id)):
        if v is not None:
            log = log.where(F.col(c) == v)
    if since is not None:
        log = log.where(F.col("recorded_at") > F.lit(since))
    return log.orderBy(F.desc("recorded_at"), F.desc("audit_id")).limit(limit)


def hot_bytes(vectors: Column, dimensions: Column) -> Column:
    """Memory of one hot copy: four bytes for each number and 500 for each payload."""
    return vectors * dimensions * 4 + vectors * 500


def telemetry(events: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Counter, sum and cumulative buckets of a measure."""
    marks = [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).cast("double").alias("total"), *marks)


def run_jobs(jobs: list[dict], handlers: dict[str, Callable[[dict], object]], accrued: float, cap: float) -> list[tuple[str, str]]:
    """Jobs in order of priority and age: paused where the next would pass the budget, failed where one raises."""
    out = []
    for j in sorted(jobs, key=lambda x: (-x["priority"], x["created_at"])):
        if accrued + j.get("projected", 0.0) > cap:
            out.append((j["job_id"], "paused"))
            continue
        try:
            handlers[j["kind"]](j)
            accrued += j.get("projected", 0.0)
            out.append((j["job_id"], "done"))
        except Exception as e:  # a job's failure is its result
            out.append((j["job_id"], f"failed: {e}"))
    return out


def multi_document_pick(segments: DataFrame, n: int = 2) -> DataFrame:
    """The documents with most segments, from which questions over several documents are made."""
    return segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments")).orderBy(F.desc("n_segments"), "doc_id").limit(n)


def report(findings: dict[str, object], exclusions: list[tuple[str, int]]) -> str:
    """A short Markdown report of a run's figures."""
    lines = ["# Findings", "", "| figure | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in sorted(findings.items())), "", "# Exclusions", "", "| reason | rows |", "|-|-|"]
    return "\n".join([*lines, *(f"| {r} | {n} |" for r, n in sorted(exclusions))])


def snapshot_of(records: DataFrame, by: str, at: str) -> DataFrame:
    """Newest record of each name: the state that a control table holds."""
    turn = Window.partitionBy(by).orderBy(F.desc(at))
    return records.withColumn("place", F.row_number().over(turn)).where("place = 1").drop("place")
