"""Families kept up to date, against one run over all texts after each batch."""

from __future__ import annotations

import random

import pytest

from quern.operators import dedup, families
from quern.session import scratch


def whole(docs):
    return {r["node"]: r["label"] for r in dedup.members(docs)[0].collect()}


def test_families_equal_a_full_run_after_every_batch(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(40)] for _ in range(6)]
    made = []
    for i in range(120):
        w = list(bases[i % 6])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(40)] = word()
        made.append(" ".join(w))
    made += [" ".join([*bases[0][:30], *bases[1][10:]])]  # ties two families together
    made += [" ".join(word() for _ in range(30)) for _ in range(20)] + ["short", None]
    rows = [(1000 - i if i % 2 else i, t) for i, t in enumerate(made)] + [(2000, made[3]), (-5, made[4])]
    rng.shuffle(rows)
    kept, seen = families.Families(spark, scratch(spark, "families"), buckets=4), []
    for a in range(0, len(rows), 40):
        batch = rows[a : a + 40]
        seen += batch
        kept.add(spark.createDataFrame(batch, "doc_id long, text string"))
        got = {r["doc_id"]: r["label"] for r in kept.read().collect()}
        assert got == whole(spark.createDataFrame([r for r in seen if r[1] is not None], "doc_id long, text string")) and len(got) > 10
    assert kept.add(spark.createDataFrame(rows[:40], "doc_id long, text string")) == 0
    assert {r["doc_id"]: r["label"] for r in kept.read().collect()} == got and kept.read().count() == len(got)


def test_a_line_of_very_many_texts_brings_no_two_of_them_together(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    texts = [f"{' '.join(word() for _ in range(30))} {line}" for _ in range(400)]
    rows = [*enumerate(texts), *((1000 + i, f"{t} more") for i, t in enumerate(texts[:20]))]
    met, meetings = [], dedup.meetings
    monkeypatch.setattr(dedup, "meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    kept = families.Families(spark, scratch(spark, "families"), buckets=2)
    n = []
    verified = dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda pairs, *a: n.append(pairs.count()) or verified(pairs, *a))
    for batch in (rows[:200], rows[200:]):
        kept.add(spark.createDataFrame(batch, "doc_id long, text string"))
    assert sum(n) < 500 and {r["doc_id"]: r["label"] for r in kept.read().collect()} == whole(spark.createDataFrame(rows, "doc_id long, text string"))


def test_postings_meet_some_buckets_at_a_time_and_nothing_is_left_beside_the_store(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(40)]
    rows = [(i, " ".join([*base[: 40 - i % 7], *(word() for _ in range(i % 7))])) for i in range(60)] + [(100 + i, " ".join(word() for _ in range(30))) for i in range(60)]
    monkeypatch.setattr(dedup, "LARGE", 0)
    written = []
    for module in (families, dedup):
        monkeypatch.setattr(module, "materialize", lambda df, name, real=module.materialize: (written.append((name, out := real(df, name))), out)[1])
    kept = families.Families(spark, scratch(spark, "families"), buckets=6)
    for batch in (rows[:70], rows[70:]):
        kept.add(spark.createDataFrame(batch, "doc_id long, text string"))
    names = [n for n, _ in written]
    assert names.count("families-meeting") == 2 * families.ROUNDS and not any("array" in t for _, df in written for _, t in df.dtypes)
    assert {r["doc_id"]: r["label"] for r in kept.read().collect()} == whole(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_store_of_other_hashes_is_refused(spark):
    root = scratch(spark, "families")
    families.Families(spark, root, buckets=1)
    families.Families(spark, root, buckets=1)
    change = families.BucketStore(spark, root).begin()
    del change.tables[families.HASHES]
    change.commit()
    with pytest.raises(families.ArtifactError):
        families.Families(spark, root, buckets=1)
