"""Changes by the bucket: only touched ones are written, all tables change at once, a crash changes nothing."""

from __future__ import annotations

import pytest

from quern.session import scratch
from quern.sources import buckets

POINTS = "point_id string, doc_id long, v long, text string"


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark):
    s = buckets.BucketStore(spark, scratch(spark, "buckets"))
    points = spark.createDataFrame([(f"p{d}-{i}", d, 1, f"t{d}") for d in range(40) for i in range(3)] + [(None, 99, 1, "no key")], POINTS)
    asked = spark.createDataFrame([(q, q % 40, 1) for q in range(60)], "question_id long, doc_id long, v long")
    s.begin().create("live", points, "point_id", "v", "doc_id", 16).create("previous", points.where("doc_id < 20"), "point_id", "v", "doc_id", 16).create("questions", asked, "question_id", "v", "doc_id", 8).commit()
    return s


def test_only_touched_buckets_are_written(spark, store):
    before = store.state()["live"].files
    new = spark.createDataFrame([("p3-0", 3, 2, "new"), ("p3-0", 3, 5, "newest"), ("p3-1", 3, 0, "old"), ("p3-9", 3, 1, "more"), (None, 99, 7, "key")], POINTS)
    change = store.begin().upsert("live", new)
    assert change.rewritten <= 2
    change.commit()
    after = store.state()["live"].files
    assert sum(before[b] != after[b] for b in before) == change.rewritten and len(before) > 8
    rows = {r["point_id"]: (r["v"], r["text"]) for r in store.read("live").collect()}
    assert rows["p3-0"] == (5, "newest") and rows["p3-1"] == (1, "t3") and rows["p3-9"] == (1, "more") and rows[None] == (7, "key") and len(rows) == 122


def test_documents_go_from_all_tables_at_once(spark, store):
    first = store.current()
    gone = spark.createDataFrame([(3,), (7,), (7,), (1234,)], "doc_id long")
    buckets.delete_documents(store, gone)
    for t in ("live", "previous", "questions"):
        want = [r for r in told(store.read(t, first)) if r[1] not in (3, 7)]
        assert told(store.read(t)) == want and len(want) < len(told(store.read(t, first)))


@pytest.mark.parametrize("after", [1, 2, 3])
def test_a_crash_leaves_the_old_state(spark, store, monkeypatch, after):
    old, n = {t: told(store.read(t)) for t in ("live", "previous", "questions")}, 0
    real = buckets.Change._write

    def failing(self, *args):
        nonlocal n
        n += 1
        out = real(self, *args)
        if n == after:
            raise OSError("stopped")
        return out

    monkeypatch.setattr(buckets.Change, "_write", failing)
    gone = spark.createDataFrame([(3,)], "doc_id long")
    with pytest.raises(OSError, match="stopped"):
        buckets.delete_documents(store, gone)
    assert {t: told(store.read(t)) for t in old} == old
    monkeypatch.setattr(buckets.Change, "_write", real)
    buckets.delete_documents(store, gone)
    assert all(r[1] != 3 for t in old for r in told(store.read(t)))
    assert store.vacuum(1) > 0 and len(told(store.read("live"))) == 118


def test_a_late_commit_is_refused(spark, store):
    a, b = store.begin(), store.begin()
    gone = spark.createDataFrame([(3,)], "doc_id long")
    a.delete("live", gone).commit()
    with pytest.raises(buckets.Conflict):
        b.delete("live", spark.createDataFrame([(4,)], "doc_id long")).commit()
    assert {3, 4} & {r["doc_id"] for r in store.read("live").collect()} == {4}


def test_empty_tables(spark, store):
    none = spark.createDataFrame([], POINTS)
    store.begin().create("none", none, "point_id", "v", "doc_id").upsert("live", none).commit()
    assert store.read("none").count() == 0 and store.read("live").count() == 121
    store.begin().delete("live", store.read("live")).commit()
    assert store.read("live").count() == 0
