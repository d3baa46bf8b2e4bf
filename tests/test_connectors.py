"""Feeds of pages read as a table and as a stream that is killed and goes on; folders listed and hashed in tasks."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quern.sources import connectors, files, tree

DOCS = "item_id string, version long, kind string, deleted boolean, fidelity string, principals array<string>, text string"


def feed(spark, root, rows, **more):
    return connectors.record(spark.createDataFrame(rows, DOCS), f"file://{root}", 10, **more)


def row(i, text="t", kind="file", deleted=False, fidelity="full"):
    return (f"i{i}", i, kind, deleted, fidelity, ["p"], text if text != "t" else f"text {i}")


def test_pages_become_rows(spark, tmp_path):
    rows = [row(i) for i in range(25)] + [row(60, None), row(61, kind="folder"), row(62, deleted=True), row(63, fidelity="unavailable", text="")]
    assert feed(spark, tmp_path, rows) == 7  # pages of versions 30 to 59 are empty
    ask = lambda **more: connectors.read(spark, connectors.RecordedFeed, root=f"file://{tmp_path}", **more)
    with pytest.raises(Exception, match="no permissions"):
        ask().collect()
    got = {r["item_id"]: r for r in ask(acknowledged=True).collect()}
    assert len(got) == 29 and {r["cursor"] for r in got.values()} == {"start", "start-1", "start-2", "start-6"}
    assert got["i3"]["content"] == b"text 3" and got["i3"]["permission_principals"] == ["p"]
    assert [(got[f"i{i}"]["status"], got[f"i{i}"]["content"]) for i in (60, 61, 62, 63)] == [("unreadable", None), ("listed", None), ("listed", None), ("collected", b"")]
    later = ask(acknowledged=True, cursor="start-2")
    assert later.count() == 9 and ask(cursor="nowhere").count() == 0
    assert ask(acknowledged=True).rdd.getNumPartitions() == 7


def test_bytes_are_not_fetched_before_permissions_are_known():
    asked = []

    class Source(connectors.RecordedFeed):
        def fetch_document(self, document):
            asked.append(document["item_id"])
            return b""

    page = connectors.Page([{"item_id": "a", "fidelity": "full"}, {"item_id": "b"}], None, "x")
    with pytest.raises(files.PermissionGap):
        list(connectors.collected(Source("file:///nowhere"), page, None, False))
    assert asked == [] and len(list(connectors.collected(Source("file:///nowhere"), page, None, True))) == 2 and asked == ["a", "b"]


def test_stream_is_killed_and_goes_on(spark, tmp_path):
    root, out = tmp_path / "feed", f"{tmp_path}/out"
    feed(spark, root, [row(i) for i in range(95)], then="more")

    def start(fail_at=None):
        def sink(batch, n):
            if n == fail_at:
                raise RuntimeError("killed")
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}")

        rows = connectors.read_stream(spark, connectors.RecordedFeed, root=f"file://{root}")
        return rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint").start()

    def until_killed(n):
        run = start(fail_at=n)
        with pytest.raises(Exception, match="killed"):
            run.processAllAvailable()
        run.stop()

    def to_the_end():
        run = start()
        run.processAllAvailable()
        run.stop()
        return sorted(r["item_id"] for r in spark.read.parquet(*(f"{out}/{n}" for n in os.listdir(out))).collect())

    until_killed(0)
    assert not os.path.exists(out)
    assert to_the_end() == sorted(f"i{i}" for i in range(95))
    # The feed goes on where its last page said; the same checkpoint reads only what is new.
    feed(spark, root, [row(i) for i in range(95, 130)], first="more", then="even-more")
    until_killed(1)
    feed(spark, root, [row(i) for i in range(130, 140)], first="even-more", then="and-more")
    assert to_the_end() == sorted(f"i{i}" for i in range(140))
    assert len(os.listdir(out)) >= 2 and spark.read.parquet(f"{out}/0").count() == 95
    assert to_the_end() == sorted(f"i{i}" for i in range(140))  # nothing new


def test_feed_must_say_where_it_goes_on(spark, tmp_path):
    (tmp_path / "start.json").write_text(json.dumps({"documents": []}))
    with pytest.raises(Exception, match="names no cursor"):
        connectors.read(spark, connectors.RecordedFeed, root=f"file://{tmp_path}").collect()


def test_tree_lists_and_hashes_every_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "FOLDERS", 2)
    for i in range(7):
        d = tmp_path / f"d{i}" / "deep" / "er"
        d.mkdir(parents=True)
        (d / f"a{i}.html").write_text(f"page {i % 3}")
        (d / "empty.txt").write_text("")
    (tmp_path / "blank name é%20.pdf").write_bytes(b"x" * 200_000)
    (tmp_path / "nothing").mkdir()
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    got = {r["source_path"]: r for r in tree.inventory(spark, f"file://{tmp_path}").collect()}
    want = {os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names}
    assert set(got) == want - {"gone.txt"}
    for p, r in got.items():
        assert r["content_hash"] == hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() and r["size_bytes"] == (tmp_path / p).stat().st_size and r["status"] == "collected"
    assert got["d1/deep/er/a1.html"]["parser"] == "html" and abs(got["d1/deep/er/a1.html"]["source_modified_at"].timestamp() - (tmp_path / "d1/deep/er/a1.html").stat().st_mtime) < 86_400
    assert tree.inventory(spark, f"file://{tmp_path}/nothing").count() == 0
    assert [(r["status"], r["content_hash"]) for r in tree.inventory(spark, f"file://{tmp_path}/missing").collect()] == [("unreadable", None)]
    old = {r["source_path"]: r["content_hash"] for r in files.scan(spark, str(tmp_path / "d1")).collect()}
    assert old == {p.removeprefix("d1/"): r["content_hash"] for p, r in got.items() if p.startswith("d1/")}


def test_large_file_is_hashed_in_blocks(tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 5)
    h = hashlib.sha256()
    for _ in range(2 << 10):
        h.update(bytes(1 << 20))
    h.update(bytes(5))
    assert tree.digest(f"file://{tmp_path}", "big.bin") == h.hexdigest()
    assert tree.digest(f"file://{tmp_path}", "none") is None
