"""Hashes of files in spans: the state of one task goes on in another, and no task reads more than its share."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quern.sources import files, tree


def test_states_go_on_where_they_stopped(tmp_path):
    data = random.Random(3).randbytes(200_001)
    (tmp_path / "f").write_bytes(data)
    for span in (1, 63, 64, 65, 65_536, 100_000, 200_000, 200_001, 200_002):
        state, start, made = None, 200_001 // span * span if span < 65 else 0, None
        if start:
            state = tree._go_on(tree._sha(), None, [data[:start]])[0]
        while made is None:
            made, state = tree.digest_span(f"file://{tmp_path}", "f", state, start, span)
            start += span
        assert made == hashlib.sha256(data).hexdigest() and state is None
    assert tree.digest_span(f"file://{tmp_path}", "none", None, 0, 10) == (None, None)


def test_no_task_reads_more_than_its_share(spark, tmp_path, monkeypatch):
    for name, x in (("BYTES", 1000), ("FILES", 100), ("SPAN", 1000)):
        monkeypatch.setattr(tree, name, x)
    rng, root = random.Random(1), tmp_path / "a b%20\u00e9"
    sizes = [0, 1, 999, 1000, 1001, 2000, 5003, 5003, *(rng.randrange(400) for _ in range(40))]
    (root / "in").mkdir(parents=True)
    for i, n in enumerate(sizes):
        (root / "in" / f"{i}.bin").write_bytes(rng.randbytes(n))
    rounds, write = [], tree.materialize

    def seen(df, name):
        if name == "tree-hashes":
            start = len(rounds) * 1000
            left = F.least(F.greatest(F.col("size_bytes") - start, F.lit(0)), F.lit(1000))
            rounds.append([r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(left)).collect()])
        return write(df, name)

    monkeypatch.setattr(tree, "materialize", seen)
    got = {r["source_path"]: r for r in files.scan(spark, str(root)).collect()}
    assert len(got) == len(sizes)
    for i, n in enumerate(sizes):
        r = got[f"in/{i}.bin"]
        assert (r["content_hash"], r["size_bytes"], r["status"]) == (hashlib.sha256((root / "in" / f"{i}.bin").read_bytes()).hexdigest(), n, "collected")
    assert len(rounds) == 6 and max(rounds[0]) < 2000 and all(max(r) <= 1000 for r in rounds[1:]) and len(rounds[0]) > 5


def test_scan_of_a_file_over_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    h = hashlib.sha256()
    for _ in range(2 << 10):
        h.update(bytes(1 << 20))
    h.update(bytes(5))
    assert [(r["source_path"], r["content_hash"], r["status"]) for r in files.scan(spark, str(tmp_path)).collect()] == [("big.bin", h.hexdigest(), "collected")]


def test_scan_by_a_mount_table_and_odd_names(spark, tmp_path):
    """Paths with a host or a bucket in them were all taken for empty files, and a plus for a blank."""
    (tmp_path / "in").mkdir()
    for n in ("a+b.txt", "c d%20.txt", "none"):
        (tmp_path / "in" / n).write_text("" if n == "none" else n)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.spans.link./at", tmp_path.as_uri())
    want = {n: hashlib.sha256(b"" if n == "none" else n.encode()).hexdigest() for n in ("a+b.txt", "c d%20.txt", "none")}
    for root in (str(tmp_path / "in"), "viewfs://spans/at/in"):
        assert {r["source_path"]: r["content_hash"] for r in files.scan(spark, root).collect()} == want
