"""Hash trees: a plain tree of the same rows, damage found and located, one file checked by its path, odd rows."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.sources import merkle
from quern.sources.store import ArtifactError


def sha(x) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


def plain(rows: list[tuple], levels: int) -> dict[str, str]:
    """All nodes of a tree over (name, content) pairs, None for null."""
    found = [sha(("-" if n is None else sha(n)) + ("-" if c is None else c) + str(k)) for (n, c), k in Counter(rows).items()]
    out: dict[str, str] = {}
    below = [(x[:levels], x) for x in found]
    for d in range(levels, -1, -1):
        groups: dict[str, list[str]] = {}
        for p, x in below:
            groups.setdefault(p[:d], []).append(x)
        level = {p: sha("".join(sorted(v))) for p, v in groups.items()}
        out |= level
        below = [(p, p + h) for p, h in level.items()]
    return out


def nodes(df) -> dict[str, str]:
    return {r.prefix: r.digest for r in df.collect()}


def test_levels_keep_buckets_small():
    assert [merkle.depth(n) for n in (0, 1, 16, 17, 256, 257, 10**9)] == [0, 0, 0, 1, 1, 2, 7]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_nodes_equal_a_plain_tree(spark, levels):
    rows = [(f"f{i}", sha(i % 40)) for i in range(300)] + [("f1", sha(1))] * 3 + [("f1", "other"), (None, sha(5)), ("gone", None), (None, None)]
    found = merkle.leaves(spark.createDataFrame(rows, "name string, content string"), "name", "content")
    assert nodes(merkle.nodes(found, levels)) == plain(rows, levels)


def test_a_tree_without_rows_has_a_root(spark):
    found = merkle.leaves(spark.createDataFrame([], "name string, content string, leaf int"), "name", "content")
    assert found.count() == 0 and merkle.root_of(merkle.nodes(found, 0)) == hashlib.sha256(b"").hexdigest()


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("content"))
    made = [nodes(merkle.nodes(merkle.leaves(x, "name", "content"), 2)) for x in (df, df.orderBy(F.desc("name")).repartition(7))]
    assert made[0] == made[1] and len(made[0]) > 200


def test_differences_are_located(spark):
    before = [(f"f{i}", sha(i)) for i in range(400)] + [("many", sha(i)) for i in range(50)] + [("twice", "x"), ("twice", "x"), (None, "n")]
    after = [r for r in before if r[0] not in ("f3", "f4", None) and r != ("many", sha(7))] + [("f3", "other"), ("new", "y")]
    after.remove(("twice", "x"))
    a, b = (merkle.leaves(spark.createDataFrame(x, "name string, content string"), "name", "content") for x in (before, after))
    for levels in (0, 1, 2):
        got = {r.name: r.state for r in merkle.diff(a, b, levels).collect()}
        assert got == {"f3": "changed", "f4": "missing", "new": "extra", "many": "missing", "twice": "changed", None: "missing"}
        assert merkle.diff(a, a, levels).count() == 0
    empty = a.limit(0)
    assert {r.state for r in merkle.diff(empty, b, 1).collect()} == {"extra"} and merkle.diff(empty, empty, 0).count() == 0


@pytest.fixture
def sealed(spark, tmp_path):
    root = tmp_path / "kb"
    for i in range(40):
        p = root / "chunks" / f"{i % 3}" / f"part {i:02}.json"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("{}" * i)
    (root / "config.json").write_text("{}")
    (root / "_SUCCESS").write_text("")
    (root / "chunks" / ".x.crc").write_text("hidden")
    return root, merkle.seal(spark, root.as_uri(), {"kb": "k"})


def test_a_sealed_folder(spark, sealed):
    root, top = sealed
    about = json.loads((root / "_manifest" / "root.json").read_text())
    assert about == {"about": {"kb": "k"}, "files": 41, "levels": 1, "root": top}
    assert merkle.audit(spark, root.as_uri(), top).count() == 0
    names = ["config.json"] + [f"chunks/{i % 3}/part {i:02}.json" for i in range(40)]
    held = {n: hashlib.sha256((root / n).read_bytes()).hexdigest() for n in names}
    assert plain(list(held.items()), 1)[""] == top
    assert merkle.seal(spark, root.as_uri(), {"kb": "k"}) == top

    (root / "chunks" / "0" / "part 03.json").write_text("{} ")
    (root / "chunks" / "1" / "part 04.json").unlink()
    (root / "more.json").write_text("1")
    got = {r.name: r.state for r in merkle.audit(spark, root.as_uri(), top).collect()}
    assert got == {"chunks/0/part 03.json": "changed", "chunks/1/part 04.json": "missing", "more.json": "extra"}
    check = lambda n: merkle.holds(spark, root.as_uri(), n, top)
    assert check("config.json") and check("chunks/2/part 05.json")
    assert not check("chunks/0/part 03.json") and not check("chunks/1/part 04.json") and not check("more.json")


def test_a_manifest_that_was_tampered_with(spark, sealed):
    root, top = sealed
    held = root / "_manifest"
    with pytest.raises(ArtifactError, match="trusted"):
        merkle.audit(spark, root.as_uri(), "0" * 64)
    # Somebody changes a file and its leaf, but cannot change the root.
    (root / "config.json").write_text("[]")
    forged = merkle.leaves(spark.createDataFrame([("config.json", sha("[]"))], "name string, content string"), "name", "content")
    rest = spark.read.parquet(f"{held}/leaves").drop("prefix").where("name <> 'config.json'").unionByName(forged).toPandas()
    spark.createDataFrame(rest).withColumn("prefix", F.substring("leaf", 1, 1)).write.mode("overwrite").parquet(f"{held}/leaves")
    with pytest.raises(ArtifactError, match="damaged"):
        merkle.audit(spark, root.as_uri(), top)
    assert not merkle.holds(spark, root.as_uri(), "config.json", top)
