"""Manifests as hash trees: one digest stands for a table of names and contents, and shows where two of them differ.

A leaf is the hash of a name's hash, a content's hash and how often both occur. Leaves fall into buckets by their own first
hex digits, so no name, however often it repeats, fills a bucket. A bucket's digest covers its leaves in order, a node's
those of up to sixteen nodes below it, and the last one is the root. There are as many levels as bring about
sixteen leaves to a bucket. Leaves and nodes are tables; the driver holds the root and the number of levels.

``seal`` writes such a manifest beside the files of a folder, ``audit`` finds what is damaged since, ``holds`` checks one
file by its path from leaf to root alone. ``diff`` compares two trees and joins leaves of differing buckets only.

Defined cases: repeated rows count; a null name is a name of its own, a null content (also a file that cannot be read) a
content of its own; a table without rows has a root, that of no bytes; files and folders whose names begin with a dot or
an underscore are no part of a folder's manifest.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialize
from quern.sources import tree
from quern.sources.store import ArtifactError, read_text, write_text

FAN = 16
#: The folder of a manifest, within the folder that it describes.
INSIDE = "_manifest"
_NONE = "-"


def depth(n_leaves: int) -> int:
    """Levels below the root: the fewest that leave no more than sixteen leaves to a bucket on average."""
    d = 0
    while FAN ** (d + 1) < n_leaves:
        d += 1
    return d


def _sha(c: Column) -> Column:
    return F.coalesce(F.sha2(c.cast("string"), 256), F.lit(_NONE))


def leaves(rows: DataFrame, name: str, content: str) -> DataFrame:
    """name, content, copies and leaf of a table; ``content`` holds digests."""
    by = rows.groupBy(F.col(name).cast("string").alias("name"), F.col(content).cast("string").alias("content")).agg(F.count(F.lit(1)).alias("copies"))
    return by.withColumn("leaf", F.sha2(F.concat(_sha(F.col("name")), F.coalesce("content", F.lit(_NONE)), F.col("copies").cast("string")), 256))


def _digest(parts: Column) -> Column:
    """Of a bounded group: sixteen leaves on average, at most sixteen nodes."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ""), 256)


def nodes(found: DataFrame, levels: int) -> DataFrame:
    """prefix and digest of all nodes, the root with an empty prefix; leaves are read once, each level from the one below."""
    level = found.groupBy(F.substring("leaf", 1, levels).alias("prefix")).agg(_digest(F.col("leaf")).alias("digest"))
    out = level = materialize(level, "merkle-level")
    for d in range(levels - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(_digest(F.concat("prefix", "digest")).alias("digest"))
        out = out.unionByName(level)
    return out


def root_of(tree_nodes: DataFrame) -> str:
    top = tree_nodes.where("prefix = ''").first()
    return top["digest"] if top else hashlib.sha256(b"").hexdigest()


def _differing(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """Buckets whose digests are not the same on both sides."""
    bottom = lambda t, c: t.where(F.length("prefix") == levels).select("prefix", F.col("digest").alias(c))
    return bottom(a, "x").join(bottom(b, "y"), "prefix", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix")


def diff(before: DataFrame, after: DataFrame, levels: int, nodes_before: DataFrame | None = None, nodes_after: DataFrame | None = None) -> DataFrame:
    """name and state (changed, missing, extra) of what differs between two tables of leaves; both trees have ``levels`` levels."""
    a, b = nodes_before if nodes_before is not None else nodes(before, levels), nodes_after if nodes_after is not None else nodes(after, levels)
    at = materialize(_differing(a, b, levels), "merkle-differing")
    side = lambda t, n: t.withColumn("prefix", F.substring("leaf", 1, levels)).join(at, "prefix", "left_semi").select("name", "leaf", F.lit(n).alias("side"))
    both = side(before, 1).unionByName(side(after, 2))
    # A leaf of both sides lies only beside one that differs.
    alone = both.groupBy("name", "leaf").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    by = alone.groupBy("name").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    state = F.when(F.col("a") < F.col("b"), "changed").when(F.col("a") == 1, "missing").otherwise("extra")
    return by.select("name", state.alias("state"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Leaves of a folder's files, hashed in tasks; the manifest's own and hidden ones are left out."""
    listed = tree.hashed(spark, root, tree.files_below(spark, root).where("NOT path RLIKE '(^|/)[._]'"))
    return leaves(listed, "path", "content_hash")


def seal(spark: SparkSession, root: str, about: dict) -> str:
    """Write the manifest of a folder (a URI) into it; the root's digest, which is the last thing written."""
    found = materialize(_files(spark, root), "merkle-leaves")
    n = found.count()
    levels = depth(n)
    found.withColumn("prefix", F.substring("leaf", 1, levels)).sort("prefix", "leaf").write.mode("overwrite").parquet(f"{root}/{INSIDE}/leaves")
    nodes(found, levels).sort("prefix").write.mode("overwrite").parquet(f"{root}/{INSIDE}/nodes")
    top = root_of(spark.read.parquet(f"{root}/{INSIDE}/nodes"))
    write_text(spark, f"{root}/{INSIDE}/root.json", json.dumps({"about": about, "files": n, "levels": levels, "root": top}, sort_keys=True))
    return top


def _sealed(spark: SparkSession, root: str, trusted: str | None) -> dict:
    about = json.loads(read_text(spark, f"{root}/{INSIDE}/root.json"))
    if trusted is not None and about["root"] != trusted:
        raise ArtifactError(f"the manifest of {root} is not the one that is trusted")
    return about


def audit(spark: SparkSession, root: str, trusted: str | None = None) -> DataFrame:
    """name and state of every file that is not as the manifest says; no rows where all is well.

    The manifest is checked first: its leaves must make its nodes, and these its root.
    """
    about, held = _sealed(spark, root, trusted), f"{root}/{INSIDE}"
    before = spark.read.parquet(f"{held}/leaves").drop("prefix")
    made = materialize(nodes(before, about["levels"]), "merkle-nodes")
    if root_of(made) != about["root"]:
        raise ArtifactError(f"the manifest of {root} is damaged")
    after = materialize(_files(spark, root), "merkle-leaves")
    return diff(before, after, about["levels"], made)


def holds(spark: SparkSession, root: str, path: str, trusted: str | None = None) -> bool:
    """Whether one file is as the manifest says: its hash, the leaves of its bucket and the nodes beside its way to the root are read, nothing else."""
    about, held = _sealed(spark, root, trusted), f"{root}/{INSIDE}"
    one = spark.createDataFrame([(path, "listed")], "path string, status string")
    leaf = leaves(tree.hashed(spark, root, one.selectExpr("path", "0L AS size_bytes", "0L AS modified_ns", "status")), "path", "content_hash").first()["leaf"]
    levels = about["levels"]
    bucket = leaf[:levels]
    own = sorted(r["leaf"] for r in spark.read.parquet(f"{held}/leaves").where(F.col("prefix") == bucket).select("leaf").collect())
    if leaf not in own:
        return False
    beside = [bucket[:d] + x for d in range(levels) for x in "0123456789abcdef"]
    known = {r["prefix"]: r["digest"] for r in spark.read.parquet(f"{held}/nodes").where(F.col("prefix").isin(*beside)).collect()} if beside else {}
    digest = hashlib.sha256("".join(own).encode()).hexdigest()
    for d in range(levels - 1, -1, -1):
        known[bucket[: d + 1]] = digest
        digest = hashlib.sha256("".join(sorted(p + h for p, h in known.items() if len(p) == d + 1 and p[:d] == bucket[:d])).encode()).hexdigest()
    return digest == about["root"]
