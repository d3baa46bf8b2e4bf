"""Versioned tables: artifacts of a run, collections with pointers, exports with a manifest, snapshots and restores."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "1.0.0"


class ArtifactError(RuntimeError):
    """An artifact is missing, of another version, or of another shape."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by a rename over the old one, so that a reader sees one or the other."""
    p, fs = _fs(spark, path)
    jvm = spark._jvm
    new, _ = _fs(spark, path + ".new")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, p, over)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def save_artifact(df: DataFrame, root: str, run_id: str, stage: str, version: str = VERSION) -> str:
    """Write a stage's table for a run, and beside it its schema's version."""
    path = f"{root}/{run_id}/{stage}"
    df.write.mode("overwrite").parquet(path)
    write_text(df.sparkSession, f"{path}.json", json.dumps({"schema_version": version, "schema": json.loads(df.schema.json())}))
    return path


def load_artifact(spark: SparkSession, root: str, run_id: str, stage: str, version: str = VERSION, schema: StructType | None = None) -> DataFrame:
    """A stage's table; its version and, if given, its columns must be those that are expected."""
    path = f"{root}/{run_id}/{stage}"
    if not exists(spark, f"{path}.json"):
        raise ArtifactError(f"{stage} of run {run_id} is missing")
    about = json.loads(read_text(spark, f"{path}.json"))
    if about["schema_version"] != version:
        raise ArtifactError(f"{stage} has schema version {about['schema_version']}, not {version}")
    held = StructType.fromJson(about["schema"])
    if schema is not None and {(f.name, f.dataType) for f in schema} - {(f.name, f.dataType) for f in held}:
        raise ArtifactError(f"{stage} lacks columns")
    return spark.read.schema(held).parquet(path)


def cached(found: DataFrame, inputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of an earlier result whose inputs are the same, and the inputs that are still to do."""
    return found.join(inputs.select(*keys).distinct(), keys, "left_semi"), inputs.join(found.select(*keys).distinct(), keys, "left_anti")


def scroll(table: DataFrame, key: str, after: object = None, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """A page of a table by key; without a limit all of it, in no order."""
    out = table if where is None else table.where(where)
    if after is not None:
        out = out.where(F.col(key) > F.lit(after))
    return out if limit is None else out.orderBy(key).limit(limit)


def delete_documents(points: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is left of a collection: deletions are applied where it is read."""
    return points.join(tombstones.select(key).distinct(), key, "left_anti")


class Collections:
    """Write-once tables below ``root``; names point at one of them, and a pointer moves in one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def exists(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def names(self, folder: str = "tables") -> list[str]:
        p, fs = _fs(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def count(self, name: str) -> int:
        return self.read(name).count()

    def remove(self, name: str) -> None:
        p, fs = _fs(self.spark, self.path(name))
        fs.delete(p, True)
        p, fs = _fs(self.spark, self._mark(name))
        fs.delete(p, False)

    def point(self, alias: str, name: str, **about: object) -> None:
        """Create or move a pointer; the one before it is remembered."""
        if not self.exists(name):
            raise ArtifactError(f"there is no table {name}")
        now = self.record(alias)
        if now.get("target") != name:
            write_text(self.spark, f"{self.root}/aliases/{alias}", json.dumps({"target": name, "previous": now.get("target")} | about, sort_keys=True))

    def record(self, alias: str) -> dict:
        path = f"{self.root}/aliases/{alias}"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else {}

    def resolve(self, alias: str) -> str | None:
        return self.record(alias).get("target")

    def drop_alias(self, alias: str) -> None:
        p, fs = _fs(self.spark, f"{self.root}/aliases/{alias}")
        fs.delete(p, False)

    def snapshot(self, name: str, label: str) -> str:
        """A copy of a table that later deletions do not reach."""
        self.read(name).write.mode("errorifexists").parquet(f"{self.root}/snapshots/{label}")
        return label

    def restore(self, label: str, name: str, tombstones: DataFrame, key: str = "doc_id") -> None:
        """A snapshot as a new table, with every tombstone since replayed before anyone can read it."""
        self.write(name, delete_documents(self.spark.read.parquet(f"{self.root}/snapshots/{label}"), tombstones, key))

    def restore_raw(self, label: str, name: str) -> None:
        """A snapshot as a new table as it was; it may not go live, as its mark says, which stands before the table does."""
        if self.exists(name):
            raise ArtifactError(f"there is a table {name}")
        write_text(self.spark, self._mark(name), json.dumps({"restored_from": label}))
        self.write(name, self.spark.read.parquet(f"{self.root}/snapshots/{label}"))

    def replay(self, name: str, into: str, tombstones: DataFrame, key: str = "doc_id") -> int:
        """A restored table as a new one without what was deleted since; how many documents that were. The old one keeps its mark."""
        held = self.read(name)
        gone = held.join(tombstones.select(key).distinct(), key, "left_semi").select(key).distinct().count()
        self.write(into, delete_documents(held, tombstones, key))
        return gone

    def awaits_replay(self, name: str) -> bool:
        return exists(self.spark, self._mark(name))

    def _mark(self, name: str) -> str:
        return f"{self.root}/unreplayed/{name}.json"


def export(points: DataFrame, out: str, about: dict, extras: dict[str, str] | None = None, per_file: int = 10_000) -> DataFrame:
    """Chunks as JSON lines of bounded files, the configuration beside them, and a manifest of every file's SHA-256.

    Files are hashed where Spark reads them; only the manifest's rows are collected, to write it.
    """
    spark = points.sparkSession
    points.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(f"{out}/chunks")
    for name, text in ({"config.json": json.dumps(about, sort_keys=True)} | (extras or {})).items():
        write_text(spark, f"{out}/{name}", text)
    names = F.regexp_extract("path", r"/([^/]+(?:/part-[^/]+)?)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).where(~F.col("path").endswith("manifest.json"))
    manifest = files.select(F.when(F.col("path").contains("/chunks/"), F.concat(F.lit("chunks/"), F.substring_index("path", "/", -1))).otherwise(names).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256")).where("file not like '%_SUCCESS'")
    hashes = {r["file"]: r["sha256"] for r in manifest.collect()}
    count = points.count()
    write_text(spark, f"{out}/manifest.json", json.dumps({"schema_version": VERSION, "chunk_count": count, "file_hashes": dict(sorted(hashes.items()))}, sort_keys=True))
    return manifest


def verify_export(spark: SparkSession, out: str) -> bool:
    """Whether every file of an export is there with the content that its manifest names."""
    want = json.loads(read_text(spark, f"{out}/manifest.json"))["file_hashes"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(out).select(F.when(F.col("path").contains("/chunks/"), F.concat(F.lit("chunks/"), F.substring_index("path", "/", -1))).otherwise(F.substring_index("path", "/", -1)).alias("file"), F.sha2("content", 256).alias("h"))
    got = {r["file"]: r["h"] for r in files.collect()}
    return all(got.get(f) == h for f, h in want.items())


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_version(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode("utf-8")).hexdigest()


def load_config(text: str, environment: Iterable[tuple[str, str]] | None = None, prefix: str = "QUERN_") -> dict:
    """A JSON configuration with overrides of nested keys: PREFIX_A__B=value sets a.b; values are JSON where they can be."""
    out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError("a configuration is an object")
    for name, value in sorted(environment if environment is not None else os.environ.items()):
        if name.startswith(prefix) and len(name) > len(prefix):
            at, keys = out, name[len(prefix) :].lower().split("__")
            for k in keys[:-1]:
                at = at.setdefault(k, {})
                if not isinstance(at, dict):
                    raise ValueError(f"{name} names a part of a plain value")
            try:
                at[keys[-1]] = json.loads(value)
            except ValueError:
                at[keys[-1]] = value
    return out


def load_descriptions(rows: list[dict]) -> list[dict]:
    """Class descriptions: each class once, with a text that is not empty."""
    seen: set[str] = set()
    for r in rows:
        name, text = str(r.get("segment_class") or "").strip(), str(r.get("description") or "").strip()
        if not name or not text:
            raise ValueError("a class description needs a class and a text")
        if name in seen:
            raise ValueError(f"class {name} is described twice")
        seen.add(name)
    return [{"segment_class": str(r["segment_class"]).strip(), "description": str(r["description"]).strip()} for r in rows]
