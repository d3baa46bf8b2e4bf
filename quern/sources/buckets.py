"""Tables that change by the bucket: touched buckets are written anew, and one pointer commits several tables together.

A table's rows lie in buckets by a hash of one column. A change reads and rewrites the buckets that its rows fall into and no
others; their new files stand beside the old ones. What a state consists of is a list of files for each bucket of each table, written as
one small file, and the name of the current list is put in place by a rename. So a reader sees all tables before
a change or all after it, and a change that stops halfway leaves nothing but files that no list names.

The driver holds the lists (tables times buckets) and the numbers of touched buckets.

Defined cases: new rows that repeat a key leave the one with the greatest version, equal versions the greatest row; a null
key is a key; a deletion of what is not there changes nothing; a table without rows has no buckets.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import swept
from quern.sources.store import ArtifactError, _fs, exists, read_text, write_text


class Conflict(ArtifactError):
    """Somebody else has committed since this change began."""


@dataclass
class Layout:
    """How a table is kept: what identifies a row, which of two rows is newer, what deals it to buckets, how many these are."""

    key: str
    version: str
    by: str
    buckets: int = 64
    schema: dict | None = None
    files: dict[str, list[str]] = field(default_factory=dict)


class BucketStore:
    """Tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str | None:
        path = f"{self.root}/current"
        return read_text(self.spark, path).strip() if exists(self.spark, path) else None

    def state(self, name: str | None = None) -> dict[str, Layout]:
        name = name or self.current()
        return {k: Layout(**v) for k, v in json.loads(read_text(self.spark, f"{self.root}/states/{name}.json"))["tables"].items()} if name else {}

    def read(self, table: str, state: str | None = None) -> DataFrame:
        return self.rows(self.state(state)[table])

    def rows(self, layout: Layout, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(layout.schema)
        files = [f for b, own in layout.files.items() if only is None or int(b) in only for f in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2) -> int:
        """Remove files that none of the last states names; how many folders went."""
        named, state = set(), self.current()
        for _ in range(keep):
            if not state:
                break
            about = json.loads(read_text(self.spark, f"{self.root}/states/{state}.json"))
            named |= {f for t in about["tables"].values() for own in t["files"].values() for f in own}
            state = about["before"]
        gone = 0
        p, fs = _fs(self.spark, f"{self.root}/data")
        for change in fs.listStatus(p) if fs.exists(p) else []:
            for bucket in fs.listStatus(change.getPath()):
                if f"{self.root}/data/{change.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        return gone


class Change:
    """Changes of several tables that are committed together or not at all."""

    def __init__(self, store: BucketStore):
        self.store, self.before = store, store.current()
        self.tables, self.rewritten = store.state(self.before), 0

    def create(self, table: str, rows: DataFrame, key: str, version: str, by: str | None = None, buckets: int = 64) -> Change:
        if table in self.tables:
            raise ArtifactError(f"there is a table {table}")
        self.tables[table] = Layout(key, version, by or key, buckets, json.loads(rows.schema.json()))
        return self.upsert(table, rows)

    def upsert(self, table: str, rows: DataFrame) -> Change:
        """New rows, and rows that replace those of their key; where rows of a key lie in the same bucket, which ``by`` must see to."""
        t = self.tables[table]
        touched = self._touched(rows, t)
        rest = [c for c in StructType.fromJson(t.schema).names if c != t.key]
        both = self.store.rows(t, touched).unionByName(rows.select(t.key, *rest))
        newest = both.groupBy(t.key).agg(F.max(F.struct(F.col(t.version).alias("_v"), F.struct(*rest).alias("_r"))).alias("x"))
        return self._write(t, newest.select(t.key, *(F.col(f"x._r.{c}").alias(c) for c in rest)), touched)

    def delete(self, table: str, values: DataFrame) -> Change:
        """Without the rows whose ``by`` column is among ``values`` (a table with that column)."""
        t = self.tables[table]
        gone = values.select(t.by).distinct()
        touched = self._touched(gone, t)
        return self._write(t, self.store.rows(t, touched).join(gone, t.by, "left_anti"), touched)

    def append(self, table: str, rows: DataFrame) -> Change:
        """More rows beside those that are there, whatever their keys; nothing is read or written anew."""
        return self._write(self.tables[table], rows, [])

    def added(self, table: str) -> Layout:
        """What this change has appended to a table so far, as a table of its own."""
        t, old = self.tables[table], self.store.state(self.before).get(table)
        known = {f for own in old.files.values() for f in own} if old else set()
        return replace(t, files={b: new for b, own in t.files.items() if (new := [f for f in own if f not in known])})

    def touched(self, table: str, rows: DataFrame) -> DataFrame:
        """The table's rows in those buckets that ``rows`` fall into."""
        t = self.tables[table]
        return self.store.rows(t, self._touched(rows, t))

    def _touched(self, rows: DataFrame, t: Layout) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(t).alias("b")).distinct().collect()]

    @staticmethod
    def _bucket(t: Layout):
        return F.pmod(F.xxhash64(F.col(t.by)), F.lit(t.buckets)).cast("int")

    def _write(self, t: Layout, rows: DataFrame, touched: list[int]) -> Change:
        out = f"{self.store.root}/data/{uuid.uuid4().hex[:16]}"
        order = StructType.fromJson(t.schema).names
        with swept(self.store.spark):
            rows.select(*order, self._bucket(t).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(out)
        p, fs = _fs(self.store.spark, out)
        made = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(p) if s.isDirectory()}
        for b in map(str, touched):
            t.files.pop(b, None)
        for b in made:
            t.files.setdefault(b, []).append(f"{out}/bucket={b}")
        self.rewritten += len(touched)
        return self

    def commit(self) -> str:
        """Put the new state in place; whoever began before another's commit has to begin again."""
        name = uuid.uuid4().hex[:16]
        write_text(self.store.spark, f"{self.store.root}/states/{name}.json", json.dumps({"before": self.before, "tables": {k: vars(v) for k, v in self.tables.items()}}))
        if self.store.current() != self.before:
            raise Conflict("the tables have changed since")
        write_text(self.store.spark, f"{self.store.root}/current", name)
        return name


def delete_documents(store: BucketStore, documents: DataFrame, tables: tuple[str, ...] = ("live", "previous", "artifacts", "questions")) -> str:
    """Documents (doc_id) out of every table that is there, in one commit."""
    change = store.begin()
    for t in tables:
        if t in change.tables:
            change.delete(t, documents)
    return change.commit()
