"""Connectors as a Spark data source: pages of a source's listing, permissions before bytes, a cursor that a stream keeps.

A connector lists documents page by page, tells who may read one, and fetches its bytes. The data source ``connector``
turns any of them into a table and a stream. A page is one task: it asks for its documents' permissions, stops where
they are unknown and nobody has acknowledged that, and only then fetches. What passes the driver is one cursor for
each page, never a document. The stream's offset is the cursor from which the source goes on; Spark keeps it in
the query's checkpoint, so a run that was killed reads the batch it was in once more and loses nothing.

Options: ``connector`` (module:Class, whose objects take the other options), ``acknowledged`` (true where missing
permissions are known of), ``cursor`` (where a batch read begins). A stream's batch goes as far as the feed does.

Defined cases: a page without documents gives no rows; a folder or a deletion is a row without content; a document whose
bytes cannot be fetched is a row with status ``unreadable``; a feed without a page is empty.
"""

from __future__ import annotations

import abc
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.session import ship
from quern.sources.files import PermissionGap

SCHEMA = "item_id string, version long, kind string, deleted boolean, content binary, status string, permission_fidelity string, permission_principals array<string>, cursor string"


@dataclass
class Page:
    """Documents (dicts with item_id, version, kind, deleted), the next page's cursor, and on the last page the one to go on from later."""

    documents: list[dict]
    next_cursor: str | None = None
    incremental_cursor: str | None = None


@dataclass
class Permissions:
    """Who may read a document, and how much the source knows of it."""

    fidelity: str
    principals: list[str] = field(default_factory=list)


class Connector(abc.ABC):
    """What a source has to offer. How documents are collected is not its business: ``collected`` alone does that."""

    @abc.abstractmethod
    def list_documents(self, cursor: str | None) -> Page | None:
        """One page; None begins. Without a page at a cursor (yet), None."""

    @abc.abstractmethod
    def fetch_permissions(self, document: dict) -> Permissions: ...

    @abc.abstractmethod
    def fetch_document(self, document: dict) -> bytes: ...


class RecordedFeed(Connector):
    """A feed kept as files: ``<cursor>.json`` below ``root`` holds a page, ``start.json`` the first one.

    Documents carry their permissions and their text. Any file system that Arrow can open will do.
    """

    def __init__(self, root: str, **_: str):
        self.root = root.rstrip("/")

    def list_documents(self, cursor: str | None) -> Page | None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(f"{self.root}/{cursor or 'start'}.json")
        try:
            with files.open_input_stream(path) as f:
                return Page(**json.loads(f.read()))
        except FileNotFoundError:
            return None

    def fetch_permissions(self, document: dict) -> Permissions:
        return Permissions(document.get("fidelity") or "unavailable", document.get("principals") or [])

    def fetch_document(self, document: dict) -> bytes:
        if document.get("text") is None:
            raise FileNotFoundError(document["item_id"])
        return document["text"].encode()


def collected(connector: Connector, page: Page, cursor: str | None, acknowledged: bool) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one page. All permissions of the page are known before any byte is fetched."""
    told = [connector.fetch_permissions(d) for d in page.documents]
    if not acknowledged and (n := sum(p.fidelity == "unavailable" for p in told)):
        raise PermissionGap(f"{n} documents of page {cursor or 'start'} have no permissions")
    for d, p in zip(page.documents, told, strict=True):
        content, status, gone = None, "listed", bool(d.get("deleted"))
        if d.get("kind") != "folder" and not gone:
            try:
                content, status = connector.fetch_document(d), "collected"
            except OSError:
                status = "unreadable"
        yield d["item_id"], d.get("version"), d.get("kind") or "file", gone, content, status, p.fidelity, p.principals, cursor or "start"


class Walk(InputPartition):
    """A task's page."""

    def __init__(self, cursor: str | None):
        super().__init__(cursor)
        self.cursor = cursor


class _Pages:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        module, _, name = self.options["connector"].partition(":")
        self.connector: Connector = getattr(importlib.import_module(module), name)(**{k: v for k, v in self.options.items() if k not in ("connector", "acknowledged", "cursor")})
        self.acknowledged = self.options.get("acknowledged", "false").lower() == "true"

    def cursors(self, start: str | None, end: str | None = None) -> tuple[list[str | None], str | None]:
        """Cursors of the pages from ``start`` to before ``end`` (or as far as there are any), and the one to go on from."""
        out: list[str | None] = []
        while end is None or start != end:
            page = self.connector.list_documents(start)
            if page is None:
                break
            out.append(start)
            after = page.next_cursor or page.incremental_cursor
            if after is None or after == start:
                raise ValueError(f"page {start or 'start'} names no cursor to go on from")
            start = after
        return out, start

    def read(self, partition: Walk) -> Iterator[tuple]:
        if not isinstance(partition, Walk):  # what Spark hands over where there is no page
            return
        page = self.connector.list_documents(partition.cursor)
        yield from collected(self.connector, page, partition.cursor, self.acknowledged)


class BatchReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Walk]:
        return [Walk(c) for c in self.cursors(self.options.get("cursor"))[0]]


class StreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.at: str | None = None

    def initialOffset(self) -> dict:
        return {"cursor": None}

    def latestOffset(self) -> dict:
        """As far as the feed goes: a query that goes on from a checkpoint has not said yet where it stands."""
        _, self.at = self.cursors(self.at)
        return {"cursor": self.at}

    def partitions(self, start: dict, end: dict) -> list[Walk]:
        if start["cursor"] == end["cursor"]:
            return []
        return [Walk(c) for c in self.cursors(start["cursor"], end["cursor"])[0]]

    def commit(self, end: dict) -> None:
        pass


class ConnectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "connector"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ConnectorSource)


def read(spark: SparkSession, connector: type[Connector], acknowledged: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("connector").options(connector=f"{connector.__module__}:{connector.__qualname__}", acknowledged=str(acknowledged), **options).load()


def read_stream(spark: SparkSession, connector: type[Connector], acknowledged: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("connector").options(connector=f"{connector.__module__}:{connector.__qualname__}", acknowledged=str(acknowledged), **options).load()


def record(documents: DataFrame, root: str, page_size: int, first: str = "start", then: str | None = None) -> int:
    """Keep documents (item_id, version, kind, deleted, fidelity, principals, text) as a feed of pages by version; the number of pages.

    A page is a range of versions and is written by one task. ``then`` names the cursor after the last page.
    """
    from pyspark.sql import functions as F

    lowest, highest = documents.agg(F.min("version"), F.max("version")).first()
    if lowest is None:
        return 0
    pages = (highest - lowest) // page_size + 1
    then = then or f"after-{highest}"

    def write(key, table):
        import pyarrow as pa
        from pyarrow import fs

        n = key[0].as_py()
        name = lambda i: first if i == 0 else f"{first}-{i}"
        rows = sorted((r for r in table.drop_columns("page").to_pylist() if r["item_id"] is not None), key=lambda r: r["version"])
        body = {"documents": rows, "next_cursor": name(n + 1) if n + 1 < pages else None, "incremental_cursor": None if n + 1 < pages else then}
        files, path = fs.FileSystem.from_uri(f"{root}/{name(n)}.json")
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path) as f:
            f.write(json.dumps(body).encode())
        return pa.table({"page": pa.array([n], pa.int64())})

    ship(documents.sparkSession)
    paged = documents.withColumn("page", F.floor((F.col("version") - lowest) / page_size))
    every = documents.sparkSession.range(pages).withColumnRenamed("id", "page")  # a range of versions may be empty
    return every.join(paged, "page", "left").groupBy("page").applyInArrow(write, "page long").count()
