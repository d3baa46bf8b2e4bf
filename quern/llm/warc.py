"""WARC archives with an index first: write records, index every one, read selected ones by byte ranges.

``write`` puts one record per page into WARC/1.1 files, each record a gzip member of its own, and returns
their index: file, offset, length, URL, payload digest and record type. Of pages with equal payloads of at least ``least`` bytes the one
with the largest page_id holds the payload; the others are revisit records, which name it. ``read``
takes any rows of an index, sorts them by file and offset, joins ranges that lie close together into one
read, and parses the records: a response's payload is hashed again and must match its header.

Tasks write files of their own name, and only what Spark accepts from a task enters the index, so
retried tasks leave no double records.

Defined cases: null html is an empty payload; rows that repeat the page_id of their group's holder are
responses too; a page with a null page_id is a response unless another page of its group has an id; a
null url is written as an empty target; a very long payload is one record, held whole while it is written
or read; an empty table gives no files and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import batch_bytes, materialize, scratch, ship, tidy

LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
ROLL = 256 << 20
SPAN, GAP = 8 << 20, 64 << 10
#: Payload groups (about 100 bytes each) up to which they are broadcast, and archive bytes that a reading task gets.
BROADCAST_GROUPS, READ_EACH = 500_000, 32 << 20


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, serial: str) -> bytes:
    """One record; ``refers_to`` makes it a revisit, which keeps only the payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, body = ("response", http + payload) if refers_to is None else ("revisit", http)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, serial)}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; a payload that does not match its digest is an error."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(head["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if lines[0] != "WARC/1.1" or head["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a record of {head.get('WARC-Target-URI')} is damaged")
    number = lambda k: int(head[k]) if head.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if head["WARC-Type"] == "response" else None}


@tidy
def _write(batches: Iterator[pa.RecordBatch], out: str, roll: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    part, token, k, sink, at, rows = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0, None, 0, []
    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if sink is None:
                name = f"{out}/part-{part:06d}-{k:04d}-{token}.warc.gz"
                files, path = fs.FileSystem.from_uri(name)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(path, compression=None)
            payload, url = (html or "").encode("utf-8"), url or ""
            data = gzip.compress(record(page_id, url, payload, digest, refers_to, f"{part}:{k}:{at}:{page_id}"), 4, mtime=0)
            sink.write(data)
            rows.append((name, at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit", refers_to, len(payload)))
            at += len(data)
            if at >= roll:
                sink.close()
                sink, at, k = None, 0, k + 1
        yield _batch(rows, INDEX)
        rows = []
    if sink is not None:
        sink.close()


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def write(pages: DataFrame, out: str, least: int = LEAST_REVISIT, roll: int = ROLL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages below ``out``; returns the index, already written.

    Only ids and digests are grouped. The payload groups of more than one page are counted and, up to
    ``BROADCAST_GROUPS``, broadcast, so the pages themselves do not move; beyond, they meet by digest, a
    join that Spark splits where one payload is very common.
    """
    spark = pages.sparkSession
    ship(spark)
    batch_bytes(spark)
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null").select("digest", "holder")
    groups = materialize(groups, "warc-groups")
    joined = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "digest", "left")
    refers = F.when(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    ready = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialize(ready.mapInArrow(lambda batches: _write(batches, out, roll), INDEX), "warc-index")


def spans(rows: list[tuple[str, int, int]], span: int, gap: int) -> Iterator[tuple[int, int]]:
    """Index ranges of rows, sorted by file and offset, that one read covers."""
    a = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[a][0] or rows[i][1] - (rows[i - 1][1] + rows[i - 1][2]) > gap or rows[i][1] + rows[i][2] - rows[a][1] > span:
            yield a, i
            a = i


@tidy
def _read(batches: Iterator[pa.RecordBatch], span: int, gap: int, schema: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [x.split()[0] for x in schema.split(", ")]
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        held = None
        for a, b in spans(rows, span, gap):
            if held != rows[a][0]:
                held = rows[a][0]
                files, path = fs.FileSystem.from_uri(held)
                source = files.open_input_file(path)
            base = rows[a][1]
            data = source.read_at(rows[b - 1][1] + rows[b - 1][2] - base, base)
            found = [parse(gzip.decompress(data[at - base : at - base + n])) for _, at, n in rows[a:b]]
            yield _batch([tuple(x[k] for k in names) for x in found], schema)


def read(index: DataFrame, payloads: bool = True, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """The records that ``index`` names, with their payloads (null for revisits) if wanted.

    Rows are dealt by ranges of file and offset, so a task reads neighbouring records in order; the number
    of tasks follows the bytes of the records, not those of the index.
    """
    spark = index.sparkSession
    ship(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    wanted = index.select("file", "offset", "length")
    held = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // READ_EACH))
    dealt = wanted.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(lambda batches: _read(batches, span, gap, schema), schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write(pages, scratch(spark, "warc"))
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, sha1(html) AS payload_digest, octet_length(encode(html))::BIGINT AS payload_bytes FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN payload_bytes < {LEAST_REVISIT} OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {LEAST_REVISIT} OR page_id = holder THEN NULL ELSE holder END AS refers_to
FROM m
"""
