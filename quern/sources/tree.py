"""Listing and hashing folders in tasks: the driver sees how many folders are left, never a file's name.

Folders are expanded level by level: each task lists its folders, files of a level are written and the next level's
folders read back. Files are hashed in blocks of 64 KiB by tasks that read less than ``BYTES`` + ``SPAN`` each: of a larger file one task reads
``SPAN`` bytes and hands the state of its SHA-256 on to the next round's task, so that rounds, not tasks, grow with the largest file.
File systems are those that Arrow opens by their URI; ``files.scan`` reads what only Spark can.

Defined cases: a file that cannot be read stays, without a hash and with the status ``unreadable``; a folder
that cannot be listed stays as such a row; an empty file has the hash of no bytes; a link is what it points to, a link to nothing
is not listed; an empty folder gives no rows. Where Python's own OpenSSL shows no states, one task reads the whole of a file.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from functools import cache, reduce
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids
from quern.operators import ordered
from quern.session import materialize, ship
from quern.sources.files import describe

BLOCK = 64 << 10
#: Folders that a task lists, on average; bytes and files that begin in a task that hashes; bytes of one file that a task reads.
FOLDERS, BYTES, FILES, SPAN = 64, 256 << 20, 2000, 512 << 20
_ENTRY = "path string, folder boolean, size_bytes long, modified_ns long, status string"


def _opened(root: str, inside: str) -> tuple:
    """The file system of a folder's URI and the path there of what lies inside; names need no quoting."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    return files, f"{base}/{inside}" if inside else base


def opened_by_arrow(spark: SparkSession, root: str) -> str | None:
    """The URI of a folder where it really lies, also behind a mount table, if Arrow opens that file system."""
    from pyarrow import fs

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        real = path.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(path).toString()
        real = quote(re.sub("^file:/+", "file:///", real), safe="/:@").rstrip("/")
        files, inside = fs.FileSystem.from_uri(real)
        return real if files.get_file_info(inside).type != fs.FileType.NotFound else None
    except (Py4JJavaError, OSError, ValueError, NotImplementedError):
        return None


@cache
def _sha():
    """SHA-256 of the OpenSSL that Python itself is linked with, whose state is plain memory of 112 bytes; None where it is not or gives other hashes."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for f, kinds in ((lib.SHA256_Init, [ctypes.c_char_p]), (lib.SHA256_Update, [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]), (lib.SHA256_Final, [ctypes.c_char_p, ctypes.c_char_p])):
            f.argtypes = kinds
        tried = _go_on(lib, _go_on(lib, None, [b"a" * 100])[0], [b"b" * 30, b"c"])[1]
    except (ImportError, AttributeError, OSError):
        return None
    return lib if tried == hashlib.sha256(b"a" * 100 + b"b" * 30 + b"c").hexdigest() else None


def _go_on(lib, state: bytes | None, blocks) -> tuple[bytes, str]:
    """The state after more blocks, and the hash if these were the last."""
    held, out = ctypes.create_string_buffer(state or bytes(112), 112), ctypes.create_string_buffer(32)
    if state is None:
        lib.SHA256_Init(held)
    for block in blocks:
        lib.SHA256_Update(held, block, len(block))
    state = held.raw
    lib.SHA256_Final(out, held)
    return state, out.raw.hex()


def _blocks(f, most: int | None = None) -> Iterator[bytes]:
    while block := f.read(BLOCK if most is None else min(BLOCK, most)):
        yield block
        most = None if most is None else most - len(block)


def digest(root: str, inside: str) -> str | None:
    """SHA-256 of a file in blocks; None where it cannot be read."""
    try:
        files, path = _opened(root, inside)
        h = hashlib.sha256()
        with files.open_input_file(path) as f:
            for block in _blocks(f):
                h.update(block)
        return h.hexdigest()
    except OSError:
        return None


def digest_span(root: str, inside: str, state: bytes | None, start: int, span: int) -> tuple[str | None, bytes | None]:
    """The hash of a file that ends within ``span`` bytes from ``start``, or the state for what is left; neither where it cannot be read."""
    try:
        files, path = _opened(root, inside)
        with files.open_input_file(path) as f:
            size = f.size()
            f.seek(min(start, size))
            state, made = _go_on(_sha(), state, _blocks(f, span))
        return (None, state) if start + span < size else (made, None)
    except OSError:
        return None, None


def _list(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for inside in batch.column(0).to_pylist():
            files, path = _opened(root, inside)
            rows: list[tuple] = []
            try:
                for x in files.get_file_info(fs.FileSelector(path)):
                    folder = x.type == fs.FileType.Directory
                    known = folder or x.type == fs.FileType.File
                    rows.append((f"{inside}/{x.base_name}".lstrip("/"), folder, None if folder or not known else x.size, x.mtime_ns if known else None, "listed" if known else "unreadable"))
            except OSError:
                rows.append((inside, False, None, None, "unreadable"))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["path", "folder", "size_bytes", "modified_ns", "status"])


def _hash(batches: Iterator[pa.RecordBatch], root: str, start: int, span: int) -> Iterator[pa.RecordBatch]:
    """Hashes of files, or states of those that go on beyond ``start`` + ``span``."""
    for batch in batches:
        made = []
        for path, status, state in zip(*(batch.column(c).to_pylist() for c in ("path", "status", "state")), strict=True):
            made.append((None, None) if status != "listed" else digest_span(root, path, state, start, span) if _sha() else (digest(root, path), None))
        kept = [batch.column(c) for c in batch.schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=[*batch.schema.names[:-1], "content_hash", "state"])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """path (within it), size_bytes, modified_ns and status of every file below a folder (a URI), one job for each level."""
    ship(spark)
    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        n = level.count()
        if not n:
            break
        entries = materialize(level.repartition(max(1, -(-n // FOLDERS))).mapInArrow(lambda b: _list(b, root), _ENTRY), "tree-level")
        found.append(entries.where("NOT folder").drop("folder"))
        level = entries.where("folder").select("path")
    return reduce(DataFrame.unionByName, found)


def hashed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """Listed files with the hashes of their contents, written once."""
    ship(spark)
    bytes_, files, span = BYTES, FILES, SPAN  # once, also for the tasks
    weigh = F.least(F.coalesce("size_bytes", F.lit(0)), F.lit(span)) + F.lit(-(-bytes_ // files))
    # Files stand one after the other: those that begin in the same `bytes_` are a task's, and no two of them go on beyond `span`.
    laid = ordered.sums(listed.withColumns({"all": F.lit(0), "weight": weigh}), "all", ["path"], {"upto": F.col("weight"), "longs": (F.coalesce("size_bytes", F.lit(0)) > span).cast("long")})
    whole, longs = laid.agg(F.max("upto"), F.max("longs")).first()
    first = laid.withColumns({"task": F.floor((F.col("upto") - F.col("weight")) / bytes_).cast("int"), "long": F.greatest(F.col("longs") - 1, F.lit(0)).cast("int"), "state": F.lit(None).cast("binary")})
    left, start, done = first.repartitionById((whole or 0) // bytes_ + 1, "task"), 0, []
    columns = "path string, size_bytes long, modified_ns long, status string, long int"
    while True:
        rows = left.select("path", "size_bytes", "modified_ns", "status", "long", "state")
        made = materialize(rows.mapInArrow(lambda b, start=start: _hash(b, root, start, span), f"{columns}, content_hash string, state binary"), "tree-hashes")
        done.append(made.where("state IS NULL").drop("long", "state"))
        if made.where("state IS NOT NULL").isEmpty():
            return reduce(DataFrame.unionByName, done)
        left, start = made.where("state IS NOT NULL").drop("content_hash").repartitionById(max(1, longs), "long"), start + span


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row for each file: path within the folder, size, time, hash, ids, media type, routing and status."""
    found = hashed(spark, root, files_below(spark, root))
    named = found.select(F.col("path").alias("source_path"), "size_bytes", F.timestamp_micros(F.floor(F.col("modified_ns") / 1000)).alias("source_modified_at"), "content_hash", F.when(F.col("content_hash").isNotNull(), ids.document_id(F.col("content_hash"))).alias("document_id"))
    return describe(named).withColumn("status", F.when(F.col("content_hash").isNull(), "unreadable").otherwise("collected"))
