"""Length-delimited binary records of token ids, with a separate offset index.

A data file is a run of frames: length (8 bytes, little-endian), masked CRC-32C of those bytes,
payload, masked CRC-32C of the payload. A payload is a 16-byte head (doc_id, number of ids, bytes
per id, flags) and the ids, padded to a multiple of four bytes. The index beside it holds offset,
payload length, number of ids and doc_id of every frame, so that a reader can fetch any frame by
itself and take frames in shuffled order.

``write`` sorts by doc_id across files: file k holds smaller ids than file k+1. Each task writes
files of its own name and reports them; only what Spark accepts from a task enters the manifest,
so retried and speculative tasks leave no double records.

Defined cases: a null text is an empty text; rows with a null doc_id come first; rows that repeat a
doc_id stay separate records in order of a hash of their text, then of the text, and very many of them
are dealt to several files; a very long text is one record; an empty table gives no files and no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import encoder, public_path
from quern.session import batch_bytes, materialize, scratch, ship, tidy

MASK_DELTA = 0xA282EAD8
POLY = 0x82F63B78
BLOCK = 64
HEAD = struct.Struct("<qIHH")
FRAME = struct.Struct("<QI")
INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u4"), ("doc_id", "<i8"), ("null_id", "<u4"), ("spare", "<u4")])
NULL_ID = 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32C over 32-bit words by two look-ups each, and the same for BLOCK zero words at once."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1)
    by = [t]
    for _ in range(3):
        by.append((by[-1] >> 8) ^ t[by[-1] & 255])
    v = np.arange(1 << 16, dtype=np.uint32)
    low, high = by[3][v & 255] ^ by[2][v >> 8], by[1][v & 255] ^ by[0][v >> 8]
    far = []
    for c in (v.copy(), v << 16):
        for _ in range(BLOCK):
            c = low[c & 0xFFFF] ^ high[c >> 16]
        far.append(c)
    return low, high, far[0], far[1]


_LOW, _HIGH, _FAR_LOW, _FAR_HIGH = _tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of byte strings whose lengths are multiples of four, all at once.

    Zeros before a message leave a CRC that starts at 0 unchanged, so messages are padded in front to
    whole blocks, blocks are run side by side, and a message's blocks are then chained. Starting at
    all ones is the same as inverting the first word.
    """
    n = len(parts)
    words = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    blocks = -(-words // BLOCK)
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * BLOCK if n else 0, dtype=np.uint32)
    for i, p in enumerate(parts):
        if p:
            a = int(ends[i]) * BLOCK - int(words[i])
            flat[a : a + int(words[i])] = np.frombuffer(p, "<u4")
            flat[a] ^= np.uint32(0xFFFFFFFF)
    grid = flat.reshape(-1, BLOCK)
    c = np.zeros(len(grid), dtype=np.uint32)
    for k in range(BLOCK):
        c = c ^ grid[:, k]
        c = _LOW[c & 0xFFFF] ^ _HIGH[c >> 16]
    out = np.zeros(n, dtype=np.uint32)
    order = np.argsort(-blocks, kind="stable")
    first, held = ends - blocks, int((blocks > 0).sum())
    for j in range(int(blocks.max()) if n else 0):
        while held and blocks[order[held - 1]] <= j:
            held -= 1
        own = order[:held]
        prev = out[own]
        out[own] = _FAR_LOW[prev & 0xFFFF] ^ _FAR_HIGH[prev >> 16] ^ c[first[own] + j]
    out[blocks == 0] = np.uint32(0xFFFFFFFF)
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)).astype(np.uint32)


def frames(payloads: list[bytes]) -> bytes:
    """Payloads (multiples of four bytes) as frames, one after another."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)), masked(crc32c(payloads))
    return b"".join(x for n, h, p, b in zip(lengths, heads, payloads, bodies, strict=True) for x in (n, struct.pack("<I", h), p, struct.pack("<I", b)))


def payload(doc_id: int | None, packed: bytes, width: int) -> bytes:
    n = len(packed) // width
    return HEAD.pack(doc_id or 0, n, width, NULL_ID if doc_id is None else 0) + packed + b"\0" * (-len(packed) % 4)


def parse(data: bytes, index: np.ndarray, base: int = 0) -> list[tuple[int | None, np.ndarray]]:
    """Check and read the frames that ``index`` names in ``data``, which starts at file offset ``base``."""
    bodies, lengths, sums = [], [], []
    for r in index:
        at, n = int(r["offset"]) - base, int(r["length"])
        lengths.append(data[at : at + 8])
        bodies.append(data[at + 12 : at + 12 + n])
        sums.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]))
    want = np.array(sums, dtype=np.uint32).reshape(-1, 2)
    if (masked(crc32c(lengths)) != want[:, 0]).any() or (masked(crc32c(bodies)) != want[:, 1]).any():
        raise ValueError("a record's checksum does not hold")
    out = []
    for b in bodies:
        doc_id, n, width, flags = HEAD.unpack_from(b)
        out.append((None if flags & NULL_ID else doc_id, np.frombuffer(b, f"<u{width}", n, HEAD.size)))
    return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@tidy
def _write_part(batches: Iterator[pa.RecordBatch], out: str, held, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, enc = TaskContext.get().partitionId(), encoder(held.value)
    width = np.dtype(enc.dtype).itemsize
    name, sink, where, at, ids = f"{out}/part-{part:06d}-{uuid.uuid4().hex[:8]}", None, [], 0, 0
    for batch in batches:
        every, flat_ids, bounds = batch.column(0).to_pylist(), *enc.encode_column(batch.column(1), end_id)
        for a in range(0, len(every), 2048):
            keys, b = every[a : a + 2048], min(a + 2048, len(every))
            if sink is None:
                files, path = _open(name)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(path + ".rec")
            ready = [payload(k, flat_ids[x:y].tobytes(), width) for k, x, y in zip(keys, bounds[a:b].tolist(), bounds[a + 1 : b + 1].tolist(), strict=True)]
            rows = np.zeros(b - a, INDEX)
            rows["length"] = [len(p) for p in ready]
            rows["offset"] = at + np.concatenate([[0], np.cumsum(rows["length"][:-1].astype(np.int64) + 16)])
            rows["n_ids"] = [HEAD.unpack_from(p)[1] for p in ready]
            rows["doc_id"], rows["null_id"] = [k or 0 for k in keys], [k is None for k in keys]
            data = frames(ready)
            sink.write(data)
            at, ids = at + len(data), ids + int(rows["n_ids"].sum())
            where.append(rows)
    if sink is not None:
        sink.close()
        rows = np.concatenate(where)
        with files.open_output_stream(path + ".idx") as f:
            f.write(rows.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [name + ".rec"], "index": [name + ".idx"], "n_records": [len(rows)], "n_ids": [ids], "n_bytes": [at]})


def write(df: DataFrame, out: str, blob: bytes, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Encode ``df`` and write data and index files below ``out``; returns the manifest, already written.

    Manifest: part (order of the files), data, index, n_records, n_ids, n_bytes. The sampling that sets
    the ranges reads the table a second time; the texts move once.
    """
    spark = df.sparkSession
    ship(spark)
    batch_bytes(spark)
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    held = spark.sparkContext.broadcast(blob)
    schema = "part int, data string, index string, n_records long, n_ids long, n_bytes long"

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    turn = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(tasks, *turn).sortWithinPartitions(*turn, "text")
    return materialize(ordered.mapInArrow(lambda batches: _write_part(batches, out, held, end_id), schema), "records-manifest")


def _ids(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))


def _sums(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())


def read(spark: SparkSession, manifest: DataFrame, span: int = 16 << 20) -> DataFrame:
    """Every record of the manifest's files: part, doc_id, start (ids before it in all files), n_tokens, ids (array).

    One row per file comes to the driver, which names the files and sums what precedes each.
    """
    return _scan(spark, manifest, span, "part int, doc_id long, start long, n_tokens long, ids array<int>", _ids, "ids")


def digests(spark: SparkSession, manifest: DataFrame, span: int = 16 << 20) -> DataFrame:
    """As ``read``, with ids_crc32 (of the ids as unsigned 32-bit little-endian) for the ids."""
    return _scan(spark, manifest, span, "part int, doc_id long, start long, n_tokens long, ids_crc32 long", _sums, "ids_crc32")


@tidy
def _read_parts(batches: Iterator[pa.RecordBatch], plan, span: int, made, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in batch.column(0).to_pylist():
            part, data, index, start = plan.value[i]
            files, path = _open(data)
            with files.open_input_stream(_open(index)[1]) as f:
                rows = np.frombuffer(f.read(), INDEX)
            with files.open_input_file(path) as f:
                for a, b in _spans(rows, span):
                    base = int(rows[a]["offset"])
                    got = parse(f.read_at(int(rows[b - 1]["offset"]) + int(rows[b - 1]["length"]) + 16 - base, base), rows[a:b], base)
                    sizes = np.array([len(x) for _, x in got], dtype=np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(got), pa.int32()), "doc_id": pa.array([k for k, _ in got], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes), column: made([x for _, x in got])})
                    start += int(sizes.sum())


def _scan(spark: SparkSession, manifest: DataFrame, span: int, schema: str, made, column: str) -> DataFrame:
    ship(spark)
    files = sorted(manifest.select("part", "data", "index", "n_ids").collect())
    if not files:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([f["n_ids"] for f in files])]).tolist()
    plan = spark.sparkContext.broadcast([(f["part"], f["data"], f["index"], before[i]) for i, f in enumerate(files)])
    return spark.range(0, len(files), 1, len(files)).mapInArrow(lambda batches: _read_parts(batches, plan, span, made, column), schema)


def _spans(rows: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    a = 0
    ends = rows["offset"].astype(np.int64) + rows["length"] + 16
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, int(rows[a]["offset"]) + span, "right")))
        b = min(b, a + 4096)
        yield a, b
        a = b


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_path("byte_bpe_50k.json"), "rb") as f:
        blob = f.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write(docs, scratch(spark, "records"), blob)
    return digests(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "part")
