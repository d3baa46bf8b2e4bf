"""Exact top-k inner products by norm-sorted blocks with rotated partial sums.

Vectors become integers floor(scale * x). They are dealt by ranges of their length, longest first, and
each task walks its vectors in blocks of descending length. Queries are read in blocks from written
files, never held whole. A fixed number of the longest vectors, sent to all tasks, first gives every
query a threshold: its k-th best score among them. Then, for a block, Cauchy-Schwarz drops the queries
whose length times the block's greatest length stays below their threshold; the rest get partial sums over
the leading axes of an SVD rotation, to which the product of the remaining lengths is the most that can be
added; only pairs that may still reach the threshold are scored exactly, in integers. Bounds carry a margin for rounding and
ties are never pruned, so the result is exact.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; a vector
shorter than the longest counts as filled up with zeros; equal scores go to the smaller vec_id; rows that
repeat a vec_id are candidates each, and queries each once per vec_id (the smallest vector in order); null
ids take no part; queries with fewer candidates get all; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import batch_bytes, materialize, scratch, ship

SCALE = 1024
#: The longest vectors that set first thresholds, vectors in a block, queries in a block.
HEAD, BLOCK, QUERIES = 4096, 4096, 1024
#: Bytes of vectors that a searching task reads on average.
TASK_BYTES = 64 << 20
#: Share of the squared lengths that the leading axes hold.
ENERGY = 0.8
#: Integers of up to this size are exact in float64 sums.
EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, v (array<double> of whole numbers) and norm of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), dim))
    if len(ends) and (ends == dim).all():
        return flat.reshape(-1, dim)
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _gram(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros((dim, dim))
    for b in batches:
        v = _dense(b.column(0), dim)
        total += v.T @ v
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([TaskContext.get().partitionId() % 32], pa.int32()), "gram": pa.array([total.tobytes()], pa.binary())})


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in t.column("gram"))
    return pa.table({"bucket": t.column("bucket")[:1], "gram": pa.array([total.tobytes()], pa.binary())})


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Axes of the vectors' SVD, from sums over all rows, and how many of them lead; 32 small sums reach the driver."""
    sums = rows.select("v").mapInArrow(lambda b: _gram(b, dim), "bucket int, gram binary").groupBy("bucket").applyInArrow(_add, "bucket int, gram binary").collect()
    total = sum((np.frombuffer(r["gram"]).reshape(dim, dim) for r in sums), np.zeros((dim, dim)))
    values, axes = np.linalg.eigh(total)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(axes), min(dim, int(np.searchsorted(held, ENERGY)) + 1)


def _merge(best: np.ndarray, ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what a query holds and what it gets, equal scores by id."""
    i, s = np.concatenate([ids, new_ids]), np.concatenate([best, scores])
    if len(s) > 4 * k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        i, s = i[s >= cut], s[s >= cut]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


class Block:
    """A block of queries and the best that a task has found for each."""

    def __init__(self, table: pa.Table, dim: int, axes: np.ndarray, lead: int):
        self.ids = table.column("vec_id").to_numpy()
        self.v = _dense(table.column("v").combine_chunks(), dim)
        self.norm = table.column("norm").to_numpy()
        self.least = table.column("least").to_numpy(zero_copy_only=False).astype(float) if "least" in table.column_names else np.full(len(self.ids), -np.inf)
        turned = self.v @ axes
        self.front = turned[:, :lead]
        self.rest = np.sqrt(np.maximum((turned[:, lead:] ** 2).sum(1), 0))
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, front: np.ndarray, rest: np.ndarray, k: int) -> None:
        """Score a block of vectors in descending length against these queries."""
        slack = 1e-9 * (self.norm * norm[0] if len(norm) else self.norm) + 1e-6
        live = np.flatnonzero(self.norm * norm[0] + slack >= self.least)
        if not len(live):
            return
        bound = self.front[live] @ front.T + np.outer(self.rest[live], rest)
        may = bound + slack[live, None] >= self.least[live, None]
        for j, q in enumerate(live):
            at = np.flatnonzero(may[j])
            at = at[ids[at] != self.ids[q]]
            if not len(at):
                continue
            scores = v[at] @ self.v[q]
            at, scores = at[scores >= self.least[q]], scores[scores >= self.least[q]]
            if not len(at):
                continue
            held = self.found.get(q, (np.zeros(0), np.zeros(0, dtype=np.int64)))
            best = _merge(held[0], held[1], scores, ids[at], k)
            self.found[q] = best
            if len(best[0]) == k:
                self.least[q] = max(self.least[q], best[0][-1])

    def rows(self) -> pa.RecordBatch:
        q = np.concatenate([np.full(len(i), self.ids[x]) for x, (_, i) in self.found.items()]) if self.found else np.zeros(0, dtype=np.int64)
        s = np.concatenate([s for s, _ in self.found.values()]) if self.found else np.zeros(0)
        i = np.concatenate([i for _, i in self.found.values()]) if self.found else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])


def _blocks(table: pa.Table, dim: int, axes: np.ndarray, lead: int, size: int) -> list[tuple]:
    order = np.argsort(-table.column("norm").to_numpy(), kind="stable")
    out = []
    for a in range(0, len(order), size):
        t = table.take(pa.array(order[a : a + size]))
        v = _dense(t.column("v").combine_chunks(), dim)
        turned = v @ axes
        out.append((t.column("vec_id").to_numpy(), v, t.column("norm").to_numpy(), turned[:, :lead], np.sqrt(np.maximum((turned[:, lead:] ** 2).sum(1), 0))))
    return out


def _thresholds(batches: Iterator[pa.RecordBatch], held, dim: int, axes: np.ndarray, lead: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries with the k-th best score that the longest vectors give them."""
    head = _blocks(pa.ipc.open_stream(held.value).read_all(), dim, axes, lead, BLOCK)
    for batch in batches:
        for a in range(0, batch.num_rows, QUERIES):
            part = batch[a : a + QUERIES]
            block = Block(pa.Table.from_batches([part]), dim, axes, lead)
            for b in head:
                block.take(*b, k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.least)], names=["vec_id", "v", "norm", "least"])


def _write_blocks(batches: Iterator[pa.RecordBatch], out: str, size: int) -> Iterator[pa.RecordBatch]:
    """Query blocks as Arrow files that any task can read, one row for each."""
    import uuid

    from pyarrow import fs

    for batch in batches:
        for a in range(0, batch.num_rows, size):
            name = f"{out}/{uuid.uuid4().hex}.arrow"
            files, path = fs.FileSystem.from_uri(name)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            part = batch[a : a + size]
            with files.open_output_stream(path) as f, pa.ipc.new_stream(f, part.schema) as w:
                w.write_batch(part)
            yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([part.num_rows], pa.int64())})


def _search(batches: Iterator[pa.RecordBatch], names: str, dim: int, axes: np.ndarray, lead: int, k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Hold sixteen blocks of vectors at a time and run every query block past them."""
    from pyarrow import fs

    def past(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _blocks(pa.Table.from_batches(held), dim, axes, lead, size)
        files, path = fs.FileSystem.from_uri(names)
        with files.open_input_stream(path) as f:
            listing = io.TextIOWrapper(f, "utf-8").read().split()
        for name in listing:
            files, path = fs.FileSystem.from_uri(name)
            with files.open_input_stream(path) as f, pa.ipc.open_stream(f) as r:
                block = Block(r.read_all(), dim, axes, lead)
            for b in vectors:
                block.take(*b, k)
            yield block.rows()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 16 * size:
            yield from past(held)
            held, n = [], 0
    if n:
        yield from past(held)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors other than its own id.

    ``is_query`` marks the rows that ask, by ``vec_id``. What a task holds is bounded by blocks of
    vectors and of queries; tasks read all query blocks in turn.
    """
    spark = vectors.sparkSession
    ship(spark)
    batch_bytes(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    rows = materialize(integers(vectors, id_col, vec_col, scale), "topk-vectors")
    most = rows.agg(F.max(F.size("v")), F.max("norm")).first()
    if most[0] is None:
        return spark.createDataFrame([], schema)
    dim = max(1, most[0])
    if most[1] ** 2 >= EXACT:
        raise ValueError("these integers' products may pass 2**53; use a smaller scale")
    axes, lead = rotation(rows, dim)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.v", "x.norm")

    def listed(table: DataFrame, name: str) -> str:
        """Write query blocks; a small text file of their names goes beside them."""
        from pyarrow import fs

        out = scratch(spark, name)
        made = materialize(table.mapInArrow(lambda b: _write_blocks(b, out, QUERIES), "file string, n long"), f"{name}-names")
        made.select("file").coalesce(1).write.text(f"{out}-list")
        files, path = fs.FileSystem.from_uri(f"{out}-list")
        return next((f"{out}-list/{x.base_name}" for x in files.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")), "")

    top = rows.orderBy(F.desc("norm"), "vec_id").limit(head).select("vec_id", "v", "norm").toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, top.schema) as w:
        w.write_table(top)
    longest = spark.sparkContext.broadcast(sink.getvalue())
    known = queries.mapInArrow(lambda b: _thresholds(b, longest, dim, axes, lead, k), "vec_id long, v array<double>, norm double, least double")
    names = listed(known, "topk-queries")
    if not names:
        return spark.createDataFrame([], schema)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * dim * 8 // TASK_BYTES))
    dealt = rows.repartitionByRange(tasks, F.desc("norm"), "vec_id").select("vec_id", "v", "norm")
    found = dealt.mapInArrow(lambda b: _search(b, names, dim, axes, lead, k, BLOCK), "query_id long, vec_id long, score long")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
