"""Lexical retrieval packing: documents that share rare terms fill a training window together.

Terms are token ids. Their document frequencies, the number of documents and the mean length are counted
over the whole table. Rows are dealt to shards by content, wherever they lie in the table: first by the
cell that their weighted terms, projected to ``DIMS`` numbers, are nearest to (cells are fitted on about
``sample`` rows and stand in the order of a tree of halves, like beside like), then by their rarest term
that another row has too. Shards hold ``shard_tokens`` ids each, in expectation; a cell, a term or a text
that very many rows share is spread over as many shards as it fills. A shard holds a BM25 inverted index of its rows, with
the whole table's statistics. A seed, the longest document left, asks the index with its terms; unused
neighbours follow in score order until the window is full. The piece that does not fit goes on as the
seed of the next window, so every window but a shard's last is exactly full, and each id lies in exactly
one piece. The last one is cut into powers of two, down to ``least``, and a rest.

**A seed asks its own shard only**, so its neighbours are the best of about ``SHARD_TOKENS`` ids around it, not of
the table: of the table's ten best rows by BM25 they hold all with one shard, 0.63 with 4 shards and 0.26
with 22 (README), and the share falls on as the table grows.

Defined cases: a null text is an empty text (its only id is the end id); a null doc_id is kept as it
is; repeated rows are packed once each; a very long text fills window after window and makes its shard
longer by itself; equal scores go to the smaller row number of the shard, where rows stand by doc_id,
nulls first, then by ids; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import encoder, forget, joined, packed_column, public_path
from quern.session import batch_bytes, materialize, ship, tidy

WINDOW = 4096
#: Ids that a shard holds in expectation; the number of shards grows with the table.
SHARD_TOKENS = 3_000_000
#: Rows on which the cells are fitted, numbers of a projected row, halvings to a cell.
SAMPLE, DIMS, DEPTH = 20_000, 48, 8
#: Bins by which rows are dealt, at most, and sub-bins of one cell.
MOST_BINS, SUB_BINS = 1 << 20, 1024
#: The usual BM25 constants, and the least length to which a shard's last sequence is cut.
K1, B = 1.2, 0.75
LEAST = 256
#: A term that more than one in so many rows of a shard have is held for all its rows.
DENSE = 16
#: Count vectors that one task adds up.
FAN_IN = 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, seed boolean"


def _flat(col: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as flat ids and where each value's begin and end."""
    col = pa.concat_arrays([col.cast(pa.large_binary())])
    width = np.dtype(dtype).itemsize
    off = np.frombuffer(col.buffers()[1], "<i8")[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return np.frombuffer(data.tobytes() if data.ctypes.data % width else data, dtype), (off - off[0]) // width


def distinct_terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each term of each row, by row and term."""
    key = ids.astype(np.int64) | (np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds)) << 32)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


@tidy
def _encode(batches: Iterator[pa.RecordBatch], held, end_id: int, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Rows of ids, and at the end of a task one row that holds its counts: by term, rows; then rows and ids in all."""
    enc = encoder(held.value, most)
    counts = np.zeros(max(enc.vocab, end_id + 1) + 2, np.int64)
    for batch in batches:
        ids, bounds = enc.encode_column(batch.column(1), end_id)
        seen = np.zeros(len(counts) - 2, np.int64)
        for a in range(0, len(bounds) - 1, 1024):
            b = min(a + 1024, len(bounds) - 1)
            _, term, _ = distinct_terms(ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            seen += np.bincount(term, minlength=len(seen))
        counts[:-2] += seen
        counts[-2:] += len(bounds) - 1, len(ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), packed_column(ids, bounds), pa.nulls(len(bounds) - 1, pa.binary())], names=["doc_id", "ids", "counts"])
    if counts[-2]:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})


def _totals(ids: DataFrame) -> np.ndarray | None:
    """The counts of all tasks, added up in rounds of ``FAN_IN``; one vector comes to the driver."""
    rows = ids.where("counts is not null").select("counts")
    n = rows.count()
    while n > FAN_IN:
        groups = -(-n // FAN_IN)
        rows = materialize(rows.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(groups))).groupBy("g").applyInArrow(_add, "counts binary"), "packing-counts")
        n = rows.count()
    found = [np.frombuffer(r["counts"], np.int64) for r in rows.collect()]
    return sum(found) if found else None


class Cells:
    """Where a row's content lies: signed sums of its terms' weights, and the centre that is nearest to them."""

    def __init__(self, df: np.ndarray, n: int, seed: int = 3):
        r = np.random.default_rng(seed)
        self.coord = r.integers(0, DIMS, len(df))
        idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0)
        self.weight = np.where(r.random(len(df)) < 0.5, -idf, idf)
        self.centres = np.zeros((1, DIMS), np.float32)

    def project(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, DIMS), np.float32)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 20), "right")) - 1)
            own = ids[bounds[a] : bounds[b]]
            key = np.repeat(np.arange(b - a) * DIMS, np.diff(bounds[a : b + 1])) + self.coord[own]
            out[a:b] = np.bincount(key, weights=self.weight[own], minlength=(b - a) * DIMS).reshape(-1, DIMS)
            a = b
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

    def fit(self, rows: np.ndarray, depth: int = DEPTH, seed: int = 4) -> Cells:
        """Centres in the order of a tree: a set of rows is halved by two means until it is small or deep enough."""
        r, out = np.random.default_rng(seed), []

        def halve(x: np.ndarray, left: int) -> None:
            near = None
            if left and len(x) >= 16:
                c = x[r.choice(len(x), 2, replace=False)]
                for _ in range(8):
                    near = (x @ c[0]) >= (x @ c[1])
                    if near.all() or not near.any():
                        near = None
                        break
                    c = np.stack([x[near].mean(0), x[~near].mean(0)])
                    c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9
            if near is None:
                out.append(x.mean(0))
            else:
                halve(x[near], left - 1)
                halve(x[~near], left - 1)

        if len(rows):
            halve(rows, depth)
            c = np.stack(out)
            self.centres = (c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
        return self

    def of(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.argmax(self.project(ids, bounds) @ self.centres.T, 1).astype(np.int64)


@tidy
def _projected(batches: Iterator[pa.RecordBatch], held, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bounds = _flat(batch.column(0), dtype)
        rows = held.value.project(ids, bounds)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary())], names=["row"])


def rarest(ids: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rank of each row's rarest term; terms of no other row rank last."""
    return np.minimum.reduceat(rank[ids], bounds[:-1]).astype(np.int64)


def ranks(df: np.ndarray) -> np.ndarray:
    """Place of each term by document frequency; those that fewer than two rows have share the last place."""
    out = np.full(len(df), len(df), np.int32)
    order = np.lexsort((np.arange(len(df)), df))
    order = order[df[order] > 1]
    out[order] = np.arange(len(order))
    return out


def _sub(rare: np.ndarray) -> np.ndarray:
    return (rare * np.int64(0x9E3779B1) >> np.int64(7)) % SUB_BINS


@tidy
def _weigh(batches: Iterator[pa.RecordBatch], held, dtype: str) -> Iterator[pa.RecordBatch]:
    """Ids by cell and sub-bin, added up within the task."""
    forget()
    rank, cells = held.value
    size: dict[int, int] = {}
    for batch in batches:
        ids, bounds = _flat(batch.column(0), dtype)
        if len(bounds) < 2:
            continue
        key, at = np.unique(cells.of(ids, bounds) * SUB_BINS + _sub(rarest(ids, bounds, rank)), return_inverse=True)
        for k, n in zip(key.tolist(), np.bincount(at, weights=np.diff(bounds)).astype(np.int64).tolist(), strict=True):
            size[k] = size.get(k, 0) + n
    keys = np.array(sorted(size), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys // SUB_BINS), pa.array(keys % SUB_BINS), pa.array([size[k] for k in keys.tolist()], pa.int64())], names=["first", "sub", "n"])


class Deal:
    """Where rows go: bins in order of their cell, each a stretch of the ids of the table."""

    def __init__(self, cells: int, total: int, by_first: dict[int, int], shard_tokens: int):
        self.shard_tokens = max(1, shard_tokens)
        fine = max(self.shard_tokens // 8, 2 * total // MOST_BINS, 1)
        self.subs = np.ones(cells, np.int64)
        for k, n in by_first.items():
            self.subs[k] = min(SUB_BINS, 1 << max(0, -(-n // fine) - 1).bit_length())
        self.firsts = np.concatenate([[0], np.cumsum(self.subs)])
        self.base = self.width = np.zeros(0, np.int64)

    def bins(self, size: dict[int, int]) -> None:
        width = np.zeros(self.firsts[-1], np.int64)
        for k, n in size.items():
            width[k] = n
        self.width, self.base = width, np.cumsum(width) - width

    def shards(self, cell: np.ndarray, rare: np.ndarray, share: np.ndarray) -> np.ndarray:
        """``share``: a number from 0 to 1 of each row, by which the rows of a bin lie in its stretch."""
        at = self.firsts[cell] + _sub(rare) % self.subs[cell]
        return ((self.base[at] + share * self.width[at]) // self.shard_tokens).astype(np.int64)


@tidy
def _deal(batches: Iterator[pa.RecordBatch], held, dtype: str) -> Iterator[pa.RecordBatch]:
    forget()
    rank, cells, deal = held.value
    times: dict[int, int] = {}
    for batch in batches:
        ids, bounds = _flat(batch.column(1), dtype)
        if len(bounds) < 2:
            continue
        raw = ids.view(np.uint8)
        width, share = ids.dtype.itemsize, np.zeros(len(bounds) - 1)
        for i, (k, a, b) in enumerate(zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            h = xxhash.xxh64_intdigest(raw[a * width : b * width], (k or 0) & 0xFFFFFFFFFFFFFFFF)
            times[h] = t = times.get(h, 0) + 1
            share[i] = (h if t == 1 else xxhash.xxh64_intdigest(struct.pack("<QQ", h, t))) / (1 << 64)
        shard = deal.shards(cells.of(ids, bounds), rarest(ids, bounds, rank), np.minimum(share, 1 - 1e-9))
        yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[:2]], names=["shard", "doc_id", "ids"])


class Index:
    """BM25 postings of one shard: by term, the rows that have it and what it adds to their score.

    ``df``, ``n`` and ``mean`` are those of the whole table; left out, the shard's own.
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray | None = None, n: int | None = None, mean: float | None = None):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        row, term, tf = distinct_terms(np.concatenate(docs), np.concatenate([[0], np.cumsum(lengths)]))
        own = np.bincount(term)
        df, n = (own, len(docs)) if df is None else (df, n)
        idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(1.0, lengths.mean() if mean is None else mean)))
        self.n = len(docs)
        self.bounds = np.searchsorted(row, np.arange(len(docs) + 1))
        self.terms, self.weight, self.shared = term, gain, own[term] > 1
        # Terms that many rows have stand as rows of a table, the others as lists of the rows that have them.
        many = np.flatnonzero(own > max(16, self.n // DENSE))
        self.dense = np.full(len(own), -1, np.int32)
        self.dense[many] = np.arange(len(many))
        self.table = np.zeros((len(many), self.n), np.float32)
        at = self.dense[term]
        self.table[at[at >= 0], row[at >= 0]] = gain[at >= 0]
        few = at < 0
        order = np.argsort(term[few].astype(np.uint16) if len(own) <= 1 << 16 else term[few], kind="stable")
        self.rows, self.gains = row[few][order].astype(np.int32), gain[few][order].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.where(self.dense < 0, own, 0))])

    def query(self, row: int, most: int | None) -> np.ndarray:
        """The terms of a row that another row of the shard has; of them the ``most`` with the highest weight."""
        a, b = self.bounds[row], self.bounds[row + 1]
        terms, w = self.terms[a:b][self.shared[a:b]], self.weight[a:b][self.shared[a:b]]
        return terms if most is None or len(terms) <= most else terms[np.argsort(-w, kind="stable")[:most]]

    def neighbours(self, row: int, used: np.ndarray, most: int | None = None) -> Iterator[int]:
        """Unused rows that share a query term, best first."""
        t = self.query(row, most)
        at = joined(self.starts[t], self.starts[t + 1] - self.starts[t])
        scores = np.bincount(self.rows[at], weights=self.gains[at], minlength=self.n).astype(np.float64)
        scores += self.table[self.dense[t][self.dense[t] >= 0]].sum(0)
        scores[used] = 0
        held = 32
        while True:
            found = np.flatnonzero(scores)
            if len(found) > held:
                found = found[scores[found] >= -np.partition(-scores[found], held)[held]]
            if not len(found):
                return
            yield from found[np.argsort(-scores[found], kind="stable")].tolist()
            scores[found] = 0
            held *= 4


def plan(docs: list[np.ndarray], window: int = WINDOW, index: Index | None = None, query_terms: int | None = None) -> list[tuple[int, int, int, int, int, bool]]:
    """(row, start, length, sequence, offset, whether it leads its sequence) of every piece of a shard."""
    index, used = index or Index(docs), np.zeros(len(docs), dtype=bool)
    waiting = np.argsort([-len(d) for d in docs], kind="stable")
    out, seq, room, lead, at = [], 0, window, True, 0

    def place(row: int, start: int) -> int:
        """Fill the open sequence from ``start`` on; returns where the row's rest begins."""
        nonlocal seq, room, lead
        n = min(room, len(docs[row]) - start)
        out.append((row, start, n, seq, window - room, lead))
        room, lead = room - n, False
        if not room:
            seq, room, lead = seq + 1, window, True
        return start + n

    while at < len(waiting):
        row = int(waiting[at])
        if used[row]:
            at += 1
            continue
        start, used[row] = 0, True
        while row is not None:
            while start < len(docs[row]):
                start = place(row, start)
            if lead:
                break
            row_next = None
            for n in index.neighbours(row, used, query_terms):
                used[n] = True
                row_next, start = n, place(n, 0)
                if start < len(docs[row_next]) or lead:
                    break
            row = row_next
    return out


def _tail(pieces: list[tuple], window: int, least: int) -> list[tuple]:
    """Cut the last, partly filled sequence into sequences of powers of two, down to ``least``, and a rest."""
    if not pieces:
        return pieces
    seq = pieces[-1][3]
    own = [p for p in pieces if p[3] == seq]
    left = sum(p[2] for p in own)
    if left == window:
        return pieces
    out, room = pieces[: len(pieces) - len(own)], 0
    seq -= 1
    for row, start, n, _, _, _ in own:
        while n:
            if not room:
                size = 1 << (left.bit_length() - 1)
                size = size if size >= least else left
                seq, room, offset = seq + 1, size, 0
            k = min(room, n)
            out.append((row, start, k, seq, offset, offset == 0))
            start, n, room, left, offset = start + k, n - k, room - k, left - k, offset + k
    return out


@tidy
def _pack(table: pa.Table, dtype: str, window: int, least: int, held, query_terms: int | None) -> pa.Table:
    forget()
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    docs = [np.frombuffer(b, dtype) for _, b in rows]
    shard = table.column("shard")[0].as_py()
    df, n, mean = held.value
    pieces = _tail(plan(docs, window, Index(docs, df, n, mean), query_terms), window, least)
    length: dict[int, int] = {}
    for p in pieces:
        length[p[3]] = length.get(p[3], 0) + p[2]
    cols = {
        "doc_id": pa.array([rows[p[0]][0] for p in pieces], pa.int64()),
        "start": pa.array([p[1] for p in pieces], pa.int64()),
        "length": pa.array([p[2] for p in pieces], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(docs[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes()) for p in pieces], pa.int64()),
        "doc_tokens": pa.array([len(docs[p[0]]) for p in pieces], pa.int64()),
        "sequence_id": pa.array([(shard << 32) + p[3] for p in pieces], pa.int64()),
        "offset": pa.array([p[4] for p in pieces], pa.int64()),
        "padded_to": pa.array([n if (n := length[p[3]]) & (n - 1) == 0 else window for p in pieces], pa.int64()),
        "seed": pa.array([p[5] for p in pieces], pa.bool_()),
    }
    return pa.table(cols)


def pack(docs: DataFrame, blob: bytes, window: int = WINDOW, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, least: int = LEAST, query_terms: int | None = None, sample: int = SAMPLE, known_chunks: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document; one row per piece, its sequence and its place there.

    ``known_chunks`` bounds the chunks that a worker keeps (memory against time, same ids).
    ``query_terms`` bounds the terms with which a seed asks; None asks with all. Texts do not move: their
    ids are written once, read to weigh the bins and once more to deal them to the shards. ``sample`` bounds
    the rows on which the cells are fitted; a row's cell decides only beside which others it stands.
    """
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    held = spark.sparkContext.broadcast(blob)
    dtype = encoder(blob).dtype
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = materialize(rows.mapInArrow(lambda batches: _encode(batches, held, end_id, known_chunks), "doc_id long, ids binary, counts binary"), "packing-ids")
    total = _totals(every)
    if total is None:
        return spark.createDataFrame([], PIECES)
    df, n, n_ids = total[:-2], int(total[-2]), int(total[-1])
    ids = every.where("counts is null").select("doc_id", "ids")
    order, cells = ranks(df), Cells(df, n)
    plain = spark.sparkContext.broadcast(cells)
    # A share of the rows by a hash, each content once: about ``sample`` rows of 4 * DIMS bytes, whatever the table holds.
    some = ids.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)))).select("ids")
    fitted = sorted(r["row"] for r in some.mapInArrow(lambda batches: _projected(batches, plain, dtype), "row binary").distinct().collect())
    cells = Cells(df, n).fit(np.frombuffer(b"".join(fitted), np.float32).reshape(-1, DIMS))
    known = spark.sparkContext.broadcast((order, cells))
    fine = materialize(ids.select("ids").mapInArrow(lambda batches: _weigh(batches, known, dtype), "first long, sub long, n long").groupBy("first", "sub").agg(F.sum("n").alias("n")), "packing-bins")
    # At most one row for each cell, then at most MOST_BINS and one more for each cell, come to the driver.
    deal = Deal(len(cells.centres), n_ids, {r["first"]: r["n"] for r in fine.groupBy("first").agg(F.sum("n").alias("n")).collect()}, shard_tokens)
    subs = spark.createDataFrame([(i, int(k)) for i, k in enumerate(deal.subs) if k > 1] or [(-1, 1)], "first long, subs long")
    bins = fine.join(F.broadcast(subs), "first", "left").groupBy("first", F.expr("sub % coalesce(subs, 1)").alias("sub")).agg(F.sum("n").alias("n"))
    deal.bins({int(deal.firsts[r["first"]]) + r["sub"]: r["n"] for r in bins.collect()})
    dealing, stats = spark.sparkContext.broadcast((order, cells, deal)), spark.sparkContext.broadcast((df, n, n_ids / n))
    dealt = ids.mapInArrow(lambda batches: _deal(batches, dealing, dtype), "shard long, doc_id long, ids binary")
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack(t, dtype, window, least, stats, query_terms), PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_path("word_bpe_49k.json"), "rb") as f:
        blob = f.read()
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), blob)
