"""An inverted file over vectors: cells, compact codes of what is left of each vector, and exact ranks of what a search keeps.

Cells are the centres of a bounded sample's spherical k-means. A point lies in the cell whose centre is nearest;
the rest of its unit vector is kept as one signed byte a component and a scale. Two tables are written, both
partitioned by cell: codes (with the columns that filters may name) and vectors. A search ranks cells by their centres and
reads the codes of each query's first cells. A code bounds the true score from both sides, so a point whose upper bound
stays below the k-th best lower bound cannot be among the k best; the few that remain are scored by their
vectors. What is returned is therefore exactly the best of the cells that were read. Queries that filters leave
with fewer than k points read twice as many cells in the next round, until they have k or all cells are read.

A large cell is dealt to as many files as it fills. Of points with one and the same vector a batch keeps the
smallest ids only, so copies do not multiply candidates. The driver holds the centres, the number of points of each
cell and one block of queries; blocks follow one another.

Defined cases: a null, empty or odd-sized vector scores 0 against all; equal scores go to the smaller point_id; a
point never answers a query of its own id; fewer than k points give all; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import retrieval
from quern.session import batch_bytes, materialize, ship
from quern.sources.store import read_text, write_text

#: Rows that centres are fitted on, in expectation; cells at most; points of one file of a cell.
SAMPLE, MOST_CELLS, FILE_ROWS = 20_000, 1024, 200_000
#: Share of true neighbours that a search should find, and queries by which ``calibrate`` measures it.
RECALL, MEASURED = 0.95, 256
#: Candidates up to this number are broadcast to the vectors that rank them.
BROADCAST_ROWS = 100_000
_FOUND = "query_id long, cell int, point_id long, low double, high double"


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, zeros where a vector is missing or of another size."""
    v = np.array([r if r is not None and len(r) == dim and None not in r else [0.0] * dim for r in column.to_pylist()], np.float64).reshape(len(column), dim)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    n[n == 0] = 1.0
    return v / n


def centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a centre that loses all its rows takes a row at random."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        gone = np.bincount(near, minlength=len(c)) == 0
        sums[gone] = sample[r.integers(0, len(sample), gone.sum())]
        n = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = sums / np.where(n == 0, 1.0, n)
    return c


def code(units: np.ndarray, near: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signed byte for each component of what a centre leaves, and what a unit of it is worth."""
    rest = units - c[near]
    scale = np.abs(rest).max(1, initial=0) / 127
    return np.rint(rest / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8), scale


class VectorIndex:
    """The tables of an index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        about = json.loads(read_text(spark, f"{self.root}/index.json"))
        self.centres = np.array(about["centres"], np.float64).reshape(-1, about["dim"])
        self.sizes, self.columns = {int(k): n for k, n in about["sizes"].items()}, about["columns"]

    @classmethod
    def build(cls, points: DataFrame, root: str, cells: int | None = None, columns: tuple[str, ...] = (), sample: int = SAMPLE) -> VectorIndex:
        """Index points (point_id, vec and the named columns); the number of cells follows the number of points."""
        spark = points.sparkSession
        ship(spark)
        batch_bytes(spark)
        n, dim = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        dim = max(dim, 1)
        cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
        share = min(1.0, sample / max(n, 1))
        picked = points.where(F.size("vec") == dim).where(F.pmod(F.xxhash64("point_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("vec").cast("array<double>")).limit(2 * sample).toArrow().column(0)
        fitted = centres(_units(picked, dim), cells) if len(picked) else np.zeros((1, dim))
        held = spark.sparkContext.broadcast(fitted)
        rest = [f for f in points.schema.fields if f.name in columns]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for b in batches:
                u = _units(b.column("vec"), dim)
                near = np.argmax(u @ c.T, 1) if len(u) else np.zeros(0, np.int64)
                codes, scale = code(u, near, c)
                own = {"code": pa.array([x.tobytes() for x in codes], pa.binary()), "scale": pa.array(scale, pa.float64()), "cell": pa.array(near, pa.int32())}
                yield pa.RecordBatch.from_arrays([*b.columns, *own.values()], names=[*b.schema.names, *own])

        named = points.select(F.col("point_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"), F.xxhash64(F.col("vec").cast("array<double>")).alias("h"), *columns)
        fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
        made = materialize(named.mapInArrow(assign, f"point_id long, vec array<double>, h long{fields}, code binary, scale double, cell int"), "index-cells")
        sizes = {r["cell"]: r["n"] for r in made.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        files = F.create_map(*[F.lit(x) for k, m in sizes.items() for x in (k, -(-m // FILE_ROWS))])[F.col("cell")] if sizes else F.lit(1)
        dealt = made.repartition("cell", F.pmod(F.xxhash64("point_id"), files))
        dealt.select("point_id", "h", "code", "scale", *columns, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/codes")
        dealt.select("point_id", "vec", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/vectors")
        write_text(spark, f"{root}/index.json", json.dumps({"dim": dim, "centres": fitted.ravel().tolist(), "sizes": sizes, "columns": {f.name: f.dataType.simpleString() for f in rest}}))
        return cls(spark, root)

    def _table(self, name: str, fields: str) -> DataFrame:
        return self.spark.read.schema(f"{fields}, cell int").parquet(f"{self.root}/{name}")

    def search(self, queries: DataFrame, k: int, probed: float, same: str | None = None, where: Column | None = None) -> DataFrame:
        """query_id, rank, point_id and score (``retrieval.RANKED`` decimals) of each query's best points in the cells it reads.

        ``probed`` is the share of the cells that it reads at first, see ``calibrate``.

        ``queries``: query_id, qvec, and tenant where ``same`` names the points' column that must equal it.
        ``where`` is a condition on the indexed columns. ``read`` afterwards holds the points read for each query, on average.
        """
        self.read, asked = 0, queries.count()
        none = self.spark.createDataFrame([], "query_id long, rank int, point_id long, score double")
        if not self.sizes or not asked:
            return none
        blocks = max(1, math.ceil(asked / retrieval.MOST_QUERIES))
        own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        made = [self._block(queries.where(own == i), k, probed, same, where) for i in range(blocks)]
        self.read /= asked
        return reduce(DataFrame.unionByName, [m.drop("cell") for m in made], none)

    def calibrate(self, queries: DataFrame, k: int, recall: float = RECALL, most: int = MEASURED) -> float:
        """The least share of cells in which at least ``recall`` of the true neighbours of some queries lie.

        About ``most`` of the queries, taken by a hash, read all cells once; where each neighbour's cell stands in its
        query's order gives the share that would have found it. The rows that reach the driver are at most k for each.
        """
        n = queries.count()
        if not self.sizes or not n:
            return 1.0
        some = queries.where(F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))).limit(2 * most) if n > most else queries
        self.read = 0
        live = np.array(sorted(self.sizes))
        rows = {r["query_id"]: r["qvec"] for r in some.select("query_id", "qvec").collect()}
        ids = sorted(rows)
        q = _units(pa.array([rows[i] for i in ids], pa.list_(pa.float64())), self.centres.shape[1])
        order = live[np.argsort(-(q @ self.centres[live].T), axis=1, kind="stable")]
        place = {i: {c: p for p, c in enumerate(o)} for i, o in zip(ids, order.tolist(), strict=True)}
        at = sorted(place[r["query_id"]][r["cell"]] + 1 for r in self._block(some, k, 1.0, None, None).collect())
        return at[min(len(at), math.ceil(recall * len(at))) - 1] / len(live) if at else 1.0

    def _block(self, queries: DataFrame, k: int, probed: float, same: str | None, where: Column | None) -> DataFrame:
        rows = sorted(queries.collect(), key=lambda r: r["query_id"])
        ids, dim = np.array([r["query_id"] for r in rows], np.int64), self.centres.shape[1]
        q = _units(pa.array([r["qvec"] for r in rows], pa.list_(pa.float64())), dim) if rows else np.zeros((0, dim))
        tenants = np.array([r["tenant"] if same else None for r in rows], object)
        live = np.array(sorted(self.sizes))
        order = live[np.argsort(-(q @ self.centres[live].T), axis=1, kind="stable")]
        # All of a round's cells are read again with more of them: a query's rows are whole in its last round.
        out, todo, n = [], np.arange(len(rows)), max(1, math.ceil(probed * len(live)))
        while len(todo):
            n = min(n, len(live))
            near = self._near(ids[todo], q[todo], tenants[todo], order[todo, :n], k, same, where)
            self.read += sum(self.sizes[c] for c in order[todo, :n].ravel().tolist())
            if n == len(live):
                out.append(near)
                break
            full = {r["query_id"] for r in near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id").collect()}
            has = np.array([i in full for i in ids[todo].tolist()])
            out.append(near.join(F.broadcast(self.spark.createDataFrame([(int(i),) for i in ids[todo][has]], "query_id long")), "query_id", "left_semi") if has.any() else near.limit(0))
            todo, n = todo[~has], 2 * n
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "query_id long, rank int, point_id long, score double, cell int")

    def _near(self, ids: np.ndarray, q: np.ndarray, tenants: np.ndarray, cells: np.ndarray, k: int, same: str | None, where: Column | None) -> DataFrame:
        by: dict[int, list[int]] = {}
        for i, row in enumerate(cells.tolist()):
            for c in row:
                by.setdefault(c, []).append(i)
        held = self.spark.sparkContext.broadcast((ids, q, tenants, {c: np.array(x) for c, x in by.items()}, self.centres))
        fields = ", ".join(["point_id long", "h long", "code binary", "scale double", *(f"`{n}` {t}" for n, t in self.columns.items())])
        rows = self._table("codes", fields).where(F.col("cell").isin(list(by)))
        rows = rows if where is None else rows.where(where)
        taken = rows.select("point_id", "h", "code", "scale", "cell", *([F.col(same).alias("own")] if same else []))
        w = Window.partitionBy("query_id")
        bounded = taken.mapInArrow(lambda b: _bounds(b, held, k, bool(same)), _FOUND).withColumn("place", F.row_number().over(w.orderBy(F.desc("low"), "point_id")))
        # The k-th best lower bound over all batches; what may still reach it is scored.
        least = bounded.withColumn("least", F.coalesce(F.max(F.when(F.col("place") == k, F.col("low"))).over(w), F.lit(-math.inf)))
        may = materialize(least.where("high >= least").select("query_id", "cell", "point_id"), "index-candidates")
        some = {r["cell"] for r in may.select("cell").distinct().collect()}
        known = self._table("vectors", "point_id long, vec array<double>").where(F.col("cell").isin(list(some)))
        both = known.join(F.broadcast(may) if may.count() <= BROADCAST_ROWS else may, ["cell", "point_id"])
        scored = both.select("query_id", "point_id", "vec", "cell").mapInArrow(lambda b: _exact(b, held), "query_id long, point_id long, score double, cell int")
        turn = w.orderBy(F.desc("score"), "point_id")
        return materialize(scored.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "score", "cell"), "index-found")


def _bounds(batches: Iterator[pa.RecordBatch], held, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Of each batch and query the points that can be among its k best, with both bounds of their scores."""
    ids, q, tenants, by, c = held.value
    wide = np.abs(q).sum(1)
    for batch in batches:
        out: list[tuple] = []
        points, h, cell, scale = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("point_id", "h", "cell", "scale"))
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(points), -1)
        own = np.array(batch.column("own").to_pylist(), object) if same else None
        for n in np.unique(cell):
            at = np.flatnonzero(cell == n)
            at = at[np.lexsort((points[at], h[at]))]
            if not same:  # of equal vectors the k + 1 smallest ids are enough
                first = np.flatnonzero(np.concatenate([[True], h[at][1:] != h[at][:-1]]))
                at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) <= k]
            asked = by.get(int(n), np.zeros(0, np.int64))
            for a in range(0, len(asked), 256):
                i = asked[a : a + 256]
                about = (codes[at].astype(np.float64) @ q[i].T) * scale[at][:, None] + (c[n] @ q[i].T)[None, :]
                off = 0.5 * scale[at][:, None] * wide[i][None, :] + 1e-9
                ok = points[at][:, None] != ids[i][None, :]
                if same:
                    ok &= own[at][:, None] == tenants[i][None, :]
                for j, query in enumerate(i):
                    x = np.flatnonzero(ok[:, j])
                    low, high = about[x, j] - off[x, j], about[x, j] + off[x, j]
                    if len(x) > k:
                        keep = high >= np.partition(low, len(x) - k)[len(x) - k]
                        x, low, high = x[keep], low[keep], high[keep]
                    out.append((np.full(len(x), ids[query]), np.full(len(x), n, np.int32), points[at][x], low, high))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["query_id", "cell", "point_id", "low", "high"])


def _exact(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    ids, q, *_ = held.value
    for b in batches:
        at = np.searchsorted(ids, b.column(0).to_numpy())
        score = np.round((_units(b.column(2), q.shape[1]) * q[at]).sum(1), retrieval.RANKED) + 0.0
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), b.column(3)], names=["query_id", "point_id", "score", "cell"])
