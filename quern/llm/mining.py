"""Hard negatives by a two-dimensional block product: tiles of integer scores, summed over chunks of axes.

Vectors become integers floor(scale * x). Anchors and rows are cut into blocks, and each block's axes into
chunks; a panel is one chunk of one block. Panels are dealt to a grid: every anchor panel goes along its
row of cells, every row panel along its column, and a cell multiplies what meets in it into partial
tiles of int64 scores. Partial tiles of one pair of blocks meet in a shuffle, are added, and leave only
their best rows. This happens twice. The first product takes blocks that share a label and gives each
anchor its positives. The second takes blocks that hold different labels; each anchor brings its positives'
scores, so a tile leaves the best rows of every window between ``low`` and ``high`` percent of a positive's
score. Blocks are cut along labels, so together both products cost little more than one.

A task holds the panels of one cell (at most ``GRID`` of each side) or the partial tiles of one pair of blocks,
however many rows there are; a label, vector or id that a third of the rows has changes nothing, since
blocks are dealt by position. The work is the number of anchors times the number of rows, as for any
exact product.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or a non-finite
component, take no part; a shorter vector counts as filled up with zeros; equal scores go to the
smaller id; rows with an anchor's own id are none of its others; rows that repeat an id are candidates each,
and an anchor whose id is repeated asks once, with its smallest label and vector; a positive's window is
empty where its score is negative; an anchor without positives gives no rows; an empty table gives no rows;
other columns are ignored; integers whose products could leave 63 bits stop with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import batch_bytes, give_back, materialize, ship, tidy

SCALE = 256
#: Anchors and rows in a block, axes in a chunk, panels of each side in a cell.
ANCHORS, ROWS, AXES, GRID = 128, 1024, 32, 4
#: Blocks that a panel-cutting task sorts along labels at a time.
HELD = 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Sums of products up to this size are exact in float64.
EXACT = 1 << 53

_PANEL = "block long, chunk int, n int, ids binary, labels binary, v binary"
_TILE = "a long, b long, n int, m int, ids binary, labels binary, own binary, own_labels binary, wanted binary, tile binary"
_FOUND = "anchor_id long, a long, place int, rank_of int, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label and v (array<bigint>) of the rows that take part."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where("label IS NOT NULL")


def panels(rows: DataFrame, size: int, dim: int, axes: int) -> DataFrame:
    """``rows`` in blocks of at most ``size``, each cut into chunks of ``axes`` axes; names of blocks are those of their task and place in it."""

    def cut(held: list[pa.RecordBatch], part: int, first: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        labels = t.column("label").to_numpy()
        order = np.lexsort((t.column("vec_id").to_numpy(), labels))
        for b, at in enumerate(range(0, len(order), size)):
            p = t.take(pa.array(order[at : at + size]))
            v = _matrix(p.column("v").combine_chunks(), dim)
            ids, own = p.column("vec_id").to_numpy().astype("<i8").tobytes(), p.column("label").to_numpy().astype("<i8").tobytes()
            block = (part << 32) + first + b
            chunks = range(-(-dim // axes))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * len(chunks), pa.int64()),
                    "chunk": pa.array(chunks, pa.int32()),
                    "n": pa.array([p.num_rows] * len(chunks), pa.int32()),
                    "ids": pa.array([ids] * len(chunks), pa.binary()),
                    "labels": pa.array([own] * len(chunks), pa.binary()),
                    "v": pa.array([np.ascontiguousarray(v[:, c * axes : (c + 1) * axes]).tobytes() for c in chunks], pa.binary()),
                }
            )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n, first = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            while n + batch.num_rows >= HELD * size:
                held.append(batch[: HELD * size - n])
                batch = batch[HELD * size - n :]
                yield from cut(held, part, first)
                held, n, first = [], 0, first + HELD
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield from cut(held, part, first)

    return rows.mapInArrow(run, _PANEL)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), dim), "<i8")
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _done(t: pa.Table) -> pa.Table:
    give_back()
    return t


def _packed(triples: Column | str) -> Column:
    """Triples of longs as little-endian bytes."""
    little = lambda x: F.reverse(F.regexp_replace(F.lpad(F.hex(x), 16, "0"), "(.)(.)", "$2$1"))
    return F.unhex(F.array_join(F.transform(F.flatten(triples), little), ""))


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, exactly: by float64 where no sum can pass 2**53, else by int64."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most < EXACT:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def tiles(asking: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """Partial tiles of the pairs of blocks that may hold pairs of the same label, or of different ones.

    Anchor panels are repeated for every column of the grid and row panels for every row of it, so that each
    cell gets its own; how many there are follows from two numbers of each table.
    """

    def meets(a: np.ndarray, b: np.ndarray) -> bool:
        if same:
            return bool(len(np.intersect1d(a, b)))
        return not ((a == a[0]).all() and (b == a[0]).all())

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k.split()[0]: [] for k in _TILE.split(", ")}
        axes = lambda r: _longs(r["v"]).reshape(r["n"], -1)
        mine = [(r, axes(r), _longs(r["labels"])) for r in left.to_pylist()]
        for r in right.to_pylist():
            v, labels = axes(r), _longs(r["labels"])
            for a, w, own in mine:
                if not meets(own, labels):
                    continue
                lead = a["chunk"] == 0  # one of the partial tiles carries the names of both sides
                named = (r["ids"], r["labels"], a["ids"], a["labels"], a["wanted"]) if lead else (None,) * 5
                row = (a["block"], r["block"], a["n"], r["n"], *named, product(w, v).astype("<i8").tobytes())
                for k, x in zip(out, row, strict=True):
                    out[k].append(x)
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table({k: pa.array(x, kinds[t.split()[1]]) for t, (k, x) in zip(_TILE.split(", "), out.items(), strict=True)})

    def strips(t: DataFrame) -> tuple[Column, int]:
        """The strip of a panel, a run of ``GRID`` blocks of one cutting task, and one more than the last strip."""
        part, last = t.agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND((1 << 32) - 1))).first()
        part, last = part or 0, last or 0  # without panels one strip, in which nothing meets
        each = last // GRID + 1
        return (F.shiftright("block", 32) * each + F.floor(F.col("block").bitwiseAND((1 << 32) - 1) / GRID)).cast("long"), (part + 1) * each

    (own, down), (other, across) = strips(asking), strips(rows)
    left = asking.withColumn("row", own).withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    right = rows.withColumn("column", other).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    at = ["row", "column", "chunk"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(lambda a, b: _done(cell(a, b)), _TILE)


def _whole(t: pa.Table) -> tuple[dict, np.ndarray]:
    """The names of a tile and the sum of its partial tiles."""
    total = sum(_longs(x.as_py()) for x in t.column("tile"))
    lead = t.filter(pc.is_valid(t.column("ids"))).select(["a", "ids", "labels", "own", "own_labels", "wanted"]).to_pylist()[0]
    return lead, total.reshape(t.column("n")[0].as_py(), t.column("m")[0].as_py())


def _rows(a: int, found: list[tuple]) -> pa.Table:
    """found: of each anchor and place, anchor_id, place, place of the positive, ids and scores."""
    n = [len(f[3]) for f in found]
    each = lambda i, kind: pa.array(np.repeat(np.array([f[i] for f in found], kind), n) if found else np.zeros(0, kind))
    flat = lambda i: pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64), pa.int64())
    return pa.table({"anchor_id": each(0, np.int64), "a": pa.array([a] * sum(n), pa.int64()), "place": each(1, np.int32), "rank_of": each(2, np.int32), "vec_id": flat(3), "score": flat(4)})


def nearest(parts: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor's own label: partial tiles are added, tiles leave k rows, and of these the best stay."""

    def best(t: pa.Table) -> pa.Table:
        lead, s = _whole(t)
        ids, labels, own, mine = (_longs(lead[x]) for x in ("ids", "labels", "own", "own_labels"))
        found = []
        for i, anchor in enumerate(own):
            at = np.flatnonzero((labels == mine[i]) & (ids != anchor))
            at = at[np.lexsort((ids[at], -s[i, at]))[:k]]
            found.append((anchor, i, 0, ids[at], s[i, at]))
        return _rows(lead["a"], found)

    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return parts.groupBy("a", "b").applyInArrow(lambda t: _done(best(t)), _FOUND).withColumn("rank_of", F.row_number().over(w)).where(F.col("rank_of") <= k)


def inside(parts: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of other labels in the window of each positive that the anchors brought."""

    def best(t: pa.Table) -> pa.Table:
        lead, s = _whole(t)
        ids, labels, own, mine = (_longs(lead[x]) for x in ("ids", "labels", "own", "own_labels"))
        windows: dict[int, list[tuple[int, int]]] = {}
        for place, rank, p in _longs(lead["wanted"] or b"").reshape(-1, 3).tolist():
            windows.setdefault(place, []).append((rank, p))
        found = []
        for i, each in windows.items():
            score = 100 * s[i]
            lo, hi = min(low * p for _, p in each), max(high * p for _, p in each)
            at = np.flatnonzero((labels != mine[i]) & (ids != own[i]) & (score >= lo) & (score <= hi))
            at = at[np.lexsort((ids[at], -score[at]))]
            for rank, p in each:
                first, end = np.searchsorted(-score[at], [-high * p, -low * p], "left")
                end += np.count_nonzero(score[at] == low * p)
                take = at[first : min(end, first + k)]
                found.append((own[i], i, rank, ids[take], s[i, take]))
        return _rows(lead["a"], found)

    w = Window.partitionBy("anchor_id", "rank_of").orderBy(F.desc("score"), "vec_id")
    return parts.groupBy("a", "b").applyInArrow(lambda t: _done(best(t)), _FOUND).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, k: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", axes: int = AXES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` marks the rows that ask, by ``vec_id``; ``label`` is an expression over ``vectors``.
    """
    spark = vectors.sparkSession
    ship(spark)
    batch_bytes(spark)
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = materialize(integers(vectors, id_col, vec_col, label, scale), "mine-rows")
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if not n:
        return none
    if 100.0 * most >= float(1 << 62):
        raise ValueError("these integers' products may leave 63 bits; use a smaller scale")
    asking = materialize(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "mine-anchors")
    few = asking.count()
    if not few:
        return none
    dim = max(1, dim)
    left = materialize(panels(asking.coalesce(max(1, -(-few // ANCHORS))), ANCHORS, dim, axes), "mine-anchor-panels")
    right = materialize(panels(rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-n // (HELD * ROWS)))), ROWS, dim, axes), "mine-row-panels")

    own = materialize(nearest(tiles(left.withColumn("wanted", F.lit(None).cast("binary")), right, True), k), "mine-positives")
    brought = own.where("score >= 0").groupBy(F.col("a").alias("block")).agg(F.collect_list(F.array(F.col("place").cast("long"), F.col("rank_of").cast("long"), "score")).alias("w"))
    # Of each anchor block at most ANCHORS * k windows, which its first panel carries.
    asking = left.join(brought.withColumn("wanted", _packed("w")).select("block", "wanted"), "block")
    found = inside(tiles(materialize(asking, "mine-windows"), right, False), negatives, low, high)
    positives = own.select("anchor_id", "rank_of", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positives, ["anchor_id", "rank_of"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}
"""
