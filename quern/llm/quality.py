"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of 8 bytes run at every fourth byte, and their responses are
max-pooled over overlapping chunks (256 bytes, 64 shared) that cover the whole document. Mean, maximum
and minimum over a document's chunks go into one logistic score. A longer document is worked off in
pieces of whole chunks, so memory stays bounded.

The network is trained on the driver on a bounded sample of labelled rows: at most ``most_rows`` rows in
order of a hash of doc_id, half of each label where there are enough, and at most ``most_bytes`` of text.
Rows whose crc32(doc_id) mod 4 is 2 are held out and never trained on. Training has a fixed seed.

Defined cases: a null text is an empty text and gets a score; labels other than 0 and 1, null doc_ids
among labels, and doc_ids with both labels are left out of training; of documents that repeat a doc_id
the smallest text is trained on; with fewer than one row of each label every score is the share of label
1 (0.5 with none); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import slices
from quern.session import batch_bytes, materialize, ship, tidy

STEP, EMBED, FILTERS = 4, 8, 32
BLOCK = 64
CHUNK_BLOCKS, CHUNK_STEP = 4, 3
PIECE_CHUNKS = 4096
MOST_ROWS, MOST_BYTES = 2400, 8 << 20
KEEP_FROM = 0.7
#: Characters of texts that are scored at a time.
SCORED = 128_000
SPOTS = BLOCK // STEP


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees; one without an id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, each padded to its chunks; chunks of each piece; the document of each piece."""
    step, parts, chunks, owner = BLOCK * CHUNK_STEP, [], [], []
    for d, t in enumerate(texts):
        total = max(1, -(-(len(t) - BLOCK) // step))
        for a in range(0, total, PIECE_CHUNKS):
            n = min(PIECE_CHUNKS, total - a)
            own = t[a * step : (a + n) * step + BLOCK]
            parts.append(own + b"\0" * (n * step + BLOCK - len(own)))
            chunks.append(n)
            owner.append(d)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(chunks), np.array(owner)


class Net:
    """The network's weights, its forward pass and one training step."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = STEP * EMBED
        self.p = {
            "emb": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w1": r.normal(0, (2 * wide) ** -0.5, (wide, FILTERS)).astype(np.float32),
            "w2": r.normal(0, (2 * wide) ** -0.5, (wide, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.fixed: float | None = None

    def pooled(self, data: np.ndarray, chunks: np.ndarray, trace: bool = False):
        """Filter responses max-pooled by chunk; with ``trace`` also what training needs."""
        p = self.p
        x = p["emb"][data].reshape(-1, STEP * EMBED)
        ends = np.cumsum((chunks * CHUNK_STEP + 1) * SPOTS)
        ahead = np.empty((len(x), FILTERS), np.float32)
        ahead[:-1] = (x @ p["w2"])[1:]
        ahead[ends - 1] = np.tile(p["emb"][0], STEP) @ p["w2"]
        z = x @ p["w1"]
        z += ahead
        z += p["b"]
        np.maximum(z, 0, out=z)
        by_block = z.reshape(-1, SPOTS, FILTERS)
        peak = by_block.max(1)
        first = np.concatenate([np.arange(n) * CHUNK_STEP + s for n, s in zip(chunks, ends // SPOTS - (chunks * CHUNK_STEP + 1), strict=True)])
        near = np.stack([peak[first + k] for k in range(CHUNK_BLOCKS)])
        if not trace:
            return near.max(0)
        which = near.argmax(0) + first[:, None]
        spot = which * SPOTS + by_block.argmax(1)[which, np.arange(FILTERS)]
        return near.max(0), spot, x, ends

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        data, chunks, owner = layout(texts)
        f = self.pooled(data, chunks)
        starts = np.flatnonzero(np.diff(np.repeat(owner, chunks), prepend=-1))
        n = np.bincount(owner, weights=chunks)[:, None]
        feats = np.hstack([np.add.reduceat(f, starts, axis=0, dtype=np.float64) / n, np.maximum.reduceat(f, starts, axis=0), np.minimum.reduceat(f, starts, axis=0)])
        logit = feats @ self.p["out"].astype(np.float64) + float(self.p["bias"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[dict, float]:
        p = self.p
        data, chunks, owner = layout(texts)
        f, spot, x, ends = self.pooled(data, chunks, trace=True)
        doc = np.repeat(owner, chunks)
        starts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        feats, tops, lows = [], [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            tops.append(a + f[a:b].argmax(0))
            lows.append(a + f[a:b].argmin(0))
            cols = np.arange(FILTERS)
            feats.append(np.concatenate([f[a:b].mean(0), f[tops[-1], cols], f[lows[-1], cols]]))
        feats = np.array(feats, np.float32)
        prob = 1 / (1 + np.exp(-np.clip(feats @ p["out"] + p["bias"], -30, 30)))
        g = ((prob - labels) / len(labels)).astype(np.float32)
        gf = g[:, None] * p["out"]
        gc = (gf[:, :FILTERS] / np.diff(starts)[:, None])[doc]
        cols = np.tile(np.arange(FILTERS), len(tops))
        np.add.at(gc, (np.concatenate(tops), cols), gf[:, FILTERS : 2 * FILTERS].ravel())
        np.add.at(gc, (np.concatenate(lows), cols), gf[:, 2 * FILTERS :].ravel())
        gc *= f > 0
        gz = np.bincount((spot * FILTERS + np.arange(FILTERS)).ravel(), weights=gc.ravel(), minlength=len(x) * FILTERS).reshape(-1, FILTERS).astype(np.float32)
        after = np.empty_like(x)
        after[:-1] = x[1:]
        after[ends - 1] = np.tile(p["emb"][0], STEP)
        gx = gz @ p["w1"].T
        back = gz @ p["w2"].T
        last = back[ends - 1].sum(0)
        back[ends - 1] = 0
        gx[1:] += back[:-1]
        ge = gx.reshape(-1, EMBED)
        emb = np.stack([np.bincount(data, weights=ge[:, k], minlength=256) for k in range(EMBED)], 1)
        emb[0] += last.reshape(STEP, EMBED).sum(0)
        loss = float(-np.log(np.where(labels == 1, prob, 1 - prob) + 1e-9).mean())
        return {"emb": emb, "w1": x.T @ gz, "w2": after.T @ gz, "b": gz.sum(0), "out": feats.T @ g, "bias": g.sum(keepdims=True)}, loss

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 24, rate: float = 0.004, seed: int = 11) -> Net:
        """Adam over shuffled batches; the step size falls to a tenth."""
        if len(set(labels.tolist())) < 2:
            self.fixed = float(labels.mean()) if len(labels) else 0.5
            return self
        r, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                grads, _ = self.gradients([texts[i] for i in own], labels[own])
                t += 1
                pace = rate * (1 - 0.9 * t / steps)
                for k, g in grads.items():
                    g = g.astype(np.float32) + (1e-4 * self.p[k] if k != "bias" else 0)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
        return self


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the bounded training sample. Only its ids are broadcast, only its rows come here."""
    key = F.col(id_col).cast("long")
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(key)).groupBy(key.alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").drop("other")
    turn = F.xxhash64("doc_id", F.lit(5))
    by = [clean.where(F.col("label") == k).orderBy(turn, "doc_id").limit(most_rows // 2) for k in (0, 1)]
    picked = materialize(by[0].unionByName(by[1]), "quality-labels")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = materialize(rows.withColumn("turn", turn), "quality-sample")
    sizes = rows.select("doc_id", "turn", F.octet_length("text").alias("n")).orderBy("turn", "doc_id").collect()
    taken, held = [], 0
    for x in sizes:
        if held + x["n"] <= most_bytes:
            taken.append(x["doc_id"])
            held += x["n"]
    got = rows.where(F.col("doc_id").isin(taken)).orderBy("turn", "doc_id").collect() if taken else []
    return [x["text"].encode("utf-8") for x in got], np.array([x["label"] for x in got], dtype=np.float32)


@tidy
def _score(batches: Iterator[pa.RecordBatch], held, at: int, drop: bool) -> Iterator[pa.RecordBatch]:
    net = held.value
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in slices(texts, SCORED):
            got = net.scores([t.encode("utf-8") for t in texts[a:b]])
            cols = [(n, c[a:b]) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if not (drop and i == at)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in cols), pa.array(got)], names=[*(n for n, _ in cols), "score"])


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> Net:
    return Net().fit(*sample(docs, labels, **bounds))


def score(docs: DataFrame, net: Net, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and the score of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    held = spark.sparkContext.broadcast(net)
    extra = [] if text_col in carry else [text_col]
    rows = docs.select(*extra, *carry)
    at = rows.columns.index(text_col)
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[len(extra) :])
    return rows.mapInArrow(lambda batches: _score(batches, held, at, bool(extra)), f"{fields}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
