"""Operators 11 to 13 against brute force, with odd rows, ties, hot keys and empty tables."""

from __future__ import annotations

import datetime
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import mining, mixing, quantiles

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, rank int, block long"


def negatives(rows, anchors, k=5, most=10, low=30, high=90, scale=256):
    """Plain loops over (vec_id, vector, label)."""
    live = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, v, c in live:
        if anchors(i) and (i not in asking or (c, v) < asking[i]):
            asking[i] = (c, v)
    out = []
    for i, (c, v) in asking.items():
        scored = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, w, d in live if j != i), key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in scored if r[2] == c][:k]:
            inside = [r for r in scored if r[2] != c and low * p <= 100 * r[0] <= high * p][:most]
            out += [(i, j, n, m, p, s) for n, (s, m, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 4 == 0) for _ in range(6)], i % 4) for i in range(300)]
    rows += [(1000 + i, rows[5][1], rng.randrange(4)) for i in range(150)]  # one vector of a third of the rows
    rows += [rows[10], rows[10], (20, [0.5] * 6, 2)]  # repeated rows, an anchor with two vectors
    rows += [(400, [0.0] * 6, 1), (500, [1.0, 2.0], 1), (600, [], 1), (700, [1.0] * 9, 3), (-10, [-1.0] * 6, 0)]
    rows += [(None, [1.0] * 6, 1), (800, None, 1), (810, [1.0, None, 1.0], 1), (820, [float("nan")] * 6, 1), (830, [float("inf")] * 6, 1), (840, [1.0] * 6, None)]
    return rows


@pytest.mark.parametrize(("anchors", "rows", "grid", "axes"), [(mining.ANCHORS, mining.ROWS, mining.GRID, mining.AXES), (3, 7, 2, 4), (1, 16, 1, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, vectors, anchors, rows, grid, axes):
    for name, x in (("ANCHORS", anchors), ("ROWS", rows), ("GRID", grid)):
        monkeypatch.setattr(mining, name, x)
    df = spark.createDataFrame([(*r, 7, 8) for r in vectors], VECTORS).repartition(3)
    got = mining.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), axes=axes)
    assert mined(got) == negatives(vectors, lambda i: i % 10 == 0)


def test_negatives_of_huge_integers(spark):
    rows = [(i, [float(1 << 17) * (1 + i % 3), 3.0 * i], i % 2) for i in range(20)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)
    assert mined(mining.mine(df, F.col("vec_id") % 10 == 0, F.col("label"))) == negatives(rows, lambda i: i % 10 == 0)
    x = np.array([[1 << 40, 3], [5, -(1 << 40)]], "<i8")
    assert mining.product(x, x[:, ::-1] % 1000).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x[:, ::-1] % 1000] for p in x]
    with pytest.raises(ValueError, match="63 bits"):
        mining.mine(spark.createDataFrame([(0, [1e30], 1, 0, 0), (1, [1e30], 1, 0, 0)], VECTORS), F.col("vec_id") == 0, F.col("label"))


def test_negatives_of_few_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mined(mining.mine(none, F.col("vec_id") >= 0, F.col("label"))) == []
    one = spark.createDataFrame([(1, [1.0], 1, 0, 0), (2, [1.0], 2, 0, 0)], VECTORS)
    assert mined(mining.mine(one, F.col("vec_id") > 5, F.col("label"))) == []  # no anchor
    assert mined(mining.mine(one, F.col("vec_id") == 1, F.col("label"))) == []  # no positive


def test_partial_tiles_are_few_and_bounded(spark, vectors):
    """Blocks are cut along labels, so a tile of the first product has a label in common, and none holds more than a block of each side."""
    df = spark.createDataFrame([(*r, 0, 0) for r in vectors], VECTORS)
    rows = mining.integers(df, "vec_id", "embedding", F.col("label"), 256).coalesce(1)
    left, right = mining.panels(rows.where("vec_id % 10 = 0"), 8, 9, 4), mining.panels(rows, 32, 9, 4)
    same = mining.tiles(left.withColumn("wanted", F.lit(None).cast("binary")), right, True).collect()
    every = left.where("chunk = 0").count() * right.where("chunk = 0").count()
    assert 0 < len({(r["a"], r["b"]) for r in same}) < 0.7 * every
    assert all(r["n"] <= 8 and r["m"] <= 32 and len(r["tile"]) == 8 * r["n"] * r["m"] for r in same)
    assert all(sum(x["ids"] is not None for x in same if (x["a"], x["b"]) == (r["a"], r["b"])) == 1 for r in same)


ROWS = "stream string, grp string, batch int, x long, weight long, n int, part int"


def plain(rows, parts=4, least=20):
    """Sorted values of every (stream, grp, batch) and whole."""
    by: dict = {}
    for s, g, b, x, w in rows:
        if None not in (s, g, b, x, w):
            for k in ((s, g, b), (s, g, -1)):
                by.setdefault(k, []).extend([x] * w)
    return {k: sorted(v) for k, v in by.items() if len(v) >= least}


def agrees(got, want, parts=4):
    """Every fact but the answers themselves is exact; these are values of their summary, close in rank, nondecreasing."""
    assert {(r["stream"], r["grp"], r["batch"], r["i"]) for r in got} == {(*k, i) for k in want for i in range(1, parts)}
    assert len(got) == (parts - 1) * len(want)
    for r in got:
        v = want[r["stream"], r["grp"], r["batch"]]
        n = len(v)
        below, upto = sum(x < r["answer"] for x in v), sum(x <= r["answer"] for x in v)
        t = -(-r["i"] * n // parts)
        assert (r["n"], r["target"], r["exact_x"], r["n_below"], r["n_upto"]) == (n, t, v[t - 1], below, upto)
        assert r["rank_error"] == max(0, below + 1 - t, t - upto) and 1000 * r["rank_error"] <= 20 * n
        assert v[0] <= r["answer"] <= v[-1] and min(10, len(set(v))) <= r["points"] <= min(n, 1000)
    last: dict = {}
    for r in sorted(got, key=lambda r: r["i"]):
        k = (r["stream"], r["grp"], r["batch"])
        assert r["answer"] >= last.get(k, r["answer"])
        last[k] = r["answer"]


def test_quantiles_equal_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PIECE", 100)
    rng = random.Random(2)
    rows = [("a", f"g{rng.randrange(6)}", rng.randrange(4), rng.randrange(-500, 500), 1) for _ in range(600)]
    rows += [("a", "hot", rng.randrange(4), rng.randrange(10**6), 1) for _ in range(6000)]
    rows += [("b", "hot", rng.randrange(4), 7, rng.randrange(1, 900)) for _ in range(40)]  # one value, many times
    rows += [("b", "small", 0, i, 1) for i in range(19)] + [("b", "two", i % 2, i, 1) for i in range(30)]
    rows += [(None, "g1", 0, 1, 1), ("a", None, 0, 1, 1), ("a", "g1", None, 1, 1), ("a", "g1", 0, None, 1), ("a", "g1", 0, 1, None)] * 30
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], ROWS).repartition(5)
    agrees(quantiles.quantiles(df).collect(), plain(rows))


def test_quantiles_of_no_rows(spark):
    assert quantiles.quantiles(spark.createDataFrame([], ROWS)).collect() == []


def test_streams_of_clicks_and_prices(spark):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
    rng = random.Random(4)
    clicks = [(i, at(i), rng.randrange(3), rng.choice([None, 0.005, 1.25, -3.5, 1000.01, float("nan")])) for i in range(200)]
    clicks += [(5, at(900), 2, 77.0), (6, at(-900), 2, 78.0), (7, at(900), None, None), (None, at(1), 1, 1.0)] + clicks[:20]
    lines = [(rng.choice([None, 1, 2, 3, 4, 9]), rng.choice([None, *range(9)])) for _ in range(300)]
    items = [(1, "x", 2.5), (2, None, 3.0), (3, "y", None), (4, "x", 99.99), (5, "x", 1.0)]
    c = spark.createDataFrame(clicks, "click_id long, arrived_at timestamp, client_id long, value double")
    got = quantiles.clicks_and_prices(c, spark.createDataFrame(lines, "item_id long, vendor_id long"), spark.createDataFrame(items, "item_id long, brand string, price double"))
    first: dict = {}
    for i, t, g, v in clicks:
        if i is not None and (i not in first or t < first[i][0]):
            first[i] = (t, g, v)
    batch = lambda i: zlib.crc32(str(i).encode()) % 4
    x = lambda m, i: math.floor(100 * m + 0.5) + 1000 * batch(i)
    want = [("value", str(g), batch(i), x(v, i)) for i, (_, g, v) in first.items() if g is not None and v is not None and v == v]
    known = {i: (b, p) for i, b, p in items}
    want += [("price", known[i][0], batch(v), x(known[i][1], v)) for i, v in lines if v is not None and i in known and None not in known[i]]
    told = [(r["stream"], r["grp"], r["batch"], r["x"]) for r in got.collect() if None not in (r["grp"], r["batch"], r["x"]) for _ in range(r["weight"])]
    assert sorted(told) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_quantile_query(spark):
    rows = quantiles.clicks_and_prices(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("clicks", "sale_lines", "items"))).collect()
    got = quantiles.op12_quantiles(spark, DATA).collect()
    agrees(got, plain([(r["stream"], r["grp"], r["batch"], r["x"], r["weight"]) for r in rows]))
    assert all(r["within"] for r in got) and {r["stream"] for r in got} == {"value", "price"}


def mixed(rows, share=1.0, weights=(1, 2, 3), most=3):
    """Targets by rounds of sharing, takes from a sorted list of hashes."""
    import hashlib

    words = lambda t: sum(bool(w) for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" "))
    h = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    own: dict = {}
    for i, t, s in rows:
        own.setdefault(s, []).append((h(i), i, words(t)))
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    size = {s: sum(r[2] for r in own[s]) for s in own}
    target, free, left = {}, set(own), sum(size.values()) * share
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * size[s]}
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: float(most * size[s]) for s in full}
        left, free = left - sum(most * size[s] for s in full), free - full
    out = []
    for s, docs in own.items():
        times = int(target[s] // size[s]) if size[s] else 0
        need, below = target[s] - times * size[s], 0
        for x in sorted({d[0] for d in docs}):
            same = [d for d in docs if d[0] == x]
            at = sum(d[2] for d in same)
            part = 1.0 if below + at <= need else max(0.0, (need - below) / at) if at else 0.0
            out += [(d[1], s, d[2], size[s], target[s], times * d[2] + (d[2] if part == 1.0 else math.floor(d[2] * max(0.0, need - below) / at) if at else 0)) for d in same]
            below += at
    return out


def test_mixing_equals_plain_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "é", "z", "hot", "hot", "hot", None])) for i in range(400)]
    rows += [(7, "same id again", "hot")] * 50 + [(None, "no id here", "b")] * 40 + [(900, None, "nothing"), (901, "", "nothing"), (902, "tab\there\nnbsp　x", "a"), (903, "long " * 100_000, "z"), (904, "  lead trail  ", "")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size long, h long").repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2:])
    full = {}
    for few in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
        for share in (1.0, 0.4):
            got = sorted((tuple(r) for r in mixing.mix(df, share).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=key)
            want = sorted(mixed(rows, share), key=key)
            assert [r[:4] for r in got] == [r[:4] for r in want] and [r[5] for r in got] == [r[5] for r in want]
            assert all(math.isclose(a[4], b[4], rel_tol=1e-12) for a, b in zip(got, want, strict=True))
            assert all(r[5] <= 3 * r[2] for r in got)
            for s in {r[1] for r in got}:
                own = [r for r in got if r[1] == s]
                assert own[0][4] - 51 <= sum(r[5] for r in own) <= own[0][4] + 1e-6
            full[share] = got
    assert all(a[5] <= b[5] for a, b in zip(full[0.4], full[1.0], strict=True))  # thresholds are nested


def test_mixing_of_no_rows_and_no_words(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], kind)).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_word_counts_of_slices():
    texts = pa.array(["a b", None, "", " x\ty\n", "é　é z", "w"])
    assert mixing.word_counts(texts).tolist() == [2, 0, 0, 2, 2, 1]
    assert mixing.word_counts(texts[2:5]).tolist() == [0, 2, 2] and mixing.word_counts(texts[:0]).tolist() == []


def test_kinds_of_credentials_are_bounded_by_a_parameter(spark):
    from quern.llm import secrets

    docs = spark.createDataFrame([(1, "some plain words here")], "doc_id long, text string")
    known = spark.createDataFrame([(f"k{i}", f"AB-{i:04d}-XY") for i in range(6)] + [(None, "left out")], "kind string, s string")
    assert secrets.train(docs, known, most_kinds=6)
    with pytest.raises(ValueError, match="kinds"):
        secrets.train(docs, known, most_kinds=5)
