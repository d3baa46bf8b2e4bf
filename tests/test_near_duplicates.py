"""Near duplicates with a hot shingle dealt in cells, against all pairs."""

from __future__ import annotations

import pyarrow as pa

import random
import re

import numpy as np

import pytest

from quern.functions import shingles
from quern.operators import dedup, serve


@pytest.fixture(scope="module")
def docs(spark):
    """Near copies of one text that share a passage, looser relatives, equal sets of shingles, short and empty texts."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(20, 60)] = word()
        rows.append(" ".join([*w, f"end{i}"]))
    rows += [" ".join([*base[: 30 + i % 25], *(word() for _ in range(25))]) for i in range(60)]
    rows += [" ".join(word() for _ in range(40)) for _ in range(60)]
    rows += ["A b c d e, f g h i j k l m n o p q r s t u v w x!", "a b c d e f g h i j k l m n o p q r s t u v w x", "", "short", rows[0], rows[0]]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)


def brute(sets, threshold):
    out = {}
    for x, a in sets.items():
        for y, b in sets.items():
            if x < y and a and b and len(a & b) >= threshold * len(a | b):
                out[x, y] = (len(a & b), len(a | b))
    return out


@pytest.mark.parametrize(("hot", "block", "threshold"), [(1000, 512, 0.5), (7, 16, 0.5), (50, 3, 0.8)])
def test_edges_equal_all_pairs(docs, monkeypatch, hot, block, threshold):
    monkeypatch.setattr(dedup, "HOT", hot)
    monkeypatch.setattr(dedup, "BLOCK", block)
    sets = {r["doc_id"]: set(r["s"]) for r in dedup.shingle_sets(dedup.primaries(docs).select("doc_id", "text")).collect()}
    want = brute(sets, threshold)
    rows = dedup.edges(docs, threshold).collect()
    assert {(r["doc_a"], r["doc_b"]): (r["common"], r["total"]) for r in rows} == want and len(rows) == len(want) > 1000


def test_a_hot_key_meets_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT", 20)
    rows = spark.createDataFrame([(i, 5, 300) for i in range(300)] + [(1000, 6, 2), (1001, 6, 2)], "doc_id long, key long, times long")
    found = dedup.meetings(rows, "key", "times", lambda a, b: dedup.F.lit(True))
    assert found.count() == 300 * 299 // 2 + 1
    parts = dedup.F.pmod(dedup.F.xxhash64("doc_id"), dedup.F.lit(15))
    assert max(r["count"] for r in rows.where("key = 5").groupBy(parts).count().collect()) < 45


def test_minhash_finds_nearly_all_and_nothing_else(docs, monkeypatch):
    monkeypatch.setattr(dedup, "HOT", 30)
    sets = dedup.shingle_sets(dedup.primaries(docs).select("doc_id", "text"))
    want = brute({r["doc_id"]: set(r["s"]) for r in sets.collect()}, 0.5)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in serve.minhash_neighbours(sets).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(abs(j - want[p][0] / want[p][1]) < 1e-6 for p, j in got.items())


def test_membership_has_a_row_for_each_document(docs):
    rows, links = dedup.members(docs)
    by: dict = {}
    for r in rows.collect():
        by.setdefault(r["label"], set()).add(r["node"])
    assert sum(map(len, by.values())) == rows.count() and all(min(m) == k for k, m in by.items())
    assert {r["doc_a"] for r in links.collect()} <= set().union(*by.values())


def test_shingles_of_the_same_documents_meet_once(spark):
    rows = [(h, d, 300, 300 - h) for h in range(100) for d in range(20)] + [(500, d, 300, 9) for d in range(5)] + [(600, 1, 300, 300)]
    first = dedup.first_of_equals(spark.createDataFrame(rows, "h long, doc_id long, n int, rest int")).collect()
    assert {(r["h"], r["times"]) for r in first} == {(0, 20), (500, 5)} and len(first) == 25


def test_pairs_that_agree_in_no_band_are_found_too(docs):
    sets = dedup.shingle_sets(dedup.primaries(docs).select("doc_id", "text"))
    want = brute({r["doc_id"]: set(r["s"]) for r in sets.collect()}, 0.5)
    rows = serve.minhash_neighbours(sets, 0.5, bands=1, rows=6).collect()
    assert {(r["doc_a"], r["doc_b"]) for r in rows} == set(want) and len(rows) == len(want)


def test_shingles_move_packed(spark):
    """A batch's shingles move as one row for each part, and come out as they went in."""
    sets = [(i, [1, 2**62 + i, -i - 3]) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets]), pa.array([3] * 500, pa.int32()), pa.array([s for _, s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "s"])
    packed = list(dedup._dealt(iter([batch, batch.slice(0, 0)]), 7))
    assert sum(b.num_rows for b in packed) == 7
    h, d, n = dedup._held(iter(packed))
    assert sorted(zip(h.tolist(), d.tolist(), strict=True)) == sorted((x, i) for i, s in sets for x in s) and set(n.tolist()) == {3}
    # Only the shingle that all have goes on to the documents.
    more = dedup._held(dedup._shared(iter(packed), 3))
    assert set(more[0].tolist()) == {1} and sorted(more[1].tolist()) == list(range(500)) and set(more[3].tolist()) == {500}
    assert dedup.candidates(spark.createDataFrame([], "doc_id long, n int, s array<long>"), 0.5).count() == 0


def test_sets_equal_plain_shingles(monkeypatch):
    texts = ["one two three four five six", "a b c d", "", None, "x1 " * 40, "é a ß b c\td\n\ne-f g", "same same same same same same", "ab cd ef gh ij", "abc d ef gh ij", " ".join(f"t{i}" for i in range(3000))]
    plain = [w and {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ([] if t is None else re.findall("[a-z0-9]+", t) for t in texts)]
    for block in (16, 1 << 20):
        monkeypatch.setattr(shingles, "BLOCK", block)
        assert [x for ab in shingles.slices(pa.array(texts)) for x in range(*ab)] == list(range(len(texts)))
        flat, at = shingles.flat_sets(pa.array(["cut off", *texts])[1:], 5)
        got = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert [len(g) for g in got] == [len(p or ()) for p in plain] and all(g == sorted(set(g)) for g in got)
    # Equal runs have equal hashes, whatever text they stand in, and different ones do not.
    assert len({h for g in got for h in g}) == len({r for p in plain for r in p or ()})


def test_larger_tables_move_a_third_of_their_shingles_at_a_time(docs, monkeypatch):
    want = sorted(map(tuple, dedup.edges(docs).collect()))
    written, real = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: (written.append((name, out := real(df, name))), out)[1])
    monkeypatch.setattr(dedup, "LARGE", 0)
    monkeypatch.setattr(dedup, "ROWS", 500)
    assert sorted(map(tuple, dedup.edges(docs).collect())) == want and len(want) > 1000
    names = [n for n, _ in written]
    assert names.count("shared-shingles") == dedup.ROUNDS
    # Sets of shingles, which are larger than the texts, are not written.
    assert not any("array" in t for _, df in written for _, t in df.dtypes)
    sets = [(i, [3 * i + k for k in range(9)]) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets]), pa.array([9] * 400, pa.int32()), pa.array([s for _, s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "s"])
    turns = [list(dedup._dealt(iter([batch]), 12, t, 3)) for t in range(3)]
    parts = [{p for b in t for p in b.column(0).to_pylist()} for t in turns]
    assert all(p % 3 == t for t in range(3) for p in parts[t]) and sum(len(dedup._held(iter(t))[0]) for t in turns) == 3600


def test_near_copies_share_blocks(spark, monkeypatch):
    """A document goes to a few cells of its own family, not to one for each partner."""
    monkeypatch.setattr(dedup, "BLOCK", 10)
    pairs = spark.createDataFrame([(f * 1000 + i, f * 1000 + j) for f in range(30) for i in range(20) for j in range(i + 1, 20)], "doc_a long, doc_b long")
    block = {r["doc_id"]: r["block"] for r in dedup._blocks_of_pairs(pairs).collect()}
    assert len(block) == 600 and len(set(block.values())) <= 60
    assert all(len({block[f * 1000 + i] for i in range(20)}) <= 2 for f in range(30))


def test_minhash_writes_no_sets(docs, monkeypatch):
    sets = dedup.shingle_sets(dedup.primaries(docs).select("doc_id", "text"))
    written = []
    for module in (serve, dedup):
        monkeypatch.setattr(module, "materialize", lambda df, name, real=module.materialize: (written.append((name, out := real(df, name))), out)[1])
    got = {(r["doc_a"], r["doc_b"]) for r in serve.minhash_neighbours(sets).collect()}
    assert got == set(brute({r["doc_id"]: set(r["s"]) for r in sets.collect()}, 0.5))
    kinds = dict(written)["minhash-marks"].dtypes
    assert kinds == [("doc_id", "bigint"), ("n", "int"), ("key", "bigint")] and not any("array" in t for _, df in written for _, t in df.dtypes)
    # Minimum hashes alone find nearly all.
    monkeypatch.setattr(dedup, "candidates", lambda live, *_: live.limit(0).selectExpr("doc_id AS doc_a", "doc_id AS doc_b"))
    assert len({(r["doc_a"], r["doc_b"]) for r in serve.minhash_neighbours(sets).collect()}) >= 0.99 * len(got)


def test_sketches_refuse_no_pair_that_reaches_the_threshold(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(-(1 << 63), 1 << 63, n))
    sets, pairs = {}, []
    for i in range(300):
        a = draw(int(rng.integers(1, 300)))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], draw(int(rng.integers(1, 1 + len(a))))])
        sets |= {2 * i: a, 2 * i + 1: b}
        pairs += [(2 * i, 2 * i + 1)] + [(2 * i - 1, 2 * i)] * (i > 0)
        both, apart = len(np.intersect1d(a, b)), dedup._apart(dedup._sketch(a), dedup._sketch(b))
        assert apart <= len(a) + len(b) - 2 * both
    reach = {(a, b) for a, b in pairs if 2 * (k := len(np.intersect1d(sets[a], sets[b]))) >= len(sets[a]) + len(sets[b]) - k}
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "doc_id long, s array<long>")
    left = {(r["doc_a"], r["doc_b"]) for r in dedup.sieved(dedup.materialize(spark.createDataFrame(pairs, "doc_a long, doc_b long"), "pairs"), frame, 0.5).collect()}
    assert reach <= left and len(reach) > 30 and len(left) < 2 * len(reach)
