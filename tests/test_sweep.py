"""One scan for all settings against a run for each, and the gates before it."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.operators import build, chunks, control, retrieval, sweep

TRIED = [sweep.Setting(30, 0), sweep.Setting(12, 4), sweep.Setting(12, 0, "code_syntax", "python"), sweep.Setting(50, 10)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("one two three four five six. seven, eight\n\nnine def f(): class".split(" ")) for _ in range(rng.randrange(5, 120))) for _ in range(40)] + ["def a():\n    pass\ndef b():\n    pass\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = chunks.chunk(docs.where("doc_id < 30"), 12, 4).where("chunk_index < 2").collect()
    questions = spark.createDataFrame([(n, r["text"]) for n, r in enumerate(pieces)] + [(900, "nowhere at all")], "question_id long, text string")
    gold = spark.createDataFrame([(n, r["doc_id"]) for n, r in enumerate(pieces)] + [(0, 39)], "question_id long, doc_id long")
    return docs, questions, gold


def alone(docs, questions, gold, s, k):
    """A run of one setting by itself."""
    made = chunks.chunk(docs, s.max_tokens, s.overlap_tokens, s.strategy, s.language)
    points = made.select(F.xxhash64(F.lit(TRIED.index(s)), "doc_id", "chunk_index").alias("point_id"), chunks.digest_vector(F.coalesce("text", F.lit(""))).alias("vec"), "doc_id")
    asked = questions.select(F.col("question_id").alias("query_id"), chunks.digest_vector(F.col("text")).alias("qvec"))
    of = {r["point_id"]: r["doc_id"] for r in points.collect()}
    got: dict = {}
    for r in retrieval.topk(points, asked, k).collect():
        got.setdefault(r["query_id"], []).append(of[r["point_id"]])
    want: dict = {}
    for r in gold.collect():
        want.setdefault(r["question_id"], set()).add(r["doc_id"])
    asks = [r["question_id"] for r in questions.collect()]
    recall = [len(set(got[q]) & want[q]) / len(want[q]) for q in asks if q in want]
    precision = [sum(d in want.get(q, ()) for d in got[q]) / len(got[q]) for q in asks]
    return round(sum(recall) / len(recall), 6), round(sum(precision) / len(precision), 6), made.count(), made.agg(F.sum("token_count")).first()[0]


def test_one_scan_equals_separate_runs(spark, corpus):
    got = sweep.run(*corpus, TRIED, k=4)
    assert got.status == "completed" and got.total == 0
    rows = {r["candidate"]: r for r in got.ranked.collect()}
    want = [alone(*corpus, s, 4) for s in TRIED]
    for c, (recall, precision, size, tokens) in enumerate(want):
        assert (rows[c]["index_size"], rows[c]["tokens"]) == (size, tokens)
        assert rows[c]["recall"] == pytest.approx(recall, abs=2e-6) and rows[c]["precision"] == pytest.approx(precision, abs=2e-6)
    table = spark.createDataFrame([(c, float(rows[c]["recall"]), float(rows[c]["precision"])) for c in rows], "candidate int, recall double, precision double")
    assert {r["candidate"]: (r["place"], r["winner"]) for r in control.sweep_rank(table, 0).collect()} == {c: (r["place"], r["winner"]) for c, r in rows.items()}
    assert rows[1]["winner"] and rows[1]["place"] == 1  # the questions are its own chunks
    cut = sweep.cut(corpus[0], TRIED)
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_gates(corpus):
    few = sweep.run(*corpus, TRIED, least_docs=1000)
    assert few.status == "declined" and few.settings == TRIED[:1] and few.ranked is None and "1000" in few.reason
    dear = build.Provider("dear", 64, chunks.digest_vector, "0.01", local=False)
    asks = sweep.run(*corpus, TRIED, provider=dear)
    assert asks.status == "needs_confirmation" and asks.total >= Decimal("1") and asks.ranked is None
    assert asks.total == sum(r["cost"] for r in asks.costs.collect()) and asks.costs.count() == 4
    assert sweep.run(*corpus, TRIED, provider=dear, confirmed=True, k=2).status == "completed"


def test_settings_are_distinct_and_bounded():
    base = sweep.Setting(512, 64)
    got = sweep.settings(base, budget=100)
    assert got[0] == base and len(got) == len({s.effect for s in got}) == 3 * 2 + 3
    assert sweep.settings(base, budget=4) == got[:4] and sweep.settings(base, budget=0) == [base]
    assert sweep.settings(base, sizes=(64,), overlaps=(64, 128), strategies=("semantic",)) == [base]
