"""Registered queries against their SQL, and the pipeline against its parts, on the smallest tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quern.llm import catalog, jaccard, packing, quality, rules, secrets
from quern.llm.tokens import ChunkEncoder, public_path
from quern.session import materialize

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), c.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted(f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None), key=repr)
    assert [tuple(map(str, r)) for r in plain(got)] == [tuple(map(str, r)) for r in plain(want)] or [tuple(map(float, r)) for r in plain(got)] == [tuple(map(float, r)) for r in plain(want)]


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = materialize(corpus_pipeline.quality_rules(spark, docs, DATA), "t")
    assert kept.columns == docs.columns
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0] for r in c.sql(f"SELECT doc_id FROM ({rules.SQL}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == want

    good = materialize(corpus_pipeline.quality_classifier(spark, kept, DATA), "t")
    net = quality.train(kept, spark.read.parquet(f"{DATA}/labels.parquet"))
    ids = sorted(want)
    scores = net.scores([(rows[i]["text"] or "").encode() for i in ids])
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in zip(ids, scores, strict=True) if s >= quality.KEEP_FROM}

    single = materialize(corpus_pipeline.ngram_jaccard(spark, good, DATA), "t")
    sets = {r["doc_id"]: jaccard.exact(r["text"]) for r in good.collect()}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in single.collect()} == {i for i in up if up[i] == i}

    clean = materialize(corpus_pipeline.secret_scan(spark, single, DATA), "t")
    model = secrets.train(single)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == texts[r["doc_id"]]) == (not model.spans(texts[r["doc_id"]]))
        assert not secrets.base_spans(r["text"])

    pieces = corpus_pipeline.pack(spark, clean, DATA).toPandas()
    with open(public_path("word_bpe_49k.json"), "rb") as f:
        enc = ChunkEncoder(f.read())
    for r in clean.collect():
        ids = np.frombuffer(enc.encode([r["text"]])[0], enc.dtype).tolist() + [2]
        own = pieces[pieces["doc_id"] == r["doc_id"]].sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW


def test_pipeline_runs_and_takes_empty_tables(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, DATA), "t")
        assert none.count() == 0


def test_pipeline_keeps_odd_rows(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, clean, "en", None, None), (1, clean, "en", None, None), (None, clean, None, "a", 5), (None, clean, None, "a", 5), (2, None, "en", "a", 0)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.ngram_jaccard):
        docs = materialize(stage(spark, docs, DATA), "t")
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 0, 1]
    assert docs.columns == list(corpus_pipeline.COLUMNS)
