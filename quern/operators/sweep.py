"""A sweep of settings over one scan: texts are read and their words placed once, all candidates are cut, searched and scored together.

Candidates are the base settings and those of a grid, each that cuts alike once, the base first, as many as the budget allows. A corpus
that is too small is declined before anything is read twice; a price from the threshold on needs confirmation before anything
is embedded. Points carry their candidate, and so do questions: one search answers every question for every candidate. The
winner is the best by gain over the base, or the base where the best gains too little.

Defined cases: a null text has one empty chunk; a question without gold counts in precision only; a question whose answers are none has
precision 0; settings whose overlap reaches their size are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import chunks, control, retrieval
from quern.operators.build import FAKE, Provider
from quern.session import batch_bytes, materialize, ship

#: Candidates at most, documents at least, and what may be spent without asking.
BUDGET, LEAST_DOCS, THRESHOLD, K, MARGIN = 12, 20, Decimal("1.00"), 10, 0.02
_CUT = "candidate int, doc_id long, chunk_index int, text string, token_count long"


@dataclass(frozen=True)
class Setting:
    """How texts are cut. Only code has a strategy of its own; others cut alike."""

    max_tokens: int
    overlap_tokens: int
    strategy: str = "recursive_char"
    language: str = "unknown"

    @property
    def effect(self) -> tuple:
        return (self.max_tokens, 0, self.language) if self.strategy == "code_syntax" else (self.max_tokens, self.overlap_tokens, None)


@dataclass
class Outcome:
    """declined (with a reason), needs_confirmation (with costs), or completed (with ranked)."""

    status: str
    settings: list[Setting]
    reason: str | None = None
    costs: DataFrame | None = None
    total: Decimal | None = None
    ranked: DataFrame | None = None


def settings(base: Setting, sizes: tuple[int, ...] = (256, 512, 1024), overlaps: tuple[int, ...] = (0, 64), strategies: tuple[str, ...] = ("recursive_char", "structure_aware", "code_syntax"), budget: int = BUDGET) -> list[Setting]:
    """The base and the grid in order, without settings that cut like an earlier one, at most ``budget``."""
    out: dict[tuple, Setting] = {base.effect: base}
    for s, n, o in product(strategies, sizes, overlaps):
        if o < n:
            out.setdefault((x := Setting(n, o, s, base.language)).effect, x)
    return list(out.values())[: max(1, budget)]


def cut(docs: DataFrame, tried: list[Setting]) -> DataFrame:
    """The chunks of every text (doc_id, text) under every setting; the places of a text's words are found once."""
    ship(docs.sparkSession)
    batch_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t or ""
                words, rows = chunks.Words(t), []
                for c, s in enumerate(tried):
                    spans = chunks.code_units(t, s.max_tokens, s.language) if s.strategy == "code_syntax" else chunks.windows(t, s.max_tokens, s.overlap_tokens, words)
                    rows += [(c, i, k, t[a:b], n) for k, (a, b, n) in enumerate(spans)]
                x = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(x, kinds, strict=True)], names=["candidate", "doc_id", "chunk_index", "text", "token_count"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _CUT)


def costs(made: DataFrame, provider: Provider = FAKE) -> DataFrame:
    """candidate, index_size, tokens and cost: one row for each setting."""
    by = made.groupBy("candidate").agg(F.count(F.lit(1)).alias("index_size"), F.sum("token_count").alias("tokens"))
    return by.withColumn("cost", provider.cost(F.col("tokens")))


def scores(made: DataFrame, questions: DataFrame, gold: DataFrame, tried: int, provider: Provider = FAKE, k: int = K) -> DataFrame:
    """candidate, recall and precision over all questions (question_id, text) with their documents (``gold``: question_id, doc_id).

    The questions are asked once for each candidate, in one search: a few dozen times their number.
    """
    key = F.xxhash64("candidate", "doc_id", "chunk_index")
    points = materialize(made.select(key.alias("point_id"), provider.embed(F.col("text")).alias("vec"), F.col("candidate").alias("tenant"), "doc_id"), "sweep-points")
    each = questions.select("question_id", "text", F.explode(F.sequence(F.lit(0), F.lit(tried - 1))).alias("tenant"))
    asked = materialize(each.select(F.xxhash64("question_id", "tenant").alias("query_id"), "question_id", provider.embed(F.col("text")).alias("qvec"), "tenant"), "sweep-questions")
    found = retrieval.topk(points.select("point_id", "vec", "tenant"), asked.select("query_id", "qvec", "tenant"), k, same="tenant")
    known = found.join(points.select("point_id", "doc_id"), "point_id").join(asked.select("query_id", "question_id"), "query_id")
    right = gold.select("question_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    by = known.join(right, ["question_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.countDistinct(F.when(F.col("hit") == 1, F.col("doc_id"))).alias("docs"))
    wanted = right.groupBy("question_id").agg(F.count(F.lit(1)).alias("wanted"))
    full = asked.select("query_id", "question_id", F.col("tenant").alias("candidate")).join(by, "query_id", "left").join(wanted, "question_id", "left")
    recall, precision = F.coalesce("docs", F.lit(0)) / F.col("wanted"), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))
    return full.groupBy("candidate").agg(F.round(F.coalesce(F.avg(recall), F.lit(0.0)), 6).alias("recall"), F.round(F.avg(precision), 6).alias("precision"))


def run(docs: DataFrame, questions: DataFrame, gold: DataFrame, tried: list[Setting], provider: Provider = FAKE, k: int = K, least_docs: int = LEAST_DOCS, threshold: Decimal = THRESHOLD, confirmed: bool = False, margin: float = MARGIN) -> Outcome:
    """Sweep ``tried`` (the base first). ``ranked``: candidate, recall, precision, gains, place, winner, index_size, tokens and cost."""
    n = docs.count()
    if n < least_docs:
        return Outcome("declined", tried[:1], f"{n} documents are fewer than {least_docs}: the base settings stay")
    made = materialize(cut(docs, tried), "sweep-chunks")
    spent = materialize(costs(made, provider), "sweep-costs")
    total = spent.agg(F.sum("cost")).first()[0]
    if total >= threshold and not confirmed:
        return Outcome("needs_confirmation", tried, costs=spent, total=total)
    ranked = control.sweep_rank(materialize(scores(made, questions, gold, len(tried), provider, k), "sweep-scores"), 0, margin)
    return Outcome("completed", tried, costs=spent, total=total, ranked=ranked.join(spent, "candidate"))
