"""Near-duplicate families that are kept up to date: new texts probe what is stored, only touched families change.

A text is known by its content hash. Stored are its set of shingles, the postings of its prefix, the edges found and its
family's label, in one ``BucketStore``, so a batch is there whole or not at all. Prefixes follow the order of the
shingles' hashes, but the most frequent shingles of the first batch, which are stored too, come last: a line that a tenth of
all texts have would else bring each two of them together. No later text changes that order; so postings are only ever added to. A batch reads the buckets of
postings that its own prefixes fall into, compares sets of candidate pairs, and joins families: each family that
a new edge touches is one node of a small graph, and only members of families whose label falls are written anew.

After any batches the families are those of one run over all texts.

Defined cases: of equal texts the smallest doc_id counts, whenever it comes; a text below the least number of characters, or of
fewer than five tokens, is in no family; a null text is none; a batch that is added again changes nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids
from quern.operators import dedup
from quern.session import batch_bytes, discard, materialize, ship, tidy
from quern.sources.buckets import BucketStore
from quern.sources.store import ArtifactError

#: An empty table that names how shingles are hashed: sets of another kind would meet none of these.
HASHES = "hashes-2"
#: Passes over the buckets of postings in which those of larger tables meet.
ROUNDS = 4
#: Frequent shingles that stand last in prefixes, at most, and the share of documents (one in so many) that tells them.
COMMON, SHARE = 65_536, 8


def common(sets: DataFrame) -> list[int]:
    """Shingles that very many sets (id, s) have, rarest first: they stand last in the order of prefixes.

    Every order gives the same pairs, so frequencies come from one document in ``SHARE``, and no more than ``COMMON`` shingles are kept.
    """
    seen = sets.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0).select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return [r["h"] for r in seen.where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()][::-1]


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set in order of hashes, those of ``last`` after all others, and how many are still to follow."""
    turn = np.argsort(last)
    known = last[turn]
    for batch in batches:
        sets = batch.column(1)
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        ids, own, n, rest = [], [np.empty(0, np.int64)], [], [np.empty(0, np.int32)]
        for i, a, b in zip(range(batch.num_rows), at[:-1], at[1:], strict=True):
            s = np.sort(flat[a:b])
            k = len(s) - int(np.ceil(threshold * len(s))) + 1 if len(s) else 0
            place = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
            hot = known[place] == s if len(known) else np.zeros(len(s), bool)
            s = np.concatenate([s[~hot], last[np.sort(turn[place[hot]])]])[:k]
            ids.append(np.full(len(s), i))
            own.append(s)
            n.append(np.full(len(s), b - a, np.int32))
            rest.append((b - a - np.arange(len(s))).astype(np.int32))
        taken = batch.column(0).take(pa.array(np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), taken, pa.array(np.concatenate([np.empty(0, np.int32), *n])), pa.array(np.concatenate(rest))], names=["h", "id", "n", "rest"])


def prefixes(sets: DataFrame, threshold: float, last: list[int]) -> DataFrame:
    """h, id, n and rest of the n - ceil(t n) + 1 first shingles of every set: two sets that reach the threshold share one of theirs."""
    ship(sets.sparkSession)
    batch_bytes(sets.sparkSession)
    late = np.array(last, np.int64)
    return sets.select("id", "s").mapInArrow(tidy(lambda b: _prefixes(b, threshold, late)), "h long, id long, n int, rest int")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's postings (h, id, n, rest, fresh) those of shingles that several sets have, a fresh one among them."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        h, fresh = table.column(0).to_numpy(), table.column(4).to_numpy()
        order = np.argsort(h)
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        times = np.diff(np.r_[first, len(h)])
        keep = np.sort(order[np.repeat((times > 1) & np.logical_or.reduceat(fresh[order], first), times)])
        yield from table.take(pa.array(keep)).rename_columns(["h", "doc_id", "n", "rest", "fresh"]).to_batches(100_000)


class Families:
    """Families below ``root``."""

    def __init__(self, spark: SparkSession, root: str, threshold: float = dedup.THRESHOLD, min_chars: int = dedup.MIN_CHARS, buckets: int = 32):
        self.store, self.threshold, self.min_chars = BucketStore(spark, root), threshold, min_chars
        if not self.store.current():
            none = lambda schema: spark.createDataFrame([], schema)
            change = self.store.begin()
            change.create("texts", none("node string, doc_id long, before long"), "node", "before", buckets=buckets)
            change.create("sets", none("id long, n int, s array<long>, node string"), "id", "n", buckets=buckets)
            change.create("postings", none("h long, id long, n int, rest int"), "h", "id", buckets=buckets)
            change.create("edges", none("a long, b long, jaccard double"), "a", "b", buckets=buckets)
            change.create("members", none("id long, label long, batch long"), "id", "batch", buckets=buckets)
            change.create(HASHES, none("h long"), "h", "h", buckets=1)
            change.commit()
        elif HASHES not in self.store.state():
            raise ArtifactError(f"the families below {root} were built with other hashes of shingles, and have to be built again")

    def add(self, docs: DataFrame) -> int:
        """Take in documents (doc_id, text); how many families changed their label."""
        change = self.store.begin()
        hashed = docs.where("text IS NOT NULL").select("doc_id", "text", ids.content_hash(F.col("text")).alias("node"))
        # The smallest id of a text, whether it is new or known: the version falls with the id, so that the smallest stays.
        own = materialize(hashed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")), "families-texts")
        known = self.store.read("texts").select("node")
        fresh = own.join(known, "node", "left_anti")
        change.upsert("texts", own.select("node", "doc_id", (-F.col("doc_id")).alias("before")))
        sized = dedup.shingle_sets(fresh.select(F.col("node").alias("doc_id"), "text"), self.min_chars).where("n > 0")
        # Sets are compared under numbers: the first 15 digits of the content hash. What is stored is read again, instead of a second copy.
        first = not change.tables["sets"].files
        change.append("sets", sized.select(F.conv(F.substring("doc_id", 1, 15), 16, 10).cast("long").alias("id"), "n", "s", F.col("doc_id").alias("node")))
        discard(own)
        sets = self.store.rows(change.added("sets"))
        change.append("postings", prefixes(sets, self.threshold, self._last(change, sets, first)))
        links = materialize(self._links(change, sets), "families-links")
        change.append("edges", links)

        labels = self.store.read("members").select("id", "label")
        # Families as nodes: of an edge's ends, a known one stands for its label, a new one for itself.
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        ends = materialize(ends, "families-ends")
        of = lambda c: ends.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        graph = links.join(of("a"), "a").join(of("b"), "b").select("la", "lb")
        moved = materialize(dedup.components(graph, "la", "lb").where("node <> label").select(F.col("node").alias("old"), F.col("label").alias("new")), "families-moved")
        last = self.store.read("members").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] + 1
        fall = labels.join(moved, F.col("label") == F.col("old")).select("id", F.col("new").alias("label"))
        come = ends.join(labels.select("id"), "id", "left_anti").join(moved, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
        change.upsert("members", fall.unionByName(come).select("id", "label", F.lit(last).cast("long").alias("batch")))
        change.commit()
        n = moved.count()
        discard(links, ends, moved)
        return n

    def _last(self, change, sets: DataFrame, first: bool) -> list[int]:
        """The stored frequent shingles, rarest first; of a store with texts but without such a table none."""
        if "common" in change.tables:
            return [r["h"] for r in self.store.read("common").orderBy("turn").collect()]
        if not first or not sets.limit(1).count():
            return []
        last = common(sets)
        change.create("common", self.store.spark.createDataFrame(list(zip(last, range(len(last)), strict=True)), "h long, turn long"), "h", "turn", buckets=1)
        return last

    def _links(self, change, sets: DataFrame) -> DataFrame:
        """Edges of the change's sets. Postings meet where they are stored, of larger tables some buckets at a time."""
        t, new, old = self.threshold, change.added("postings"), self.store.state()["postings"]
        total = sum(s.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for s in (sets, self.store.read("sets")))
        rounds, parts = (min(ROUNDS, new.buckets), -(-total // dedup.ROWS)) if total > dedup.LARGE else (1, 8)
        met = []
        for turn in range(rounds):
            only = [int(b) for b in new.files if int(b) % rounds == turn]
            rows = lambda layout, fresh: self.store.rows(layout, only).select("h", "id", "n", "rest", F.lit(fresh).alias("fresh"))  # noqa: B023, E731
            if only or not turn:
                every = rows(new, True).unionByName(rows(old, False)).repartition(parts, "h")
                met.append(materialize(every.mapInArrow(tidy(lambda b: (yield from _meeting(b))), "h long, doc_id long, n int, rest int, fresh boolean"), "families-meeting"))
        rows = dedup.first_of_equals(functools.reduce(DataFrame.unionByName, met))
        discard(*met)

        def may(a: str, b: str):
            na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
            size = (F.least(na, nb) >= t * F.greatest(na, nb)) & (F.least(f"{a}.rest", f"{b}.rest") * (1 + t) >= t * (na + nb) - 1e-6)
            return (F.col(f"{a}.fresh") | F.col(f"{b}.fresh")) & size

        pairs = materialize(dedup.meetings(rows, "h", "times", may), "families-pairs")
        both = sets.select(F.col("id").alias("doc_id"), "s").unionByName(self.store.read("sets").select(F.col("id").alias("doc_id"), "s"))
        of = lambda p: both.join(dedup.few(dedup.of_pairs(p)), "doc_id", "left_semi")
        near = materialize(dedup.sieved(pairs, of(pairs), t), "families-near")
        found = materialize(dedup.verified(near, of(near), t), "families-found")
        discard(rows, pairs, near)
        return found.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "jaccard")

    def read(self) -> DataFrame:
        """doc_id and label (the family's smallest doc_id) of every text in a family."""
        named = self.store.read("members").join(self.store.read("sets").select("id", "node"), "id").join(self.store.read("texts").select("node", "doc_id"), "node")
        first = named.groupBy("label").agg(F.min("doc_id").alias("first"))
        return named.join(first, "label").select("doc_id", F.col("first").alias("label"))
