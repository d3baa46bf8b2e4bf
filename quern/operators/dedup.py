"""Exact and near duplicates, families, roles and corpus-wide boilerplate."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids, shingles, text
from quern.session import batch_bytes, discard, materialize, ship, tidy

#: Rows of one partition where these are held together.
ROWS = 1_000_000
#: Rows of one key that meet in one cell, of each side; documents of one block when pairs are compared.
HOT, BLOCK = 1000, 512
#: Passes in which the shingles of larger tables are dealt, and shingles from which a table is one.
ROUNDS, LARGE = 3, 4_000_000
#: Ids of a written table that is broadcast; beyond, a join moves what they are looked up for.
BROADCAST_IDS = 1_000_000
#: Buckets that blocks are counted in first: far more than a text's blocks times twenty. Characters of known blocks that tasks are given.
BUCKETS, KNOWN_CHARS = 1 << 16, 16 << 20
PARAGRAPHS = re.compile(r"\n\s*\n+", re.ASCII)
#: Tokens of a shingle, and characters of a text for each, about.
SHINGLE, CHARS = 5, 6
THRESHOLD = 0.5
MIN_CHARS = 50


def inventory(docs: DataFrame) -> DataFrame:
    """Content hash, content-addressed id and size of every document."""
    h = ids.content_hash(F.col("text"))
    return docs.select("doc_id", h.alias("content_hash"), ids.document_id(h).alias("document_id"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("text/plain").alias("media_type"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: members combine before they move; the smallest doc_id is primary."""
    h = ids.content_hash(F.col("text")).alias("content_hash")
    by = docs.select("doc_id", h).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_members"), F.min("doc_id").alias("primary_doc"))
    return by.where("n_members > 1").select(ids.group_id(F.col("content_hash")).alias("group_id"), "content_hash", "n_members", "primary_doc")


def few(rows: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast while they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def primaries(docs: DataFrame) -> DataFrame:
    """Rows of distinct texts: of equal ones the smallest doc_id stays.

    Only ids and hashes are grouped; the texts meet the ids that go, which are broadcast while they are few.
    """
    hashed = docs.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = materialize(hashed.join(groups, "content_hash").where("doc_id <> first_doc").select("doc_id"), "repeated-texts")
    return docs.select("doc_id", "text").join(few(gone), "doc_id", "left_anti").withColumn("content_hash", ids.content_hash(F.col("text")))


def shingle_counts(docs: DataFrame) -> DataFrame:
    tokens = text.ascii_tokens(F.col("text"))
    return docs.select("doc_id", tokens.alias("tokens")).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(text.shingles(F.col("tokens"), SHINGLE)).alias("n_shingles"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets (id, n, s) of lower-cased texts (id, text)."""
    for batch in batches:
        for a, b in shingles.slices(batch.column(1)):
            flat, bounds = shingles.flat_sets(batch.column(1)[a:b], SHINGLE)
            s = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(bounds).astype(np.int32)), s], names=["doc_id", "n", "s"])


def shingle_sets(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n and the hashed shingle set of documents of enough characters (empty below five tokens). Not written: whoever reads them again has them made again."""
    ship(docs.sparkSession)
    batch_bytes(docs.sparkSession)
    lowered = docs.where(F.length("text") >= min_chars).select("doc_id", F.lower("text").alias("text"))
    return lowered.mapInArrow(tidy(_sets), f"doc_id {lowered.schema['doc_id'].dataType.simpleString()}, n int, s array<long>")


def meetings(rows: DataFrame, key: str, n: str, more: Callable[[str, str], Column]) -> DataFrame:
    """Pairs doc_a < doc_b of rows that share a key, where ``more`` of both aliases holds; each pair once.

    ``n`` is a column with at least the number of rows of the key: a hot key's rows are dealt into parts of about
    ``HOT``, and each pair of parts is a cell of its own, so no task sees more than two parts of a key.
    """
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / HOT))
    own, every = F.pmod(F.xxhash64("doc_id"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    a = rows.withColumn("i", own).withColumn("j", every).alias("a")
    b = rows.withColumn("j", own).withColumn("i", every).alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    return a.join(b, same & more("a", "b")).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).distinct()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersections and unions of pairs; a cell's sets come before its pairs, each once, and go when the next cell begins."""
    cell, held = None, {}
    for batch in batches:
        x, y, a, b = (batch.column(i).to_pylist() for i in range(4))
        at, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
        rows = []
        for i, now in enumerate(zip(x, y, strict=True)):
            if now != cell:
                cell, held = now, {}
            if b[i] is None:
                held[a[i]] = flat[at[i] : at[i + 1]]
                continue
            u, v = held[a[i]], held[b[i]]
            both = len(np.intersect1d(u, v, assume_unique=True))
            rows.append((a[i], b[i], both, len(u) + len(v) - both))
        c = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c], names=["doc_a", "doc_b", "common", "total"])


def of_pairs(pairs: DataFrame) -> DataFrame:
    """doc_id of all that are in a written table of pairs."""
    return materialize(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "compared-ids")


def _blocks_of_pairs(pairs: DataFrame) -> DataFrame:
    """doc_id and block of all documents in pairs. Those with one least partner share a block, or several of about ``BLOCK``: near copies lie together."""
    ends = pairs.select(F.col("doc_a").alias("doc_id"), F.col("doc_b").alias("other")).unionByName(pairs.select(F.col("doc_b").alias("doc_id"), F.col("doc_a").alias("other")))
    label = materialize(ends.groupBy("doc_id").agg(F.least(F.min("other"), F.col("doc_id")).alias("label")), "pair-labels")
    parts = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return label.join(parts, "label").select("doc_id", F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("block"))


def _in_cells(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (x, y, doc_a, doc_b, s) of pairs and of what is compared for them, in sorted partitions.

    Documents are dealt into blocks; a pair of blocks that has candidates is a cell, which gets one copy of each of
    its sets, however many pairs it is in. Cells follow each other in sorted partitions, so a cell of one pair costs no call of its own.
    """
    block = materialize(_blocks_of_pairs(pairs), "pair-blocks")
    of = lambda c, x: block.select(F.col("doc_id").alias(c), F.col("block").alias(x))
    dealt = materialize(pairs.join(of("doc_a", "x"), "doc_a").join(of("doc_b", "y"), "doc_b").select("x", "y", "doc_a", "doc_b"), "dealt-pairs")
    needed = dealt.select("x", "y", F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct().join(sets.select("doc_id", "s"), "doc_id")
    none = F.lit(None).cast
    rows = needed.select("x", "y", F.col("doc_id").alias("doc_a"), none("long").alias("doc_b"), "s").unionByName(dealt.select("x", "y", "doc_a", "doc_b", none("array<long>").alias("s")))
    return rows.repartition("x", "y").sortWithinPartitions("x", "y", "doc_b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """doc_a, doc_b, common, total and jaccard of the pairs that reach the threshold; ``sets`` of other documents may be left out."""
    spark = sets.sparkSession
    ship(spark)
    batch_bytes(spark)
    scored = _in_cells(materialize(pairs, "candidate-pairs"), sets).mapInArrow(_common, "doc_a long, doc_b long, common long, total long")
    return scored.where(F.col("common") >= F.lit(threshold) * F.col("total")).withColumn("jaccard", F.round(F.col("common") / F.col("total"), 6))


def _sketch(s: np.ndarray) -> np.ndarray:
    """A set's size, and whether each of four to eight times as many buckets has an odd number of its hashes, as 64-bit words."""
    m = 1 << max(6, len(s).bit_length() + 2)
    odd = np.bincount(s & np.int64(m - 1), minlength=m).astype(np.uint8) & 1
    return np.r_[np.int64(len(s)), np.packbits(odd).view(np.int64)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
        own = [_sketch(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        bounds = np.cumsum([0, *map(len, own)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int64), *own])))], names=["doc_id", "s"])


def _apart(u: np.ndarray, v: np.ndarray) -> int:
    """Buckets in which two sketches differ: sets differ in no fewer hashes."""
    u, v = u[1:], v[1:]
    while len(u) != len(v):
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count((u ^ v).view(np.uint64)).sum())  # of signed words it would count those of their absolute values


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow the threshold; rows as for ``_common``."""
    cell, held = None, {}
    for batch in batches:
        x, y, a, b = (batch.column(i).to_pylist() for i in range(4))
        at, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
        rows = []
        for i, now in enumerate(zip(x, y, strict=True)):
            if now != cell:
                cell, held = now, {}
            if b[i] is None:
                held[a[i]] = flat[at[i] : at[i + 1]]
                continue
            u, v = held[a[i]], held[b[i]]
            if _apart(u, v) * (1 + threshold) <= (1 - threshold) * int(u[0] + v[0]) + 1e-6:
                rows.append((a[i], b[i]))
        c = list(zip(*rows, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c], names=["doc_a", "doc_b"])


def sieved(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Written pairs without such as cannot reach the threshold, which an eighth to a sixteenth of what their sets hold tells; none that can is lost."""
    ship(sets.sparkSession)
    batch_bytes(sets.sparkSession)
    sketches = sets.select("doc_id", "s").mapInArrow(tidy(_sketches), "doc_id long, s array<long>")
    return _in_cells(pairs, sketches).mapInArrow(tidy(lambda b: (yield from _near(b, threshold))), "doc_a long, doc_b long")


def edges(docs: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs of distinct texts with Jaccard >= threshold, by exact prefix and position filters. Sets are compared by 64-bit hashes of shingles.

    Texts are read again instead of their sets being written, which are larger; only documents in a pair are compared.
    """
    texts = primaries(docs).select("doc_id", "text")
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // CHARS
    pairs = materialize(candidates(shingle_sets(texts, min_chars), threshold, total), "candidate-pairs")
    return verified(pairs, shingle_sets(texts.join(few(of_pairs(pairs)), "doc_id", "left_semi"), min_chars), threshold)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (shingles.mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _packed(parts: int, key: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Columns of numbers as one row for each part of their keys: what moves are a few long rows, not one for each shingle."""
    part = _part(key, parts)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows = [pa.array([x.tobytes() for x in np.split(c[order], at[1:])] if len(order) else [], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(part[order][at]), *rows], names=["part", *NUMBERS[: len(columns)]])


#: Columns that move packed, and their kinds.
NUMBERS, KINDS = ("h", "doc_id", "n", "df"), (np.int64, np.int64, np.int32, np.int64)


def _packed_schema(columns: int) -> str:
    return "part int, " + ", ".join(f"{c} binary" for c in NUMBERS[:columns])


def _held(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of a partition's packed rows."""
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in held for x in b.column(i + 1)]) for i, kind in zip(range(held[0].num_columns - 1), KINDS, strict=False)] if held else []


def _batches(names: list[str], columns: list[np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keep), 100_000):
        k = keep[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in columns], names=names)


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, turn: int = 0, rounds: int = 1) -> Iterator[pa.RecordBatch]:
    """Sets (doc_id, n, s) as packed shingles (h, doc_id, n); one part in ``rounds``, from ``turn`` on."""
    for batch in batches:
        if batch.num_rows:
            n, flat = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()
            own, of = flat, np.repeat(np.arange(len(n)), n)
            if rounds > 1:
                keep = np.flatnonzero(_part(flat, parts) % rounds == turn)
                own, of = flat[keep], of[keep]
            yield from _packed(parts, own, [own, batch.column(0).to_numpy()[of], n[of]])


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed (h, doc_id, n) with the number of documents of their shingle (df), where that is more than one; what is held is one partition of about ``ROWS``."""
    if columns := _held(batches):
        order = np.argsort(columns[0])
        h, d, n = (x[order] for x in columns)
        times = np.diff(np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]))
        df = np.repeat(times, times)
        more = np.flatnonzero(df > 1)
        yield from _packed(parts, d[more], [h[more], d[more], n[more], df[more]])


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """What is left of each document's prefix after the shingles that no other has, rarest first, and how many of its shingles are still to follow."""
    if columns := _held(batches):
        h, d, n, df = columns
        order = np.lexsort((h, df, d))
        h, d, n, df = (x[order] for x in (h, d, n.astype(np.int64), df))
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        size = np.diff(np.r_[starts, len(d)])
        at, alone = np.arange(len(d)) - np.repeat(starts, size), n - np.repeat(size, size)
        keep = np.flatnonzero(at < n - np.ceil(threshold * n).astype(np.int64) + 1 - alone)
        yield from _batches(["h", "doc_id", "n", "rest"], [h, d, n.astype(np.int32), (n - alone - at).astype(np.int32)], keep)


def candidates(sets: DataFrame, threshold: float, total: int | None = None) -> DataFrame:
    """doc_a < doc_b of every pair of sets (doc_id, n, s) whose Jaccard may reach the threshold. ``total``: shingles of all sets, about; counted where it is not known.

    Shingles stand in order of how many documents have them. A document whose prefix (its rarest n - ceil(t n) + 1
    shingles) lies in no other has no partner. Others send the rest of their prefix to the join; a pair meets where the
    sizes, and what can still follow the place at which both have a shingle, allow the threshold. Shingles move once,
    packed by where they meet, to be counted there, and only those that more than one document has move on to their documents.
    Of larger tables a third of the shingles moves at a time, so that no more lies on disk; the sets are read once for each.
    """
    ship(sets.sparkSession)
    total = total or sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts, rounds = max(1, -(-total // ROWS)), ROUNDS if total > LARGE else 1
    batch_bytes(sets.sparkSession)
    named, turns = sets.select(F.col("doc_id").cast("long"), "n", "s"), []
    for turn in range(rounds):
        dealt = named.mapInArrow(tidy(lambda b, turn=turn: (yield from _dealt(b, parts, turn, rounds))), _packed_schema(3))
        turns.append(materialize(dealt.repartition(parts, "part").mapInArrow(tidy(lambda b: (yield from _shared(b, parts))), _packed_schema(4)), "shared-shingles"))
    rows = functools.reduce(DataFrame.unionByName, turns)
    asked = materialize(rows.repartition(parts, "part").mapInArrow(tidy(lambda b: (yield from _prefixes(b, threshold))), "h long, doc_id long, n int, rest int"), "prefixes")
    discard(*turns)

    def may(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        return (F.least(na, nb) >= threshold * F.greatest(na, nb)) & (F.least(f"{a}.rest", f"{b}.rest") * (1 + threshold) >= threshold * (na + nb) - 1e-6)

    # The first place at which two documents meet allows all that they share; later ones may be refused.
    return meetings(first_of_equals(asked), "h", "times", may)


def first_of_equals(asked: DataFrame) -> DataFrame:
    """Rows (h, doc_id, n, rest) of one shingle for each set of documents that have it, with the number of these (times).

    Near copies share hundreds of shingles, and would meet at each. Of shingles in the same documents the one at which most is
    still to follow stays; sets of documents are compared by their number and two sums of hashes. Shingles of one document go.
    """
    sums = [F.sum(F.shiftright(h, 22)).alias(f"sum{i}") for i, h in enumerate((F.xxhash64("doc_id"), F.xxhash64(F.lit(1), "doc_id")))]
    by = asked.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.sum("rest").alias("rest"), *sums).where("times > 1")
    first = by.groupBy("times", "sum0", "sum1").agg(F.max_by("h", F.struct("rest", "h")).alias("h")).select("h", "times")
    return materialize(asked.join(first, "h"), "meeting-prefixes")


def components(links: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """node and label (the least node reachable), by least-label steps with pointer jumping on written tables."""
    both = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    label = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        seen = both.join(label.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        step = label.join(seen, "u").select("u", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = step.join(label.select(F.col("u").alias("label"), F.col("label").alias("far")), "label", "left").select("u", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = materialize(jump, "labels")
        if not new.where("old <> label").limit(1).count():
            return new.select(F.col("u").alias("node"), "label")
        label = new.select("u", "label")


def members(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows of membership (label, node, content_hash) of near-duplicate families, and the edges behind them; written once, for whatever asks."""
    links = materialize(edges(docs, threshold), "family-edges")
    named = components(links).join(primaries(docs).select(F.col("doc_id").alias("node"), "content_hash"), "node")
    return materialize(named, "family-members"), links


def families(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate families of distinct texts. Without dates the largest content hash is primary.

    The members of a family stand in one row, as its id is a digest of them all; ``members`` has them as rows.
    """
    label, links = members(docs, threshold)
    named = label
    by = named.groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("members"), F.max_by("node", "content_hash").alias("primary_doc"))
    scores = links.select(F.col("doc_a").alias("p"), F.col("doc_b").alias("m"), "jaccard").unionByName(links.select(F.col("doc_b").alias("p"), F.col("doc_a").alias("m"), "jaccard"))
    worst = label.join(by.select("label", "primary_doc"), "label").where("node <> primary_doc").join(scores, (F.col("p") == F.col("primary_doc")) & (F.col("m") == F.col("node")), "left").groupBy("label").agg(F.min(F.coalesce("jaccard", F.lit(0.0))).alias("least_score"))
    as_text = F.transform("members", lambda m: m.cast("string"))
    return by.join(worst, "label").select(ids.family_id(as_text).alias("family_id"), F.size("members").cast("long").alias("n_members"), F.array_join(as_text, ",").alias("members"), "primary_doc", "least_score", F.lit("content_hash").alias("primacy_basis"))


def roles(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """exact_duplicate, superseded, primary or unique for every document."""
    label, _ = members(docs, threshold)
    first = primaries(docs).select(F.col("doc_id").alias("first_doc"), "content_hash")
    best = label.groupBy("label").agg(F.max_by("node", "content_hash").alias("primary_doc"))
    known = label.join(best, "label").select(F.col("node").alias("first_doc"), "primary_doc")
    named = docs.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash")).join(first, "content_hash").join(known, "first_doc", "left")
    role = F.when(F.col("doc_id") != F.col("first_doc"), "exact_duplicate").when(F.col("primary_doc").isNull(), "unique").when(F.col("primary_doc") == F.col("doc_id"), "primary").otherwise("superseded")
    return named.select("doc_id", role.alias("dedup_role"))


def _blocks(lowered: str, min_chars: int) -> dict[str, int]:
    """Every paragraph and every line of a lower-cased text, white space collapsed and trimmed, with how often it is a paragraph."""
    found: dict[str, int] = {}
    for p in PARAGRAPHS.split(lowered):
        block = " ".join(p.split())
        if len(block) >= min_chars:
            found[block] = found.get(block, 0) + 1
        if "\n" in (p := p.strip()):
            for line in p.split("\n"):
                block = " ".join(line.split())
                if len(block) >= min_chars:
                    found.setdefault(block, 0)
    return found


def _bucket(block: str) -> int:
    return zlib.crc32(block.encode("utf-8", "surrogatepass")) % BUCKETS


def _crowds(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """A partition's texts by the buckets that their blocks fall into."""
    times = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch.column(1):
            if t.is_valid:
                times[list({_bucket(b) for b in _blocks(t.as_py(), min_chars)})] += 1
    at = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(times[at])], names=["bucket", "n"])


def _crowded(batches: Iterator[pa.RecordBatch], min_chars: int, hot: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """(id, block, as_paragraph) of the blocks in some buckets."""
    for batch in batches:
        rows = [(i, b, n) for i, t in enumerate(batch.column(1)) if t.is_valid for b, n in _blocks(t.as_py(), min_chars).items() if _bucket(b) in hot]
        at, block, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(block, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "block", "as_paragraph"])


def boilerplate(docs: DataFrame, fraction: float = 0.30, small_fraction: float = 0.50, small: int = 10, min_total: int = 3, floor: float = 0.05, min_chars: int = 20) -> DataFrame:
    """Blocks in a large share of distinct texts, or repeated at least thrice in at least a twentieth.

    No block lies in more texts than its bucket, so those of buckets in too few texts are not looked at again; the
    others are counted exactly, combined per document first. The number of documents is one literal.
    """
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    one = materialize(primaries(docs).select("doc_id", F.lower("text").alias("text")), "distinct-texts")
    n = one.count()
    least = small_fraction if n < small else fraction
    share = lambda times: F.col(times) / F.lit(n)
    crowds = one.mapInArrow(tidy(lambda b: _crowds(b, min_chars)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(share("n") >= min(least, floor))
    hot = frozenset(r["bucket"] for r in crowds.collect())  # BUCKETS at most
    kind = one.schema["doc_id"].dataType.simpleString()
    found = one.mapInArrow(tidy(lambda b: _crowded(b, min_chars, hot)), f"doc_id {kind}, block string, as_paragraph long") if hot else spark.createDataFrame([], f"doc_id {kind}, block string, as_paragraph long")
    per = found.groupBy("block", "doc_id").agg(F.sum("as_paragraph").alias("as_paragraph"))
    by = per.groupBy("block").agg(F.count(F.lit(1)).alias("doc_count"), (F.count(F.lit(1)) + F.sum(F.greatest(F.col("as_paragraph") - 1, F.lit(0)))).alias("total_count"))
    keep = (F.lit(n) >= 2) & ((share("doc_count") > least) | ((F.col("total_count") >= min_total) & (share("doc_count") >= floor)))
    return by.where(keep).select("block", "doc_count", "total_count", F.round(share("doc_count"), 6).alias("doc_fraction"))


def _hits(batches: Iterator[pa.RecordBatch], known: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(id, lines that are not blank, known ones among them, whether the whole is known) of lower-cased texts."""
    for batch in batches:
        rows = []
        for t in batch.column(1).to_pylist():
            lines = [x for l in (t or "").split("\n") if (x := " ".join(l.split()))]
            rows.append((len(lines), sum(x in known for x in lines), " ".join(lines) in known))
        n, k, whole = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(whole, pa.bool_())], names=["id", "n", "k", "whole"])


def known_lines(texts: DataFrame, id_col: str, known: DataFrame) -> DataFrame:
    """Lines that are not blank (n), known blocks among them (k) and whether the whole text is one, by id; texts without such lines give no row.

    Known blocks go to the tasks while they are short together; beyond that lines are joined with them.
    """
    spark = texts.sparkSession
    ship(spark)
    batch_bytes(spark)
    known = materialize(known.select("block").distinct(), "known-blocks")
    lowered = texts.select(id_col, F.lower("text").alias("text"))
    if known.agg(F.coalesce(F.sum(F.length("block") + 64), F.lit(0))).first()[0] <= KNOWN_CHARS:
        held = frozenset(r["block"] for r in known.collect())
        rows = lowered.mapInArrow(lambda b: _hits(b, held), f"id {texts.schema[id_col].dataType.simpleString()}, n long, k long, whole boolean").where("n > 0")
    else:
        hit = known.withColumn("hit", F.lit(1))
        normal = lowered.select(F.col(id_col).alias("id"), F.explode(F.split("text", "\n", -1)).alias("l")).select("id", text.normal_block(F.col("l")).alias("block")).where("block <> ''")
        whole = lowered.select(F.col(id_col).alias("id"), text.normal_block(F.col("text")).alias("block")).join(known, "block", "left_semi")
        lines = normal.join(hit, "block", "left").select("id", F.lit(1).alias("n"), F.coalesce("hit", F.lit(0)).alias("k"), F.lit(False).alias("whole"))
        rows = lines.unionByName(whole.select("id", F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("whole")))
    return rows.groupBy(F.col("id").alias(id_col)).agg(F.sum("n").cast("long").alias("n"), F.sum("k").cast("long").alias("k"), F.max("whole").alias("whole"))


def boilerplate_documents(docs: DataFrame, known: DataFrame, least_lines: int = 3, share: float = 0.70) -> DataFrame:
    """Lines per document that are boilerplate blocks, and whether the text counts as boilerplate.

    ``known`` is bounded: a block must lie in a twentieth of all texts, so there are at most twenty times
    a text's blocks of them.
    """
    by = known_lines(docs, "doc_id", known)
    return by.select("doc_id", F.col("n").alias("n_lines"), F.col("k").alias("n_hits"), ((F.col("n") >= least_lines) & (F.col("k") >= share * F.col("n"))).alias("is_boilerplate"))
