"""Mixing sources to target weights by thresholds on a hash, without sorting.

A document's size is its number of words. Sources share a number of words by their weights, none more than
``MOST`` times what it has; what a source cannot take is shared again by the others. A source takes every
document as often as its target holds the whole source, and of the rest those whose hash lies below a
threshold. Thresholds come from histograms: sizes are summed by source and by the leading bits of the
hash, the bucket in which the target is met is found, and only that bucket's documents are summed again by
their next bits, until one hash is left. Documents of that hash give their share of the words still
missing, so a source misses its target by less than one word for each of them.

Thresholds are nested: a document that a smaller share of words takes, every larger one takes at least as
often, and what is taken follows from ids, texts and sources alone, so reruns agree.

Sums combine before they move, and a window over a source sees at most ``2 ** BITS`` buckets. The table of
sources is broadcast only when it is small by count; beyond that both sides are salted.

Defined cases: a null text has size 0, and a document of size 0 is taken with 0 words; texts of any length are
counted whole; a null source is one of its own, last in order; rows that repeat a doc_id, or have none, have
one hash together, and where it is the threshold each gives its share; a source without words has target 0;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import batch_bytes, materialize, ship, tidy

WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash, and those of one histogram.
HASH_BITS, BITS = 60, 12
BROADCAST_SOURCES = 50_000
SALTS = 32

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words (runs without ASCII white space) of every text of an Arrow column of strings, on its bytes."""
    column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = ~space[begins]
    upto = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def hashed(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, missing (no source), size and h of every document, written once."""
    ship(docs.sparkSession)
    batch_bytes(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(word_counts(b.column("text")))], names=[*names, "size"])

    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("missing"), hashed(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, source string, missing boolean, h long, size long"), "mix-sizes")


def targets(sizes: DataFrame, share: float = 1.0, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, missing, source_size, weight and target of every source; a few sums and counts of ranges pass the driver.

    Weights go round by the order of sources: ranges of sources are counted, and each numbers its own.
    """
    total = sizes.groupBy("missing", "source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(total.repartitionByRange("missing", "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return ranged.select("source", "missing", "source_size", F.lit(0).alias("weight"), F.lit(0.0).alias("target"))
    starts = F.create_map(*[F.lit(x) for (p, _), s in zip(counts, np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False) for x in (p, s)])
    place = starts[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy("missing", "source")) - 1
    weighed = materialize(ranged.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).drop("part"), "mix-weights")
    words = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    full, level = None, 0.0
    while True:  # Each round fills at least one more source, or ends.
        over = F.lit(level) * F.col("weight") > most * F.col("source_size")
        got = weighed.agg(F.sum(F.when(over, most * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (words - got[0]) / got[1]
    at = F.lit(level) * F.col("weight")
    return weighed.withColumn("target", F.when(at > most * F.col("source_size"), (most * F.col("source_size")).cast("double")).otherwise(at))


def beside(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` joined with what is known of their sources."""
    keys = ["source", "missing"]
    if few:
        return rows.join(F.broadcast(sources), keys)
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("h", "size"), F.lit(SALTS))).join(salted, [*keys, "salt"]).drop("salt")


def thresholds(sizes: DataFrame, wanted: DataFrame, few: bool, bits: int = BITS) -> DataFrame:
    """source, missing, times (whole takes), need (words beyond them), edge (the threshold), below and at (sizes under the edge, and of it)."""
    keys = ["source", "missing"]
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = wanted.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    open_, rows, found = state.select(*keys, "need", F.lit(0).cast("long").alias("below")), sizes, None
    for shift in range(HASH_BITS - bits, -bits, -bits):
        shift = max(shift, 0)
        summed = rows.groupBy(*keys, F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("at"), F.min("h").alias("least"), F.max("h").alias("edge"))
        upto = F.sum("at").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = summed.join(open_, keys).withColumn("upto", F.col("below") + upto).where((F.col("upto") - F.col("at") <= F.col("need")) & (F.col("need") < F.col("upto")))
        met = materialize(met.select(*keys, "need", (F.col("upto") - F.col("at")).alias("below"), "bucket", "at", "least", "edge"), "mix-edges")
        done = met.where("least = edge").select(*keys, "edge", "below", "at")
        found = done if found is None else found.unionByName(done)
        open_ = met.where("least <> edge").select(*keys, "need", "below", "bucket")
        if shift == 0 or not open_.limit(1).count():
            break
        inside = beside(rows, open_.select(*keys, "bucket"), few).where(F.shiftright("h", shift) == F.col("bucket")).select(*keys, "h", "size")
        rows, open_ = materialize(inside, "mix-inside"), open_.drop("bucket")
    return materialize(state.join(found, keys, "left").select(*keys, "source_size", "target", "times", "need", "edge", "below", "at"), "mix-thresholds")


def mix(docs: DataFrame, share: float = 1.0, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target (its source's) and taken (words the mix takes of it) of every document.

    ``share`` is the mix's size as a part of all words.
    """
    sizes = sized(docs, id_col, text_col, source_col)
    wanted = materialize(targets(sizes, share, weights, most), "mix-targets")
    few = wanted.count() <= BROADCAST_SOURCES
    known = thresholds(sizes, wanted, few)
    once = F.when(F.col("h") < F.col("edge"), F.col("size")).when(F.col("h") == F.col("edge"), F.floor(F.col("size") * (F.col("need") - F.col("below")) / F.col("at"))).otherwise(0)
    taken = (F.col("size") * F.col("times") + once).cast("long")
    return beside(sizes, known, few).select("doc_id", F.when(~F.col("missing"), F.col("source")).alias("source"), "size", "source_size", "target", taken.alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                     ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS w FROM d GROUP BY source),
lam AS (SELECT 0 AS step, (SELECT sum(n) / sum(w) FROM s) AS l UNION ALL
        SELECT step + 1, (SELECT ((SELECT sum(n) FROM s) - sum(CASE WHEN l * w > {MOST} * n THEN {MOST} * n ELSE 0 END)) / sum(CASE WHEN l * w > {MOST} * n THEN 0 ELSE w END) FROM s)
        FROM lam WHERE step < (SELECT count(*) FROM s)),
t AS (SELECT source, n, CASE WHEN l * w > {MOST} * n THEN {MOST}::DOUBLE * n ELSE l * w END AS target FROM s, (SELECT l FROM lam ORDER BY step DESC LIMIT 1)),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS times FROM t),
h AS (SELECT source, h, sum(size)::BIGINT AS "at" FROM d GROUP BY source, h),
u AS (SELECT *, (sum("at") OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM h),
e AS (SELECT r.source, u.h AS edge, upto - "at" AS below, "at" FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
      WHERE upto - "at" <= target - times * n AND target - times * n < upto)
SELECT doc_id, size, r.n AS source_size, target, (size * times + CASE WHEN h < edge THEN size WHEN h = edge THEN floor(size * (target - times * n - below) / "at") ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
