"""Class statistics, rules recommended from them, language support and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T

# Chunk sizes by class where a class has too few segments to tell.
DEFAULT_MAX = {"prose": 512, "table": 1024, "code": 512, "scanned_region": 512}
PRICE = "0.00000002"


def class_stats(rows: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Count, extremes, mean and exclusive quantiles of token counts by class.

    Values travel as a histogram (count per class and length), which combines before it moves, so a class
    of a third of all rows brings only its distinct lengths together. Below four values quantiles but the
    median are the maximum.
    """
    hist = rows.select(F.col(by), tokens.alias("v")).groupBy(by, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = hist.withColumn("s", F.sum("c").over(Window.partitionBy(by).orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    marks = {"median_tokens": 0.5, "p75_tokens": 0.75, "p90_tokens": 0.9, "p95_tokens": 0.95}
    place = {k: F.greatest(F.lit(1), F.least(F.floor(F.lit(p) * (F.col("n") + 1)), F.col("n") - 1)) for k, p in marks.items()}
    at = [F.min(F.when(F.col("s") >= place[k] + d, F.col("v"))).alias(f"{k}_{d}") for k in marks for d in (0, 1)]
    per = ranked.groupBy(by).agg(F.first("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * F.col("c")).alias("total"), *at)

    def quantile(k: str, p: float) -> Column:
        low, high = F.col(f"{k}_0").cast("double"), F.col(f"{k}_1").cast("double")
        value = F.coalesce(low + (F.lit(p) * (F.col("n") + 1) - place[k]) * (high - low), low)
        few = (F.col("n") < 4) & F.lit(k != "median_tokens")
        return F.round(F.when(few, F.col("most").cast("double")).otherwise(value), 6).alias(k)

    return per.select(by, F.col("n").alias("segment_count"), F.col("least").alias("min_tokens"), F.col("most").alias("max_tokens"), F.round(F.col("total") / F.col("n"), 6).alias("mean_tokens"), *(quantile(k, p) for k, p in marks.items()))


def recommend(stats: DataFrame, by: str, kind: Column) -> DataFrame:
    """A chunking rule for each class: window from p90 in steps of 64, overlap and strategy by kind."""
    default = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DEFAULT_MAX.items() for x in kv)), F.col("kind")), F.lit(512))
    fitted = F.least(F.lit(2048), F.greatest(F.lit(64), (F.ceil(F.col("p90_tokens") / 64) * 64).cast("int")))
    most = F.when(F.col("segment_count") < 5, default).otherwise(fitted).cast("int")
    strategy = F.when(F.col("kind") == "table", "table_atomic").when(F.col("kind") == "code", "code_syntax").otherwise("recursive_char")
    kinds = F.col("kind")
    overlap = F.when(kinds.isin("table", "code"), 0).otherwise(F.greatest(F.lit(32), F.floor(F.col("max_tokens") / 8))).cast("int")
    rule = stats.select(by, "segment_count", "p90_tokens", kind.alias("kind")).withColumn("max_tokens", most)
    out = rule.withColumn("overlap_tokens", overlap).withColumn("strategy", strategy)
    return out.select(by, "max_tokens", "overlap_tokens", "strategy", F.when(kinds.isin("boilerplate", "front_matter"), "boilerplate").otherwise("primary,supporting").alias("salience_filter"), (~kinds.isin("code", "scanned_region", "boilerplate", "front_matter", "cross_reference")).alias("rerank_eligible"))


def ocr_floor(p10: Column) -> Column:
    return F.when(p10.isNull(), 0.60).otherwise(F.least(F.lit(0.85), F.greatest(F.lit(0.50), p10)))


def language_support(rows: DataFrame, language: Column, declared: tuple[str, ...]) -> DataFrame:
    """Share of each language and whether it is supported; below a fiftieth nothing is asked of it."""
    by = rows.groupBy(language.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    share = F.round(F.col("n") / F.lit(max(total, 1)), 4)
    known = F.lit("*" in declared) | F.col("language").isin(*declared)
    return by.select("language", "n", share.alias("share"), F.when((F.col("language") == "und") | (share < 0.02) | known, "supported").otherwise("unsupported").alias("decision"))


def ingestion_cost(rows: DataFrame, tokens: Column, most: int = 512, overlap: int = 64, price: str = PRICE) -> DataFrame:
    """Chunks, tokens and price of embedding texts in word windows, in closed form and exact decimals."""
    step = most - overlap
    chunks = F.when(tokens <= most, F.least(tokens, F.lit(1))).otherwise(F.ceil((tokens - F.lit(most)) / F.lit(step)) + 1)
    sent = F.when(tokens <= most, tokens).otherwise(tokens + F.lit(overlap) * (chunks - 1))
    by = rows.agg(F.sum(chunks.cast("long")).alias("n_chunks"), F.sum(sent.cast("long")).alias("n_tokens"))
    return by.select("n_chunks", "n_tokens", (F.col("n_tokens").cast("decimal(18,0)") * F.lit(price).cast("decimal(18,9)")).cast("decimal(18,9)").cast("string").alias("cost_usd"))


def table_shape(t: Column) -> tuple[Column, Column]:
    """Rows (separators left out) and columns of a piped table."""
    rows = F.filter(F.split(t, "\n"), lambda r: r.contains("|") & ~r.rlike(r"^[\s|:\-]+$"))
    return F.size(rows), F.size(F.split(F.element_at(rows, 1), r"\|")) - 1


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", T.word_count(F.col("text")))
